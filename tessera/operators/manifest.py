"""Ingestion bookkeeping: last-wins replay, audit, incremental selection, work lists, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("ok", "error", "skipped_scanned")
#: Audit outcomes in order of precedence.
OUTCOMES = ("ERROR_ENTRY", "SCANNED", "MISSING_SOURCE", "HASH_MISMATCH", "MISSING_CLEAN_FILE", "OK")
FAILURES = ("MISSING_SOURCE", "MISSING_CLEAN_FILE", "HASH_MISMATCH", "ERROR_ENTRY")


def latest(log: DataFrame, key: str | list[str] = "source_path", order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``; combines on the map side and never sorts a key's history."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return last.select(*keys, *(F.col("row")[c].alias(c) for c in rest)).select(*log.columns)


def audit(manifest: DataFrame, sources: DataFrame, clean: DataFrame) -> DataFrame:
    """(source_path, outcome) of each entry against current files (source_path, current_sha256) and clean files (clean_path)."""
    there = manifest.join(sources.select("source_path", "current_sha256"), "source_path", "left")
    there = there.join(clean.select("clean_path", F.lit(True).alias("__clean")), "clean_path", "left")
    outcome = (
        F.when(F.col("status") == "error", OUTCOMES[0])
        .when(F.col("status") == "skipped_scanned", OUTCOMES[1])
        .when(F.col("current_sha256").isNull(), OUTCOMES[2])
        .when(F.col("current_sha256") != F.col("file_sha256"), OUTCOMES[3])
        .when(F.col("clean_path").isNotNull() & F.col("__clean").isNull(), OUTCOMES[4])
        .otherwise(OUTCOMES[5])
    )
    return there.select("source_path", outcome.alias("outcome"))


def audit_counts(audited: DataFrame) -> DataFrame:
    """(outcome, n, is_failure) with a row for every outcome, zero counts too."""
    spark = audited.sparkSession
    known = spark.createDataFrame([(o, o in FAILURES) for o in OUTCOMES], "outcome string, is_failure boolean")
    counts = audited.groupBy("outcome").agg(F.count("*").alias("n"))
    return known.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "is_failure")


def needs_processing(files: DataFrame, manifest: DataFrame, clean: DataFrame) -> DataFrame:
    """The files (source_path, current_sha256) that have no current result: no entry, not ok, changed, or clean file gone."""
    done = manifest.filter(F.col("status") == "ok").select("source_path", F.col("file_sha256").alias("current_sha256"), "clean_path")
    whole = done.join(clean.select("clean_path").distinct().withColumn("__clean", F.lit(True)), "clean_path", "left")
    current = whole.filter(F.col("clean_path").isNull() | F.col("__clean")).select("source_path", "current_sha256")
    return files.join(current, ["source_path", "current_sha256"], "left_anti")


def stale_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose source file is gone or has other content now; these are purged."""
    return chunks.join(files.select("source_path", F.col("current_sha256").alias("file_sha256")), ["source_path", "file_sha256"], "left_anti")


def status_counts(manifest: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return manifest.groupBy(*by).agg(*counts)


def tenant_stats(manifest: DataFrame) -> DataFrame:
    """(company_id, total_pdfs, total_chunks): entries of any status, and chunks of those that have some."""
    return manifest.groupBy("company_id").agg(F.count("*").alias("total_pdfs"), F.sum(F.coalesce("chunk_count", F.lit(0))).cast("long").alias("total_chunks"))


def ingest_summary(results: DataFrame) -> DataFrame:
    """(status, n, chunks) of a run, with failed (errors and nothing ok) on every row."""
    by = results.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("chunk_count", F.lit(0))).cast("long").alias("chunks"))
    whole = results.agg((F.count_if(F.col("status") == "error") > 0).alias("__e"), (F.count_if(F.col("status") == "ok") == 0).alias("__n"))
    return by.crossJoin(F.broadcast(whole)).select("status", "n", "chunks", (F.col("__e") & F.col("__n")).alias("failed"))  # ``whole`` is one row


def seed(paths: DataFrame, state: DataFrame) -> DataFrame:
    """The distinct paths to work on: those not completed, pending or skipped; failed ones come again."""
    held = state.filter(F.col("state").isin("completed", "pending", "skipped_scanned")).select("path")
    return paths.select("path").distinct().join(held, "path", "left_anti")


def mark(state: DataFrame, updates: DataFrame) -> DataFrame:
    """(path, state) after updates: a path's last state holds, so no path is in two lists."""
    both = state.select("path", "state", F.lit(0).alias("seq")).union(updates.select("path", "state", F.lit(1).alias("seq")))
    return latest(both, "path").select("path", "state")


def is_complete(state: DataFrame) -> DataFrame:
    """One row: whether nothing is pending."""
    return state.agg((F.count_if(F.col("state") == "pending") == 0).alias("complete"))


def totals(registry: DataFrame, history: DataFrame, most: int = 100_000) -> DataFrame:
    """One row: tenants, pdfs, chunks, and questions asked, of which no tenant counts more than ``most``."""
    asked = history.groupBy("company_id").agg(F.least(F.count("*"), F.lit(most)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("questions"))
    sums = registry.agg(F.count("*").alias("companies"), F.coalesce(F.sum("total_pdfs"), F.lit(0)).cast("long").alias("pdfs"), F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("chunks"))
    return sums.crossJoin(F.broadcast(asked))  # one row each


def registry_list(registry: DataFrame) -> DataFrame:
    return registry.select("company_id", "name", "total_pdfs", "total_chunks", F.coalesce("last_ingestion", F.lit("never")).alias("last_ingestion"))


def last_state(status: Column) -> Column:
    """The work-list state that an outcome leads to."""
    return F.when(status == "ok", "completed").when(status == "error", "failed").otherwise("skipped_scanned")
