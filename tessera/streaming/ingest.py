"""Incremental ingestion as a stream of files, and a cache with a time to live as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.chunking import chunk_documents
from tessera.operators.manifest import latest, needs_processing
from tessera.sources.stores import append_manifest, load_manifest


def ingest_batch(spark: SparkSession, documents: DataFrame, company_id: str, manifest_path: str, chunks_path: str, seq: int, size: int = 512, overlap: int = 50, least: int = 100) -> DataFrame:
    """Chunk the documents (source_path, text) that the manifest does not hold as they are, append their chunks and entries.

    Returns the entries. Running a batch again changes nothing: its documents are current by then.
    """
    files = documents.select("source_path", "text", F.sha2("text", 256).alias("current_sha256"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest_path)
    known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    todo = needs_processing(files, load_manifest(spark, manifest_path), spark.createDataFrame([], "clean_path string")) if known else files
    named = todo.withColumnRenamed("source_path", "doc_id")
    chunks = chunk_documents(named, size, overlap, least).join(named.select("doc_id", F.col("current_sha256").alias("file_sha256")), "doc_id")
    chunks.select(F.concat_ws(":", "file_sha256", "chunk_index").alias("id"), F.col("doc_id").alias("source_path"), "file_sha256", "chunk_index", "text", "page_number", "is_code", F.lit(company_id).alias("company_id"), F.lit(seq).cast("long").alias("seq")).write.mode("append").partitionBy("company_id").parquet(chunks_path)
    counts = spark.read.parquet(chunks_path).filter((F.col("company_id") == company_id) & (F.col("seq") == seq)).groupBy("source_path").agg(F.count("*").cast("int").alias("chunk_count"))
    entries = todo.join(counts, "source_path", "left").select(
        "source_path", F.col("current_sha256").alias("file_sha256"), F.lit(None).cast("string").alias("clean_path"), F.lit(company_id).alias("company_id"), F.lit("ok").alias("status"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("processed_at"), F.lit(seq).cast("long").alias("seq"),
    )
    append_manifest(entries, manifest_path)
    return entries


def current_chunks(spark: SparkSession, manifest_path: str, chunks_path: str) -> DataFrame:
    """The chunks of each source's latest content; older ones and those of failed sources are left out."""
    entries = load_manifest(spark, manifest_path).filter("status = 'ok'").select("source_path", "file_sha256")
    return latest(spark.read.parquet(chunks_path), "id").join(entries, ["source_path", "file_sha256"], "left_semi")


def ingest_stream(spark: SparkSession, stream: DataFrame, company_id: str, manifest_path: str, chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Ingest what is there of a stream of (source_path, text), batch by batch, and stop."""

    def batch(df: DataFrame, number: int) -> None:
        ingest_batch(df.sparkSession, df, company_id, manifest_path, chunks_path, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_cache(ttl_ms: int) -> Callable:
    """A state function: rows (key, ts_ms, request_id) of a key -> (key, request_id, hit); the state is when its entry ends."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "request_id"])
        out = []
        for at, request in zip(rows["ts_ms"], rows["request_id"], strict=True):
            hit = at < until
            if not hit:
                until = at + ttl_ms
            out.append((key[0], request, hit))
        state.update((int(until),))
        yield pd.DataFrame(out, columns=["key", "request_id", "hit"])

    return run


def cache_stream(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, request_id, hit) of a stream of (key, ts_ms, request_id)."""
    return requests.groupBy("key").applyInPandasWithState(ttl_cache(ttl_ms), "key string, request_id long, hit boolean", "until long", "append", GroupStateTimeout.NoTimeout)
