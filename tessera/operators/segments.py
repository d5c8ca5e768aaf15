"""A BM25 index in segments: each ingest writes one segment of what is new and of what went, and statistics are sums over segments.

A segment holds postings of its own documents, marks for documents of earlier segments that are gone or replaced, and the changes that both
make to document frequencies and lengths. A document's row counts if no later segment marks it. So a refresh reads no old text and writes
no old row; scores are those of an index made at once. A segment counts from when its row of totals is there, which is written last; what a
broken refresh left behind is never read. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.runtime import discard, materialize
from tessera.sources.buckets import read_or_none

_TABLES = {
    "postings": "doc_id {doc}, scope {scope}, dl long, terms array<string>, counts array<int>, segment string",
    "gone": "doc_id {doc}, segment string",
    "terms": "scope {scope}, term string, df long, cf long, segment string",
    "totals": "scope {scope}, n_docs long, n_tokens long, of string, segment string",
}


class SegmentedIndex:
    """The segments under ``path``; ``tenant`` names the column of documents that statistics are kept by."""

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "string", tenant: str | None = None, scope_type: str = "string"):
        self.spark, self.path, self.tenant = spark, path.rstrip("/"), tenant
        self.types = {"doc": doc_type, "scope": scope_type if tenant else "int"}

    def _read(self, name: str) -> DataFrame:
        rows = read_or_none(self.spark, f"{self.path}/{name}", _TABLES[name].format(**self.types))
        return rows if name == "totals" else rows.filter(F.col("segment").isin(self.segments()))

    def segments(self) -> list[str]:
        """Complete segments, the oldest first; few, as ``compacted`` makes one of them."""
        return sorted(r["segment"] for r in self._read("totals").select("segment").distinct().collect())

    def last(self) -> str | None:
        """What the last refresh was named, if there was one."""
        known = self.segments()
        return self._read("totals").filter(F.col("segment") == known[-1]).first()["of"] if known else None

    def live(self) -> DataFrame:
        """Postings that count."""
        marks = self._read("gone").groupBy(F.col("doc_id").alias("__id")).agg(F.max("segment").alias("__until"))
        rows = self._read("postings")
        joined = rows.join(marks, rows["doc_id"].eqNullSafe(marks["__id"]), "left")
        return joined.filter(F.col("__until").isNull() | (F.col("segment") >= F.col("__until"))).drop("__id", "__until", "segment")

    def _write(self, rows: DataFrame, name: str, segment: str) -> None:
        rows.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{self.path}/{name}")

    def apply(self, new: DataFrame, gone: DataFrame | None = None, of: str = "") -> str:
        """Write a segment of documents (doc_id, text), which replace those of their doc_ids, without those of ``gone`` (doc_id). Returns its name."""
        known = self.segments()
        segment = f"{int(known[-1][:8]) + 1 if known else 0:08d}-{uuid.uuid4().hex[:12]}"
        added = materialize(bm25.postings(new, self.tenant), "added")
        ids = added.select("doc_id") if gone is None else added.select("doc_id").union(gone.select("doc_id"))
        named = ids.select(F.col("doc_id").alias("__id")).distinct()
        live = self.live()
        removed = materialize(live.join(named, live["doc_id"].eqNullSafe(named["__id"]), "left_semi"), "removed")
        signed = lambda f, c, up: f.withColumns({x: F.col(x) * (1 if up else -1) for x in c})
        both = lambda f, c: signed(f(added), c, True).unionByName(signed(f(removed), c, False))
        terms = both(bm25.term_statistics, ["df", "cf"]).groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        totals = both(lambda x: bm25.corpus_statistics(x).drop("avgdl"), ["n_docs", "n_tokens"]).groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._write(added, "postings", segment)
        self._write(removed.select("doc_id"), "gone", segment)
        self._write(terms.filter("df != 0 OR cf != 0"), "terms", segment)
        nothing = self.spark.createDataFrame([(None, 0, 0)], f"scope {self.types['scope']}, n_docs long, n_tokens long")
        self._write(totals.unionByName(nothing).withColumn("of", F.lit(of)).coalesce(1), "totals", segment)
        discard(added, removed)
        return segment

    def sync(self, documents: DataFrame, of: str = "") -> str:
        """Make the index that of ``documents``: those with doc_ids that it lacks are added, those that it has beyond them go. Texts of others are not read."""
        have = materialize(self.live().select(F.col("doc_id").alias("__id")), "have")
        same: Column = F.col("doc_id").eqNullSafe(F.col("__id"))
        new = documents.join(have, same, "left_anti")
        gone = have.join(documents.select("doc_id"), same, "left_anti").select(F.col("__id").alias("doc_id"))
        segment = self.apply(new, gone, of)
        discard(have)
        return segment

    def index(self) -> bm25.Index:
        """The index over all segments, for ``bm25.search_index``."""
        totals = self._read("totals").groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs > 0")
        stats = materialize(totals.withColumn("avgdl", F.col("n_tokens").cast("double") / F.col("n_docs").cast("double")), "stats")
        terms = self._read("terms").groupBy("scope", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
        return bm25.Index(self.live(), stats, materialize(bm25.term_weights(terms, stats), "weights"))

    def compacted(self, path: str) -> SegmentedIndex:
        """The same index as one segment in a new folder; marks and rows that no longer count are left behind."""
        made = SegmentedIndex(self.spark, path, self.types["doc"], self.tenant, self.types["scope"])
        segment = f"{0:08d}-{uuid.uuid4().hex[:12]}"
        live = materialize(self.live(), "live")
        self_stats = bm25.corpus_statistics(live).drop("avgdl")
        made._write(live, "postings", segment)
        made._write(bm25.term_statistics(live), "terms", segment)
        nothing = self.spark.createDataFrame([(None, 0, 0)], f"scope {self.types['scope']}, n_docs long, n_tokens long")
        made._write(self_stats.unionByName(nothing).withColumn("of", F.lit(self.last() or "")).coalesce(1), "totals", segment)
        discard(live)
        return made
