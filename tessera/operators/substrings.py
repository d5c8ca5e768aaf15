"""Substring search in the question log through postings of trigrams.

A search with wildcards holds literal runs; an entry that matches has every trigram of every run in its question or in its answer.
The postings of the rarest few trigrams name the candidates, whose rows alone are read and held against the search itself, so the rows
are those of ``history.matching``. A search without a run of three characters reads all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import history
from tessera.runtime import materialize, shuffle_partitions
from tessera.sources.buckets import number, read_or_none

#: Postings are read for so many trigrams of a search, the rarest ones.
RAREST = 4
#: Folders of postings by trigram, and of rows by id.
BUCKETS, PLACES = 64, 64
#: A folder of postings is written by so many tasks at least, and a task writes postings of about so many bytes of text at most.
PARTS, PART_BYTES = 8, 1 << 20
_WIDTH = 3

_GRAMS = "gram string, n long, bucket int"
_POSTINGS = "gram string, id long, field int, place int, bucket int"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, A-Z lower-cased; none of a null text or one of less than three characters."""
    letters = F.split(F.translate(text, history.UPPER, history.LOWER), "")
    n = F.greatest(F.size(letters) - (_WIDTH - 1), F.lit(0))
    # side by side, as a lambda that looked into the letters would split the text for each of them
    beside = F.arrays_zip(*(F.slice(letters, i + 1, n).alias(f"c{i}") for i in range(_WIDTH)))
    return F.array_distinct(F.coalesce(F.transform(beside, lambda x: F.concat(*(x[f"c{i}"] for i in range(_WIDTH)))), F.array().cast("array<string>")))


def needed(search: str) -> list[str]:
    """The trigrams that an entry must have in one of its texts to match."""
    runs = re.split("[%_]", search.translate(str.maketrans(history.UPPER, history.LOWER)))
    return sorted({run[i : i + _WIDTH] for run in runs for i in range(len(run) - _WIDTH + 1)})


class SubstringIndex:
    """Postings, counts of trigrams, and rows of a question log under ``path``.

    Rows have the columns of the log given at first; rows without id take no part. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, places: int = PLACES):
        self.spark, self.path, self.buckets, self.places = spark, path.rstrip("/"), buckets, places

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        rows.write.mode("append").partitionBy(by).parquet(f"{self.path}/{name}")

    def rows(self, schema: T.StructType) -> DataFrame:
        return read_or_none(self.spark, f"{self.path}/rows", T.StructType([*schema, T.StructField("place", T.IntegerType())]))

    def refresh(self, log: DataFrame) -> None:
        """Take the entries whose id lies above the largest one that the index holds; ids of a log grow.

        Rows are written last, so a refresh that broke off is made again; postings that it left are only looked up twice.
        """
        top = self.rows(log.schema).agg(F.max("id")).first()[0]
        fresh = log.filter(F.col("id").isNotNull() if top is None else F.col("id") > top)
        new = materialize(fresh.withColumn("place", number(F.col("id").cast("string"), self.places)), "entries")
        if new.isEmpty():
            return
        texts = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), trigrams(F.col(c)).alias("grams")) for i, c in enumerate(("question", "answer")))))
        held = new.select("id", "place", texts.alias("t")).select(F.explode("t.grams").alias("gram"), F.col("id").cast("long"), "t.field", "place")
        held = held.withColumn("bucket", number(F.col("gram"), self.buckets))
        # a task's share is bounded, however many entries come: their folders are dealt by id
        size = new.agg(F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0]
        part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
        parts = max(PARTS, 1 + size // (self.buckets * PART_BYTES))
        tasks = max(shuffle_partitions(self.spark), self.buckets * parts)
        dealt = held.repartition(tasks, "bucket", part(parts)).sortWithinPartitions("bucket", "gram")
        self._write(dealt, "postings", "bucket")
        counted = held.groupBy("gram", "bucket").agg(F.count("*").alias("n"))
        self._write(counted.repartition("bucket").sortWithinPartitions("gram"), "grams", "bucket")
        parts = 1 + size // (self.places * 16 * PART_BYTES)  # rows take less than their postings
        tasks = max(shuffle_partitions(self.spark), self.places * parts)
        self._write(new.repartition(tasks, "place", part(parts)).sortWithinPartitions("id"), "rows", "place")

    def _folders(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """The rows of ``table`` for these trigrams; the folders are named, so that others are not listed."""
        named = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(number(F.col("gram"), self.buckets).alias("b")).distinct()
        return table.filter(F.col("bucket").isin([r["b"] for r in named.collect()]) & F.col("gram").isin(grams))  # a search's trigrams

    def candidates(self, search: str) -> DataFrame | None:
        """(id, place) of the entries that hold the rarest trigrams of the search in one text; None where it has no trigram."""
        grams = needed(search)
        if not grams:
            return None
        counts = self._folders(read_or_none(self.spark, f"{self.path}/grams", _GRAMS), grams).groupBy("gram").agg(F.sum("n").alias("n"))
        known = {r["gram"]: r["n"] for r in counts.collect()}  # a row for a trigram of the search
        rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RAREST]
        postings = self._folders(read_or_none(self.spark, f"{self.path}/postings", _POSTINGS), rarest)
        if rarest[0] not in known:
            postings = postings.filter(F.lit(False))
        both = postings.groupBy("id", "place", "field").agg(F.collect_set("gram").alias("grams")).filter(F.size("grams") == len(rarest))
        return both.select("id", "place").distinct()

    def matching(self, log: DataFrame, search: str) -> DataFrame:
        """The indexed entries that match, unordered, with the columns of ``log`` (whose rows are not read)."""
        found, rows = self.candidates(search), self.rows(log.schema)
        if found is not None:
            found = materialize(found, "candidates")
            places = [r["place"] for r in found.select("place").distinct().collect()]  # PLACES of them at most
            rows = rows.filter(F.col("place").isin(places)).join(found.select("id"), "id", "left_semi")
        return history.matching(rows, search).select(*log.columns)

    def entries(self, log: DataFrame, company_id: str, search: str, limit: int | None = 50) -> DataFrame:
        """A tenant's matching entries, latest first, as ``history.entries`` gives them."""
        return history.entries(self.matching(log, search), company_id, None, limit)
