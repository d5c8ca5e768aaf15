"""A cache of answers, and hits and misses of a cache with a time to live over a log of requests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import cache_key
from tessera.operators import conversation
from tessera.runtime import materialize, shuffle_partitions
from tessera.sources.versions import Versions


def cache_hits(requests: DataFrame, ttl_seconds: float, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``hit`` to every request: true within ``ttl_seconds`` of the last miss of its key.

    Whether a request hits depends on all misses before it, so each key's requests are read in order; they stream
    through one task without being gathered.
    """
    n = shuffle_partitions(requests.sparkSession)
    ordered = requests.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(n, *keys).sortWithinPartitions(*keys, "__us", tie)
    result = T.StructType([*requests.schema.fields, T.StructField("hit", T.BooleanType())])
    names = requests.columns
    life = int(ttl_seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, 0
        for b in batches:
            hits = []
            for *key, at in zip(*(b.column(k).to_pylist() for k in [*keys, "__us"]), strict=True):
                hit = key == now and at < until
                if not hit:
                    now, until = key, at + life
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(hits, pa.bool_())], names=result.names)

    return ordered.mapInArrow(run, result)


@dataclass
class AnswerCache:
    """Answers by (company_id, question) with a time to live and a most number of entries, in a table with versions.

    The least recently used go first, by the time of their last use. A table that another writer has made newer is read as it is.
    """

    spark: SparkSession
    path: str
    ttl_seconds: float = 3600
    most: int = 256

    _SCHEMA = "key string, answer string, citations string, made double, used double"

    def entries(self) -> DataFrame:
        found = Versions(self.spark, self.path).current()
        return self.spark.read.schema(self._SCHEMA).parquet(f"{found}/entries") if found else self.spark.createDataFrame([], self._SCHEMA)

    def answered(self, company_id: str, questions: DataFrame, messages: DataFrame | None, answer: Callable[[DataFrame, DataFrame | None], DataFrame], now: float | None = None) -> DataFrame:
        """(item_id, answer, citations as JSON, standalone, hit) of every question; ``answer`` is asked what the cache does not hold.

        Equal questions are answered once. Questions with history neither read nor write the cache.
        """
        now = time.time() if now is None else now
        keyed = questions.withColumn("__key", cache_key(F.lit(company_id), F.col("text")))
        if messages is not None:
            told = conversation.turns_before(messages, questions.select("item_id", "conv_id", "turn"), 1).select("item_id")
            follow_ups, keyed = keyed.join(told, "item_id", "left_semi").drop("__key"), keyed.join(told, "item_id", "left_anti")
        live = materialize(self.entries().filter(F.col("made") > now - self.ttl_seconds), "live")
        firsts = keyed.groupBy("__key").agg(F.min("item_id").alias("item_id"))
        missed = materialize(firsts.join(live.select(F.col("key").alias("__key")), "__key", "left_anti"), "missed")
        fresh = answer(keyed.drop("__key").join(missed.select("item_id"), "item_id", "left_semi"), None)
        fresh = fresh.join(missed, "item_id").select(F.col("__key").alias("key"), "answer", F.to_json("citations").alias("citations"), F.lit(now).alias("made"), F.lit(now).alias("used"))
        fresh = materialize(fresh, "fresh")
        asked = firsts.select(F.col("__key").alias("key"))
        touched = live.join(asked.withColumn("__now", F.lit(now)), "key", "left").withColumn("used", F.coalesce("__now", "used")).drop("__now")
        kept = touched.unionByName(fresh).orderBy(F.desc("used"), "key").limit(self.most)
        Versions(self.spark, self.path).write(lambda folder: kept.write.parquet(f"{folder}/entries"))
        known = live.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
        out = keyed.join(known, keyed["__key"] == known["key"]).select("item_id", "answer", "citations", F.lit(None).cast("string").alias("standalone"), "hit")
        if messages is None:
            return out
        rest = answer(follow_ups, messages).select("item_id", "answer", F.to_json("citations").alias("citations"), "standalone", F.lit(False).alias("hit"))
        return out.unionByName(rest)
