"""Okapi BM25, per tenant or over everything: an index of a row per document, and a search that ranks within each partition.

A document's postings are counted where its text is read and stay in one row, so making the index shuffles nothing; statistics
are counts that combine on the map side and can be stored with it. Questions are asked in blocks of bounded size: the few
weights that a block asks for go to the postings, each partition keeps its own best documents, and only these are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.runtime import discard, materialize, scratch_path

#: Fixed values of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions of a block at most, and weights (asked terms times tenants) that go out with it at most.
BLOCK, BLOCK_WEIGHTS = 1024, 500_000
#: Pairs of a posting and a question that asks for it, and kept candidates, that a task handles at once.
_PAIRS, _KEPT = 1 << 20, 1 << 18

_TOKEN = re.compile("[a-z0-9]+")


def idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def postings(documents: DataFrame, tenant: str | None = None) -> DataFrame:
    """(doc_id, scope, dl, terms, counts): each document's number of tokens, its distinct terms and how often each occurs."""
    kept = documents.select("doc_id", (F.col(tenant) if tenant else F.lit(0)).alias("scope"), "text")
    added = (("dl", T.LongType()), ("terms", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*kept.schema.fields[:2], *(T.StructField(n, k) for n, k in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(_TOKEN.findall(t.lower())) if t else Counter() for t in b.column("text").to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in found])]), pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array([t for c in found for t in c], pa.string()))
            counts = pa.ListArray.from_arrays(offsets, pa.array([n for c in found for n in c.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("scope"), pa.array([c.total() for c in found], pa.int64()), terms, counts], names=schema.names)

    return kept.mapInArrow(run, schema)


def term_statistics(index: DataFrame) -> DataFrame:
    """(scope, term, df, cf) of postings: documents that hold a term, and its occurrences."""
    each = index.select("scope", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return each.groupBy("scope", F.col("x.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("x.counts").alias("cf"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    """(scope, n_docs, n_tokens, avgdl) of postings; documents without tokens count."""
    stats = index.groupBy("scope").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"))
    return stats.withColumn("avgdl", F.col("n_tokens").cast("double") / F.col("n_docs").cast("double"))


def term_weights(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, term, idf) of term and corpus statistics: a negative idf is replaced by EPSILON times the mean over all terms, negative ones included.

    Documents without a tenant are one of their own, so joins hold nulls equal.
    """
    same = F.col("scope").eqNullSafe(F.col("__scope"))
    raw = terms.join(stats.select(F.col("scope").alias("__scope"), "n_docs"), same).select("scope", "term", idf(F.col("n_docs"), F.col("df")).alias("raw"))
    mean = raw.groupBy(F.col("scope").alias("__scope")).agg(F.avg("raw").alias("mean"))
    return raw.join(mean, same).select("scope", "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Index:
    """Postings, a row per tenant of statistics, and the weight of every term of every tenant."""

    postings: DataFrame
    stats: DataFrame
    weights: DataFrame

    @staticmethod
    def of(documents: DataFrame, tenant: str | None = None) -> Index:
        """Made in the shared folder; gone when the driver ends."""
        made = materialize(postings(documents, tenant), "postings")
        stats = materialize(corpus_statistics(made), "stats")
        return Index(made, stats, materialize(term_weights(term_statistics(made), stats), "weights"))

    def write(self, path: str) -> None:
        """Store the index under ``path``, a new folder."""
        for name in ("postings", "stats", "weights"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "stats", "weights")))


def search(documents: DataFrame, questions: DataFrame, top_k: int = 20, tenant: str | None = None, digits: int = 6) -> DataFrame:
    """(item_id, [tenant], doc_id, score, rank): the best ``top_k`` documents of each question (in each tenant), scores above 0 only.

    ``documents`` has doc_id, text; ``questions`` item_id, text. A repeated question term counts each time. Ties go to the smaller
    doc_id. Scores are rounded before ranking, so that ranks do not hang on the order of additions.
    """
    return search_index(Index.of(documents, tenant), questions, top_k, tenant, digits)


def _blocks(questions: DataFrame, scopes: int) -> Iterator[tuple[list, list[Counter]]]:
    """Questions in blocks of bounded weight; the driver holds one block."""
    ids, asked, terms = [], [], set()
    for row in questions.select("item_id", "text").toLocalIterator():
        found = Counter(_TOKEN.findall((row["text"] or "").lower()))
        if ids and (len(ids) == BLOCK or len(terms | found.keys()) * scopes > BLOCK_WEIGHTS):
            yield ids, asked
            ids, asked, terms = [], [], set()
        ids.append(row["item_id"]), asked.append(found), terms.update(found)
    if ids:
        yield ids, asked


def _best(scope: np.ndarray, item: np.ndarray, score: np.ndarray, doc: np.ndarray, top_k: int) -> np.ndarray:
    """Positions of the ``top_k`` best of each scope and item, by score and then doc_id."""
    order = np.lexsort((doc, -score, item, scope))
    s, i = scope[order], item[order]
    begins = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < top_k]


def search_index(index: Index, questions: DataFrame, top_k: int = 20, tenant: str | None = None, digits: int = 6) -> DataFrame:
    """``search`` over an index that was made before. Each block of questions is one pass over the postings."""
    spark = questions.sparkSession
    kinds = [(n, f.dataType) for n, f in (("item_id", questions.schema["item_id"]), ("scope", index.postings.schema["scope"]), ("doc_id", index.postings.schema["doc_id"]))] + [("score", T.DoubleType())]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    arrow = pa.schema([(n, to_arrow_type(k)) for n, k in kinds])
    stats = {r["scope"]: r["avgdl"] for r in index.stats.collect()}  # a row per tenant
    scopes, average = list(stats), np.array([stats[s] or 1.0 for s in stats], np.float64)
    path = scratch_path(spark, "bm25")
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, asked in _blocks(questions, max(1, len(scopes))):
        terms = sorted(set().union(*asked))
        if not terms or not scopes:
            continue
        wanted = materialize(spark.createDataFrame([(t,) for t in terms], "term string"), "asked")
        weight = np.zeros((len(scopes), len(terms)))
        place = {t: i for i, t in enumerate(terms)}, {s: i for i, s in enumerate(scopes)}
        for r in index.weights.join(wanted, "term", "left_semi").toLocalIterator():  # BLOCK_WEIGHTS rows at most, unless one question asks for more
            weight[place[1][r["scope"]], place[0][r["term"]]] = r["idf"]
        of_term = [[(i, n) for i, c in enumerate(asked) if (n := c[t])] for t in terms]
        first = np.concatenate([[0], np.cumsum([len(x) for x in of_term])])
        askers, times = (np.array([x[k] for xs in of_term for x in xs]) for k in (0, 1))
        block = spark.sparkContext.broadcast((ids, terms, scopes, average, weight, first, askers, times))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, terms, scopes, average, weight, first, askers, times = block.value
            known, numbers = pa.array(terms, pa.string()), {s: i for i, s in enumerate(scopes)}
            empty = np.empty(0, np.int64)
            held = [empty, empty, np.empty(0), None]
            for b in batches:
                if not b.num_rows:
                    continue
                lists = b.column("terms")
                term = pc.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                asked = np.flatnonzero(~np.isnan(term)) if term.dtype.kind == "f" else np.arange(len(term))
                term, owner, f = term[asked].astype(np.int64), owner[asked], b.column("counts").flatten().to_numpy()[asked]
                scope = np.array([numbers[s] for s in b.column("scope").to_pylist()], np.int64)
                dl = b.column("dl").to_numpy()
                docs = np.array(b.column("doc_id").to_pylist())
                part = weight[scope[owner], term] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[owner] / average[scope[owner]]))
                pairs = np.concatenate([[0], np.cumsum(first[term + 1] - first[term])])
                begin = 0
                while begin < len(term):  # whole documents, so that a score is summed at once
                    end = max(int(np.searchsorted(pairs, pairs[begin] + _PAIRS, "right")) - 1, begin + 1)
                    end = int(np.searchsorted(owner, owner[end - 1], "right"))
                    n = first[term[begin:end] + 1] - first[term[begin:end]]
                    at = np.repeat(first[term[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    key = np.repeat(owner[begin:end], n) * len(ids) + askers[at]
                    low = owner[begin] * len(ids)
                    total = np.round(np.bincount(key - low, np.repeat(part[begin:end], n) * times[at]), digits)
                    good = np.flatnonzero(total > 0)
                    row, item = (good + low) // len(ids), (good + low) % len(ids)
                    new = [scope[row], item, total[good], docs[row]]
                    held = [x if old is None or not len(old) else np.concatenate([old, x]) for old, x in zip(held, new, strict=True)]
                    if len(held[0]) > _KEPT + len(scopes) * len(ids) * top_k:
                        held = [x[keep] for keep in (_best(*held, top_k),) for x in held]
                    begin = end
            if len(held[0]):
                scope, item, score, doc = (x[keep] for keep in (_best(*held, top_k),) for x in held)
                columns = [[ids[i] for i in item.tolist()], [scopes[i] for i in scope.tolist()], doc.tolist(), score]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        best = index.postings.mapInArrow(run, schema)
        order = Window.partitionBy("item_id", "scope").orderBy(F.desc("score"), "doc_id")
        best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("rank").write.mode("append").parquet(path)
        block.destroy()
        discard(wanted)
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("item_id", "scope").orderBy(F.desc("score"), "doc_id")
    keys = ["item_id", *([F.col("scope").alias(tenant)] if tenant else []), "doc_id", "score", "rank"]
    return found.withColumn("rank", F.row_number().over(order).cast("long")).select(*keys)
