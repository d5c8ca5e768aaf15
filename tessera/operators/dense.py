"""Exact nearest neighbours by cosine: a stated set of questions against all vectors, in blocks.

Each partition multiplies its vectors with a block of questions and keeps its own best; only these few rows per
question and partition are shuffled and ranked. The questions are held in blocks of a fixed size, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.runtime import scratch_path

#: Questions that are multiplied at once; each block is one pass over the vectors.
BLOCK = 4096


def predicate(where: dict[str, Any] | None) -> Column:
    """A metadata condition as a Column: {"field": value}, {"field": {"$gt": x}}, {"$and": [...]}, {"$or": [...]}."""
    if not where:
        return F.lit(True)
    compare = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~c.isin(v),
    }
    out = F.lit(True)
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [predicate(x) for x in value]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & joined
        elif isinstance(value, dict):
            for op, x in value.items():
                if op not in compare:
                    raise ValueError(f"unknown operator {op}")
                out = out & compare[op](F.col(key), x)
        else:
            out = out & (F.col(key) == value)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; nulls must be gone."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _blocks(questions: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Questions that have a vector; the driver holds one block."""
    ids, vectors = [], []
    for row in questions.select("item_id", "embedding").filter(F.col("embedding").isNotNull()).toLocalIterator():
        ids.append(row["item_id"]), vectors.append(row["embedding"])
        if len(ids) == BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """[questions, k]: columns of the best by (score descending, id)."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]


def search(vectors: DataFrame, questions: DataFrame, top_k: int = 10, where: dict[str, Any] | None = None, digits: int = 6) -> DataFrame:
    """(item_id, doc_id, score, rank): the ``top_k`` vectors of highest cosine for each question; ties go to the smaller doc_id.

    ``vectors`` has doc_id, embedding and whatever ``where`` names; ``questions`` item_id, embedding. The condition is applied before
    ranking. Fewer vectors than ``top_k`` give fewer rows; a zero vector scores 0; what has no vector neither asks nor is found.
    Each block of questions is one pass over the vectors, whose best rows are appended to a table in the shared folder.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("item_id", questions.schema["item_id"].dataType), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    kept = vectors.filter(predicate(where)).filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    path = scratch_path(spark, "dense")
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, matrix in _blocks(questions):
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        block = spark.sparkContext.broadcast((ids, matrix / np.where(norms > 0, norms, 1)))  # BLOCK vectors at most

        def best(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, unit = block.value
            scores, docs = np.empty((len(ids), 0)), None
            for b in batches:
                if not b.num_rows:
                    continue
                x, names = _matrix(b.column("embedding")), np.array(b.column("doc_id").to_pylist())
                length = np.linalg.norm(x, axis=1)
                new = np.round(unit @ x.T / np.where(length > 0, length, 1), digits) + 0.0
                first = _best(new, names, top_k)
                scores = np.concatenate([scores, np.take_along_axis(new, first, 1)], axis=1)
                docs = names[first] if docs is None else np.concatenate([docs, names[first]], axis=1)
                order = np.array([np.lexsort((d, -s))[:top_k] for s, d in zip(scores, docs, strict=True)])
                scores, docs = np.take_along_axis(scores, order, 1), np.take_along_axis(docs, order, 1)
            if docs is not None:
                owner = [i for i in ids for _ in range(scores.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((owner, docs.ravel().tolist(), scores.ravel()), arrow, strict=True)], schema=arrow)

        kept.mapInArrow(best, schema).write.mode("append").parquet(path)
        block.destroy()
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_k)
