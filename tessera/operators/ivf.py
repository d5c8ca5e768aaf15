"""Nearest neighbours through an inverted file: vectors lie in cells around centroids, and a question reads the cells that it probes.

Centroids come from distributed k-means over directions, on a bounded sample; every vector is indexed, in the cell of its nearest centroid. Cells
are folders. A cell of many vectors is dealt over parts, so that no task holds a hot cell whole. A search probes the cells nearest to each question. If it is to
be exact, a second pass follows: no vector of a cell is nearer to a question than the angle to the cell's centroid less the
cell's radius, so only cells whose bound reaches the question's worst hit so far are read, and the rows are those of the full search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.dense import _best, _matrix, predicate
from tessera.runtime import materialize

#: Vectors that centroids are learned from at most, cells at most, and vectors of a part, about.
SAMPLE, MOST_CELLS, PART = 100_000, 4096, 50_000
#: The cell of vectors without a direction, whose cosine is 0 to everything.
NOWHERE = -1
_SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def centroids_of(vectors: DataFrame, cells: int | None = None, seed: int = 1) -> np.ndarray:
    """Unit vectors, a row for each cell; about the square root of the number of vectors where it is not given."""
    known = vectors.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    n = known.count()
    cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
    if not n or cells == 1:
        first = vectors.filter(F.col("embedding").isNotNull()).select("embedding").first()
        return _unit(np.ones((1, len(first[0]) if first else 1)))
    # the least digests are a sample that does not hang on the order of rows
    sample = known.orderBy(F.xxhash64("doc_id")).limit(SAMPLE) if n > SAMPLE else known
    features = materialize(sample.select(F.col("embedding").cast("array<double>").alias("x")), "sample").select(array_to_vector("x").alias("features"))
    fitted = KMeans(k=cells, maxIter=12, seed=seed, distanceMeasure="cosine").fit(features)
    return _unit(np.array(fitted.clusterCenters(), np.float64))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``vectors`` that have an embedding, with cell and angle to its centroid."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most
    names = [c for c in vectors.columns if c not in ("cell", "angle")]
    rows = vectors.select(*names).filter(F.col("embedding").isNotNull())
    schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column("embedding")))
            near = x @ held.value.T
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            cell[~x.any(1)] = NOWHERE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*names, "cell", "angle"])

    return rows.mapInArrow(run, schema)


class Cells:
    """An index under ``path``: vectors by cell and part, and a row for each cell."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.vectors = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS and one at most
        self.numbers = np.array([r["cell"] for r in rows], np.int64)
        self.radius = np.array([r["radius"] for r in rows], np.float64)
        self.parts = {r["cell"]: r["parts"] for r in rows}
        self.centroids = np.array([r["centroid"] for r in rows], np.float64) if rows else np.zeros((0, 1))

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
        """Index ``vectors`` (doc_id, embedding and whatever conditions will name) in a new folder."""
        spark = vectors.sparkSession
        centroids = centroids_of(vectors, cells)
        placed = materialize(assigned(vectors, centroids), "placed")
        counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row per cell
        parts = {r["cell"]: -(-r["n"] // PART) for r in counts}
        zero = [0.0] * centroids.shape[1]
        table = [(r["cell"], parts[r["cell"]], float(r["radius"]), zero if r["cell"] == NOWHERE else centroids[r["cell"]].tolist()) for r in counts]
        spark.createDataFrame(table, "cell int, parts int, radius double, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
        of = F.element_at(F.create_map(*(F.lit(x) for p in parts.items() for x in p)), F.col("cell")) if parts else F.lit(1)
        dealt = placed.drop("angle").withColumn("part", F.pmod(F.xxhash64("doc_id"), of).cast("int"))
        dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
        return Cells(spark, path, dealt.schema)

    def _probes(self, questions: DataFrame, probe: int) -> DataFrame:
        """(item_id, embedding, cell, part): the ``probe`` cells nearest to each question; where there is a column ``worst``, the cells beyond these whose bound reaches it."""
        spark, numbers, radius, centroids, parts = questions.sparkSession, self.numbers, self.radius, self.centroids, self.parts
        again = "worst" in questions.columns
        held = spark.sparkContext.broadcast((numbers, radius, centroids))
        schema = T.StructType([questions.schema["item_id"], questions.schema["embedding"], T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, radius, centroids = held.value
            for b in batches:
                if not b.num_rows or not len(numbers):
                    continue
                near = _unit(_matrix(b.column("embedding"))) @ centroids.T
                place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                if again:
                    bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))
                    bound[:, numbers == NOWHERE] = 0
                    worst = b.column("worst").to_numpy(zero_copy_only=False)
                    chosen = (place >= probe) & (bound >= worst[:, None] - _SLACK)
                else:
                    chosen = place < probe
                item, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(item)), b.column("embedding").take(pa.array(item)), pa.array(numbers[cell].astype(np.int32))], names=schema.names)

        columns = ["item_id", "embedding", *(["worst"] if again else [])]
        found = questions.filter(F.col("embedding").isNotNull()).select(*columns).mapInArrow(run, schema)
        n = F.element_at(F.create_map(*(F.lit(x) for p in parts.items() for x in p)), F.col("cell")) if parts else F.lit(1)
        return found.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))

    def _scan(self, probes: DataFrame, top_k: int, where: dict[str, Any] | None, digits: int) -> DataFrame:
        """(item_id, doc_id, score): each part's best for the questions that probe it. Only probed cells are read."""
        probes = materialize(probes, "probes")
        cells = [r["cell"] for r in probes.select("cell").distinct().collect()]  # as many as cells at most
        kept = self.vectors.filter(F.col("cell").isin(cells)).filter(predicate(where)).select("cell", "part", "doc_id", "embedding")
        schema = T.StructType([probes.schema["item_id"], self.vectors.schema["doc_id"], T.StructField("score", T.DoubleType())])

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema_table.slice(0, 0)
            x, unit = _matrix(left.column("embedding").combine_chunks()), _unit(_matrix(right.column("embedding").combine_chunks()))
            length = np.linalg.norm(x, axis=1)
            names = np.array(left.column("doc_id").to_pylist())
            items = right.column("item_id").to_pylist()
            owner, docs, scores = [], [], []
            for i in range(0, len(items), 256):
                near = np.round(unit[i : i + 256] @ x.T / np.where(length > 0, length, 1), digits) + 0.0
                first = _best(near, names, top_k)
                owner += [q for q in items[i : i + 256] for _ in range(first.shape[1])]
                docs += names[first].ravel().tolist()
                scores += np.take_along_axis(near, first, 1).ravel().tolist()
            return pa.table([pa.array(c, f.type) for c, f in zip((owner, docs, scores), schema_table.schema, strict=True)], schema=schema_table.schema)

        schema_table = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema]).empty_table()
        return kept.groupBy("cell", "part").cogroup(probes.groupBy("cell", "part")).applyInArrow(best, schema)

    def search(self, questions: DataFrame, top_k: int = 10, probe: int = 8, exact: bool = False, where: dict[str, Any] | None = None, digits: int = 6) -> DataFrame:
        """(item_id, doc_id, score, rank) by cosine, ties to the smaller doc_id, from the ``probe`` nearest cells of each question.

        ``exact`` gives the rows of ``dense.search``, however few cells are probed first. The condition is applied before ranking. Questions
        without a vector find nothing; fewer vectors than ``top_k`` give fewer rows.
        """
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        top = lambda found: found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_k)
        found = self._scan(self._probes(questions, probe), top_k, where, digits)
        if not exact:
            return top(found)
        first = materialize(top(found), "probed")
        worst = first.groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("item_id", F.when(F.col("n") == top_k, F.col("s")).otherwise(F.lit(-1.0)).alias("worst"))
        asked = questions.select("item_id", "embedding").join(worst, "item_id", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.0)))
        more = self._scan(self._probes(asked, probe), top_k, where, digits)
        return top(first.drop("rank").union(more))
