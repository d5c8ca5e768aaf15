"""Chunks with vectors as Parquet tables, one for each tenant in versions. A tenant must be named for every read and write."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.dense import predicate, search
from tessera.sources.versions import Versions

SCHEMA = (
    "id string, embedding array<float>, document string, source_path string, page_number int, chunk_index int, is_code boolean, "
    "file_sha256 string, seq long, company_id string"
)
_TENANT = re.compile(r"[a-z0-9_-]+")


def check_tenant(company_id: str) -> str:
    if not isinstance(company_id, str) or not _TENANT.fullmatch(company_id):
        raise ValueError(f"not a tenant id: {company_id!r}")
    return company_id


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of both, the one with the largest ``order`` for each key."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("__n", F.row_number().over(place)).filter("__n = 1").drop("__n")


def without_ids(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti")


def without_sources(old: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of none of the given source paths; rows without a source stay."""
    return old.join(sources.select("source_path"), "source_path", "left_anti")


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, company_id: str):
        self.spark, self.path, self.company_id = spark, path.rstrip("/"), check_tenant(company_id)

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/company_id={self.company_id}")

    def rows(self) -> DataFrame:
        """This tenant's last complete version only; an empty table where nothing was written."""
        found = self.versions.current()
        if found is None:
            return self.spark.createDataFrame([], SCHEMA)
        fields = SCHEMA.rsplit(",", 1)[0]
        return self.spark.read.schema(fields).parquet(f"{found}/rows").withColumn("company_id", F.lit(self.company_id))

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows``, which may be read from this table, its next version; one that breaks off leaves the table as it was."""
        self.versions.write(lambda folder: rows.drop("company_id").write.parquet(f"{folder}/rows"))

    def upsert(self, new: DataFrame) -> None:
        if not new.isEmpty():
            self.replace(upserted(self.rows(), new.withColumn("company_id", F.lit(self.company_id)).select(*self.rows().columns)))

    def delete(self, ids: list[str]) -> None:
        if ids:
            self.replace(without_ids(self.rows(), self.spark.createDataFrame([(i,) for i in ids], "id string")))

    def delete_by_source(self, source_path: str) -> None:
        self.replace(without_sources(self.rows(), self.spark.createDataFrame([(source_path,)], "source_path string")))

    def documents(self) -> DataFrame:
        """id, document and metadata of every chunk; the vector column is not read."""
        return self.rows().drop("embedding")

    def count(self) -> int:
        return self.rows().count()

    def query(self, questions: DataFrame, top_k: int = 10, where: dict[str, Any] | None = None) -> DataFrame:
        """(item_id, doc_id, score, rank, distance) by cosine for questions (item_id, embedding)."""
        rows = self.rows().filter(predicate(where)).select(F.col("id").alias("doc_id"), "embedding")
        return search(rows, questions, top_k).withColumn("distance", 1 - F.col("score"))

    def wipe(self) -> None:
        self.versions.wipe()
