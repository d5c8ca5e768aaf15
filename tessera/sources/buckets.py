"""Tables that are merged folder by folder: rows lie by tenant and by a digest of their key, and a merge rewrites the folders of changed keys only.

Spark's dynamic partition overwrite does the writing. A key's rows are replaced as a whole, so a merge that is repeated changes nothing. A key
keeps a row at least (one that tells that nothing is left of it), as Spark leaves a folder alone that gets no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import discard, materialize


def number(text: Column, modulus: int) -> Column:
    """A digest of the text below ``modulus``; a null text counts as empty."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(modulus)).cast("int")


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table under ``path``; one without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class BucketedTable:
    """Rows with ``schema`` under ``path``, by ``tenant`` (a column) and ``bucket``, which is made of ``key`` (a column)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, tenant: str, key: str, buckets: int):
        self.spark, self.path, self.tenant, self.key, self.buckets = spark, path.rstrip("/"), tenant, key, buckets
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = T.StructType([*(f for f in kind if f.name not in (tenant, "bucket")), kind[tenant], T.StructField("bucket", T.IntegerType())])

    def rows(self) -> DataFrame:
        """All rows; none where nothing was written yet."""
        return read_or_none(self.spark, self.path, self.schema)

    def merge(self, changes: DataFrame) -> int:
        """Replace all rows of each (tenant, key) in ``changes``; returns how many folders were written. No changes write nothing."""
        new = materialize(changes.withColumn("bucket", number(F.col(self.key).cast("string"), self.buckets)).select(*self.schema.names), "changes")
        folders = [(r[0], r[1]) for r in new.select(self.tenant, "bucket").distinct().collect()]  # folders that Spark's writer lists too
        if folders:
            named = {t for t, _ in folders if t is not None}
            tenants = F.col(self.tenant).isin(list(named)) | (F.col(self.tenant).isNull() if any(t is None for t, _ in folders) else F.lit(False))
            touched = self.rows().filter(tenants & F.col("bucket").isin(sorted({b for _, b in folders})))  # folders are left out where they are listed
            same = lambda *names: [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
            keys = lambda *names: new.select(*(F.col(n).alias(f"__{n}") for n in names)).distinct()
            old = touched.join(keys(self.tenant, "bucket"), same(self.tenant, "bucket"), "left_semi").join(keys(self.tenant, self.key), same(self.tenant, self.key), "left_anti")
            whole = old.unionByName(new).repartition(self.tenant, "bucket").sortWithinPartitions(self.tenant, "bucket", self.key)
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.tenant, "bucket").parquet(self.path)
        discard(new)
        return len(folders)
