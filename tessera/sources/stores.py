"""Bookkeeping files: the append-only manifest, checkpoints, the tenant registry, clean markdown, and the discovery of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.manifest import STATUSES, latest
from tessera.runtime import materialize, numbered
from tessera.sources.vector_store import check_tenant
from tessera.sources.versions import Versions

MANIFEST = T.StructType([
    T.StructField("source_path", T.StringType()), T.StructField("file_sha256", T.StringType()), T.StructField("clean_path", T.StringType()),
    T.StructField("company_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("page_count", T.IntegerType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("extractor_used", T.StringType()),
    T.StructField("processed_at", T.StringType()), T.StructField("seq", T.LongType()),
])
COMPANY = T.StructType([
    T.StructField("company_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("config_path", T.StringType()),
    T.StructField("data_path", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("last_ingestion", T.StringType()),
    T.StructField("total_pdfs", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()),
])


def discover(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(path, content, length, source_no) of the files of each (folder, pattern) that exists, sorted within each source by path.

    Missing folders are left out; a file that two sources name comes twice.
    """
    jvm, found = spark.sparkContext._jvm, None
    for number, (folder, pattern) in enumerate(sources):
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).withColumn("source_no", F.lit(number))
        found = files if found is None else found.union(files)
    if found is None:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary, source_no int")
    return found.orderBy("source_no", "path")


def file_digests(files: DataFrame) -> DataFrame:
    """(source_path, current_sha256) of discovered files."""
    return files.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("current_sha256"))


def append_manifest(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; ``seq`` (their order) is theirs to bring, since files have no order of lines across parts."""
    entries.select(*(F.col(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST)).write.mode("append").json(path)


def manifest_log(spark: SparkSession, path: str) -> DataFrame:
    """Every readable line: blank and corrupt ones, and ones without a path or a known status, are passed over."""
    lines = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path)
    return lines.filter(F.col("source_path").isNotNull() & F.col("status").isin(*STATUSES))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return latest(manifest_log(spark, path))


def compact_manifest(spark: SparkSession, path: str) -> None:
    """Leave the last entry of each path only."""
    kept = materialize(load_manifest(spark, path), "manifest")
    kept.write.mode("overwrite").json(path)


CHECKPOINT = "path string, state string, updated_at string"


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(path, state, updated_at) as last saved; empty where nothing was saved or the last save broke off before any was complete."""
    found = Versions(spark, path).current()
    return spark.read.schema(CHECKPOINT).json(f"{found}/states").filter(F.col("path").isNotNull() & F.col("state").isNotNull()) if found else spark.createDataFrame([], CHECKPOINT)


def save_checkpoint(states: DataFrame, path: str) -> None:
    """Save (path, state) with the time, as a new version."""
    rows = states.select("path", "state", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"))
    Versions(states.sparkSession, path).write(lambda folder: rows.write.json(f"{folder}/states"))


def write_clean(documents: DataFrame, path: str) -> None:
    """Markdown under its file's digest: (file_sha256, markdown), one partition folder a digest prefix."""
    documents.withColumn("prefix", F.substring("file_sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a registry file {"version": 1, "companies": {id: record}}; a corrupt or missing one is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], COMPANY)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.StructType([T.StructField("companies", T.MapType(T.StringType(), COMPANY))])).alias("r"))
    rows = whole.select(F.explode(F.col("r.companies")).alias("id", "row"))
    return rows.select("row.*").filter(F.col("company_id").isNotNull())


def save_registry(registry: DataFrame, path: str) -> None:
    """A registry has tens of rows; they are written as one JSON document, in order of id."""
    rows = F.map_from_entries(F.array_sort(F.collect_list(F.struct("company_id", F.struct(*COMPANY.names)))))
    registry.agg(F.to_json(F.struct(F.lit(1).alias("version"), rows.alias("companies"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def add_company(registry: DataFrame, company_id: str, name: str, data_root: str = "data/companies") -> DataFrame:
    check_tenant(company_id)
    if not registry.filter(F.col("company_id") == company_id).isEmpty():
        raise ValueError(f"company {company_id} exists")
    row = registry.sparkSession.range(1).select(
        F.lit(company_id).alias("company_id"), F.lit(name).alias("name"), F.lit(f"configs/{company_id}.yaml").alias("config_path"), F.lit(f"{data_root}/{company_id}").alias("data_path"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.lit(None).cast("string").alias("last_ingestion"), F.lit(0).alias("total_pdfs"), F.lit(0).alias("total_chunks"),
    )
    return registry.unionByName(row)


def get_company(registry: DataFrame, company_id: str) -> T.Row:
    found = registry.filter(F.col("company_id") == company_id).head(1)
    if not found:
        raise KeyError(company_id)
    return found[0]


def remove_company(registry: DataFrame, company_id: str) -> DataFrame:
    get_company(registry, company_id)
    return registry.filter(F.col("company_id") != company_id)


def update_stats(registry: DataFrame, stats: DataFrame, when: str) -> DataFrame:
    """Totals of ``stats`` (company_id, total_pdfs, total_chunks) and the time of ingestion, for companies in it."""
    new = stats.select("company_id", F.col("total_pdfs").cast("int").alias("__p"), F.col("total_chunks").cast("int").alias("__c"))
    joined = registry.join(new, "company_id", "left")
    return joined.select(
        *COMPANY.names[:5], F.when(F.col("__p").isNotNull(), when).otherwise(F.col("last_ingestion")).alias("last_ingestion"),
        F.coalesce("__p", "total_pdfs").alias("total_pdfs"), F.coalesce("__c", "total_chunks").alias("total_chunks"),
    )


def next_seq(log: DataFrame, new: DataFrame) -> DataFrame:
    """Number new entries after the log's last, in order of their path."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    return numbered(new, ["source_path"], "__n", 1).crossJoin(F.broadcast(top)).withColumn("seq", (F.col("__n") + F.col("top")).cast("long")).drop("__n", "top")  # ``top`` is one row
