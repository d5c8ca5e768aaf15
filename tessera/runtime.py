"""Session settings, table loading, and the shared folder that cuts lineage."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch where the session keeps Spark's default; a worker holds a batch several times over.
ARROW_BYTES = "4194304b"


#: Spark's setting for what becomes of an action's shuffle files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster ``master`` and sizes come from spark-submit."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName("tessera").config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of ``sf_dir``, with whatever columns it has."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only where nothing is set and the session is local, as in tests, a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    current = context._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(named)
    elif not current.isDefined():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later reads neither repeat its work nor depend on an executor's local disk; the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them any more."""
    for table in tables:
        if path := getattr(table, "scratch", None):
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action in here are deleted when it ends; a lost stage would be run again, as always."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


_TENANT: ContextVar[str] = ContextVar("tenant", default="-")


class TenantFilter(logging.Filter):
    """Gives every record the tenant for whom the present work is done, as ``tenant``."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.tenant = _TENANT.get()
        return True


def configure_logging(level: int = logging.INFO) -> None:
    """One handler on the package's logger; calling it again changes the level only."""
    logger = logging.getLogger("tessera")
    logger.setLevel(level)
    if not any(isinstance(f, TenantFilter) for h in logger.handlers for f in h.filters):
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(tenant)s] %(name)s: %(message)s"))
        handler.addFilter(TenantFilter())
        logger.addHandler(handler)


@contextmanager
def tenant_log(spark: SparkSession, tenant: str, what: str) -> Iterator[None]:
    """Binds log records and the description of Spark jobs in here to a tenant."""
    context = spark.sparkContext
    before, token = context.getLocalProperty("spark.job.description"), _TENANT.set(tenant)
    context.setLocalProperty("spark.job.description", f"{tenant}: {what}")
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)
        _TENANT.reset(token)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed on them but its folder is visible, and keep their batches small."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Add ``name``, the dense number of each row by ``order`` from ``first`` on; rows equal in ``order`` are numbered as they come.

    Rows are sorted in ranges and numbered within them; a range's offset is the sum of the counts before it. No task holds more than a
    range, and only a row for each range is ordered as a whole.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    # the id holds the partition above bit 33 and the place within it below
    ranged = rows.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__place") + first).drop("__at", "__range", "__place", "__before")
