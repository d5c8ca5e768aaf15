"""Incremental job: cut new and changed documents into chunks, by tenant, ready to be indexed.

    spark-submit jobs/ingest_documents.py --config jobs/ingest_documents.json --documents PATH --chunks PATH --checkpoint PATH

PATH of the documents is a folder, or a pattern of files or folders. Files of documents (doc_id, text, source) are taken as a stream: each run takes the files that came since the last one, by the stream's
checkpoint, and ends. A document that is delivered again replaces its chunks as a whole; of several deliveries the one in the latest file counts. Chunks
lie in folders by tenant and by a digest of the doc_id, and only folders of delivered documents are written anew. A batch that is run again
after a failure gives the same table. Documents without text have one row with status ``empty`` and no chunk.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import main  # noqa: E402
from tessera.functions import text as fx  # noqa: E402
from tessera.sources.buckets import BucketedTable  # noqa: E402

log = logging.getLogger("jobs.ingest_documents")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "ingest_documents.json")
KNOWN = {"documents": "", "chunks": "", "checkpoint": "", "buckets": 16, "chunk_size": 512}
DOCUMENTS = "doc_id long, text string, source string"
CHUNKS = "doc_id long, chunk_index int, id string, status string, is_code boolean, n_terms int, text string, source string"


def table(spark: SparkSession, config: dict) -> BucketedTable:
    return BucketedTable(spark, config["chunks"], CHUNKS, "source", "doc_id", int(config["buckets"]))


def latest(delivered: DataFrame) -> DataFrame:
    """Of rows with one source and doc_id the one that was delivered last; of one time, that in the last file, then by a digest of the text."""
    order = Window.partitionBy("source", "doc_id").orderBy(F.desc("delivered"), F.desc("file"), F.desc(F.md5(F.coalesce("text", F.lit("")))))
    return delivered.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("doc_id", "text", "source")


def chunked(documents: DataFrame, size: int) -> DataFrame:
    """A row for each chunk, and one for each document without any."""
    whole = F.when(F.length("text") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.substring("text", i * size + 1, F.lit(size)).alias("text"))))
    rows = documents.select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.explode_outer(whole).alias("c"))
    filled = F.col("c").isNotNull()
    return rows.select(
        "doc_id", "c.chunk_index", F.when(filled, fx.chunk_id(F.col("sha256"), F.col("c.chunk_index"))).alias("id"), F.when(filled, "ok").otherwise("empty").alias("status"),
        F.when(filled, fx.is_code(F.col("c.text"))).alias("is_code"), F.when(filled, F.size(fx.search_tokens(F.col("c.text")))).alias("n_terms"), "c.text", "source",
    )


def run(spark: SparkSession, config: dict) -> dict:
    """Take what is new and wait until it is done; returns what was read and written."""
    done = {"batches": 0, "documents": 0, "folders": 0}
    size = int(config["chunk_size"])

    def batch(delivered: DataFrame, number: int) -> None:
        documents = latest(delivered)
        read, folders = delivered.count(), table(delivered.sparkSession, config).merge(chunked(documents, size))
        log.info("batch %d: read %d documents, wrote %d folders of %s", number, read, folders, config["chunks"])
        done["batches"] += 1
        done["documents"] += read
        done["folders"] += folders

    stream = spark.readStream.schema(DOCUMENTS).parquet(config["documents"])
    files = stream.select("doc_id", "text", "source", F.col("_metadata.file_modification_time").alias("delivered"), F.col("_metadata.file_path").alias("file"))
    files.writeStream.foreachBatch(batch).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start().awaitTermination()
    log.info("took %d documents in %d batches from %s", done["documents"], done["batches"], config["documents"])
    return done


def read(spark: SparkSession, config: dict) -> DataFrame:
    """The chunks as they stand."""
    return table(spark, config).rows()


if __name__ == "__main__":
    main("ingest_documents", CONFIG, KNOWN, ("documents", "chunks", "checkpoint"), run)
