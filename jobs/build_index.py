"""Nightly job: build each tenant's search index from the documents, as blocks in folders by tenant and bucket of terms.

    spark-submit jobs/build_index.py --config jobs/build_index.json --documents PATH --index PATH

A rerun replaces the folders of the tenants that it reads, each as a whole, and gives the same blocks; tenants that are in the index but
not in the input stay. Questions are asked of it with ``tessera.operators.inverted.search``.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import main  # noqa: E402
from tessera.operators import inverted  # noqa: E402

log = logging.getLogger("jobs.build_index")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "build_index.json")
KNOWN = {"documents": "", "index": "", "tenant": "source", "buckets": inverted.BUCKETS}


def run(spark: SparkSession, config: dict) -> dict:
    """Build the index that ``config`` names; returns what was read and written."""
    documents = spark.read.parquet(config["documents"])
    inverted.store(inverted.build(documents, config["tenant"], int(config["buckets"])), config["index"])
    tenants = documents.groupBy(config["tenant"]).agg(F.count("*").alias("n")).collect()  # a row per tenant
    log.info("read %d documents of %d tenants from %s", sum(r["n"] for r in tenants), len(tenants), config["documents"])
    done = read(spark, config["index"]).agg(F.count("*").alias("blocks"), F.sum("n").alias("postings")).first()
    log.info("wrote to %s, which holds %d blocks with %d postings", config["index"], done["blocks"], done["postings"] or 0)
    return {"documents": sum(r["n"] for r in tenants), "tenants": len(tenants), "blocks": done["blocks"], "postings": done["postings"] or 0}


def read(spark: SparkSession, index: str) -> DataFrame:
    """The index as it stands."""
    return inverted.stored(spark, index)


if __name__ == "__main__":
    main("build_index", CONFIG, KNOWN, ("documents", "index"), run)
