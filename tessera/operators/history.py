"""The question log of each tenant: list, search, star, delete, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import numbered

CITATIONS = "array<struct<marker:int,source:string,page:int,snippet:string,score:double>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _like(text: Column, pattern: Column) -> Column:
    """LIKE that ignores the case of A-Z only and knows no escape character."""
    fold = lambda c: F.translate(c, UPPER, LOWER)
    return F.like(fold(text), F.replace(fold(pattern), F.lit("\x01"), F.lit("\x01\x01")), F.lit("\x01"))


def entries(history: DataFrame, company_id: str, search: str | None = None, limit: int | None = 50) -> DataFrame:
    """A tenant's entries, latest first (then by id); ``%`` and ``_`` in ``search`` are wildcards."""
    rows = history.filter(F.col("company_id") == company_id)
    if search:
        pattern = F.lit(f"%{search}%")
        rows = rows.filter(_like(F.col("question"), pattern) | _like(F.col("answer"), pattern))
    ordered = rows.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def matching(history: DataFrame, search: str) -> DataFrame:
    """Entries of all tenants that match, unordered."""
    pattern = F.lit(f"%{search}%")
    return history.filter(_like(F.col("question"), pattern) | _like(F.col("answer"), pattern))


def append(history: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (company_id, question, answer, citations, created_at) with ids that follow the largest one, unstarred.

    New entries are numbered in order of created_at, then tenant and question.
    """
    top = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = numbered(new, ["created_at", "company_id", "question"], "n", 1).select("n", "company_id", "question", "answer", F.to_json("citations").alias("citations_json"), "created_at")
    placed = rows.crossJoin(F.broadcast(top))  # one row
    return history.unionByName(placed.select((F.col("n") + F.col("top")).cast("long").alias("id"), "company_id", "question", "answer", "citations_json", F.lit(0).alias("starred"), "created_at"))


def toggle_star(history: DataFrame, entry: Column) -> DataFrame:
    """``entry`` tells which rows change."""
    return history.withColumn("starred", F.when(entry, 1 - F.col("starred")).otherwise(F.col("starred")))


def delete(history: DataFrame, entry: Column) -> DataFrame:
    return history.filter(~F.coalesce(entry, F.lit(False)))


def decoded(history: DataFrame) -> DataFrame:
    """citations_json as an array, starred as a boolean, and the number of sources."""
    cited = F.from_json("citations_json", CITATIONS)
    return history.withColumn("citations", cited).withColumn("starred", F.col("starred") == 1).withColumn("n_sources", F.coalesce(F.size("citations"), F.lit(0))).drop("citations_json")
