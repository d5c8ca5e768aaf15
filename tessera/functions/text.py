"""Text expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates pages in clean text.
PAGE_MARKER = r"<!--\s*page:(\d+)\s*-->"
#: Fixed value: a fenced block.
FENCE = r"(?s)```.*?```"
#: Fixed value: the instruction that some encoders want before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (of any kind, unlike trim)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hash_embedding(text: Column, width: int = 16) -> Column:
    """A deterministic stand-in for an encoder: the first bytes of the text's SHA-256 as shares of 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0))


def query_text(question: Column, model: str) -> Column:
    """What is encoded for a question: models of the bge family want an instruction first."""
    return F.concat(F.lit(QUERY_PREFIX), question) if "bge" in model.lower() else question


def chunk_id(file_sha256: Column, index: Column) -> Column:
    return F.concat_ws(":", file_sha256, index.cast("string"))


def cache_key(*parts: Column) -> Column:
    """24 hexadecimal digits naming a request; a missing part counts as the word None."""
    return F.substring(F.sha2(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, 24)


def valid_tenant_id(tenant: Column) -> Column:
    return F.coalesce(tenant.rlike(r"\A[a-z0-9_-]+\z"), F.lit(False))


def avatar_bucket(tenant: Column, colours: int = 4) -> Column:
    """Sum of code points modulo the number of colours."""
    points = F.transform(F.split(tenant, ""), F.ascii)
    return (F.aggregate(points, F.lit(0), lambda a, x: a + x) % colours).cast("int")


def initials(name: Column) -> Column:
    """First letters of the first two words, upper-cased."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def is_code(text: Column) -> Column:
    piece = strip(text)
    return piece.startswith("```") & piece.endswith("```")
