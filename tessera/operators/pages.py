"""Pages of documents: characters to lines to markdown, page choice, scanned pages, and page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

#: Fixed values of page analysis.
HEADING_RATIO, HEADING_LENGTH, CODE_SHARE = 1.15, 120, 0.7
MONOSPACE = "mono|courier|consolas|menlo|code"
LEAST_CHARS, SCANNED_SHARE, BODY_PAGES, DEFAULT_SIZE = 20, 0.5, 20, 10.0


def body_sizes(chars: DataFrame) -> DataFrame:
    """(doc_id, body_size): the exact median of rounded character sizes over the first pages."""
    return chars.filter(F.col("page") <= BODY_PAGES).groupBy("doc_id").agg(F.coalesce(F.percentile(F.bround("size", 1), 0.5), F.lit(DEFAULT_SIZE)).alias("body_size"))


def lines(chars: DataFrame) -> DataFrame:
    """(doc_id, page, line_top, text, mean_size, code_share): characters grouped by rounded height, in order of x0 and ord.

    A line's characters come together, no more than a page's width of them.
    """
    parts = F.array_sort(F.collect_list(F.struct("x0", "ord", "text")))
    mono = F.coalesce(F.lower("fontname").rlike(MONOSPACE), F.lit(False)).cast("double")
    return chars.groupBy("doc_id", "page", F.bround("top", 1).alias("line_top")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.avg("size").alias("mean_size"), F.avg(mono).alias("code_share")
    )


def page_markdown(chars: DataFrame) -> DataFrame:
    """(doc_id, page, markdown): headings marked, runs of code lines fenced, blank lines skipped."""
    shown = lines(chars).filter(strip(F.col("text")) != "").join(body_sizes(chars), "doc_id", "left")
    heading = (F.col("mean_size") >= HEADING_RATIO * F.coalesce("body_size", F.lit(DEFAULT_SIZE))) & (F.length(strip(F.col("text"))) < HEADING_LENGTH)
    order = Window.partitionBy("doc_id", "page").orderBy("line_top")
    marked = shown.withColumn("heading", heading).withColumn("code", ~F.col("heading") & (F.col("code_share") > CODE_SHARE))
    opens = F.col("code") & ~F.coalesce(F.lag("code").over(order), F.lit(False))
    closes = F.col("code") & ~F.coalesce(F.lead("code").over(order), F.lit(False))
    body = F.when(F.col("code"), F.col("text")).otherwise(strip(F.col("text")))
    out = F.concat(F.when(opens, "```\n").otherwise(""), F.when(F.col("heading"), "## ").otherwise(""), body, F.when(closes, "\n```").otherwise(""))
    done = marked.withColumn("out", out)
    ordered = F.array_sort(F.collect_list(F.struct("line_top", "out")))
    return done.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "\n").alias("markdown"))


def better_page(structured: Column, plain: Column) -> Column:
    """The structured text unless the plain one has more to show."""
    return F.when(F.length(strip(structured)) >= F.length(strip(plain)), structured).otherwise(plain)


def page_flags(pages: DataFrame) -> DataFrame:
    """Add char_count and is_likely_scanned to pages with a text."""
    count = F.length(strip(F.coalesce("text", F.lit(""))))
    return pages.withColumn("char_count", count).withColumn("is_likely_scanned", F.col("char_count") < LEAST_CHARS)


def scanned_documents(flagged: DataFrame) -> DataFrame:
    """(doc_id, page_count, scanned_page_count, is_scanned)."""
    scanned = F.col("is_likely_scanned").cast("int")
    return flagged.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(scanned).alias("scanned_page_count"), (F.avg(scanned) > SCANNED_SHARE).alias("is_scanned"))


def marked_document(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): each page after its marker, blank lines between; empty pages leave their marker."""
    text = strip(F.coalesce("text", F.lit("")))
    part = F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->"), F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page"), part.alias("part"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("markdown"))


def lines_as_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page, text): every line of a text as a page, from 1."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")
