"""Citations, context blocks and prompts from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that callers see.
NO_HIT_ANSWER = "I couldn't find any sufficiently relevant indexed content to answer this question."
CLOSING = "Answer using only the numbered context blocks above, with [n] citation markers."
RECENT_HEAD = "Recent conversation (for context only, not a source of facts):"
SNIPPET = 300
#: What a model is told before the prompt; a caller may pass its own.
SYSTEM_PROMPT = (
    "Answer from the numbered context blocks alone. Each block stands for itself; do not join blocks, causes or steps that no block "
    "states. Where the blocks do not answer the question, say that the documents do not cover it. Mark every statement with the [n] of its "
    "block. Earlier turns only tell what the question refers to; they are no source of facts."
)
CONDENSE_PROMPT = "Turn the follow-up question into one that can be understood without the conversation. Return that question and nothing else."


def citations(hits: DataFrame, rank: str = "rank", snippet: int | None = None) -> DataFrame:
    """(item_id, marker, source_path, page_number, chunk_text, score) from hits with text, source_path, page_number and scores.

    The score is that of the reranker, else of the fusion, else 0. A missing source is ``unknown``. With ``snippet``, the source is
    shown by its last path segment and the text cut to so many characters, as a reader sees it.
    """
    scores = [F.col(c) for c in ("rerank_score", "rrf_score") if c in hits.columns]
    source = F.coalesce(F.col("source_path"), F.lit("unknown"))
    text = F.col("text")
    if snippet is not None:
        source, text = F.element_at(F.split(source, "/"), -1), F.substring(text, 1, snippet)
    return hits.select(
        "item_id", F.col(rank).cast("int").alias("marker"), source.alias("source_path"), "page_number", text.alias("chunk_text"), F.coalesce(*scores, F.lit(0.0)).alias("score")
    )


def context_block(marker: Column, source: Column, page: Column, text: Column) -> Column:
    where = F.concat(F.lit("] (source: "), source, F.coalesce(F.concat(F.lit(", page "), page.cast("string")), F.lit("")), F.lit(")\n"))
    return F.concat(F.lit("["), marker.cast("string"), where, text)


def contexts(cited: DataFrame) -> DataFrame:
    """(item_id, context): a question's blocks in order of their markers, joined by line feeds. A question has a few citations."""
    block = context_block(F.col("marker"), F.col("source_path"), F.col("page_number"), F.col("chunk_text"))
    blocks = F.array_sort(F.collect_list(F.struct(F.col("marker"), block.alias("block"))))
    return cited.groupBy("item_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n").alias("context"))


def prompt(context: Column, question: Column, recent: Column | None = None) -> Column:
    """The generation prompt; ``recent`` is the text of recent turns, or null."""
    parts = [F.concat(F.lit(RECENT_HEAD + "\n"), recent, F.lit("\n"))] if recent is not None else []
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Context:\n\n"), context), F.concat(F.lit("Question: "), question), F.lit(CLOSING))


def answers(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """(item_id, answer): what was generated, or the fixed answer for questions without hits."""
    return questions.select("item_id").join(generated, "item_id", "left").select("item_id", F.coalesce("answer", F.lit(NO_HIT_ANSWER)).alias("answer"))
