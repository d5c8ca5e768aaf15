"""The question-answering plan: a batch of questions, searched, fused, reranked, cited and answered in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions.services import NO_KEY
from tessera.functions.text import hash_embedding
from tessera.operators import bm25, conversation, dense, fusion, prompt
from tessera.runtime import materialize


@dataclass
class HybridRetriever:
    """Documents (doc_id, text, ...) and their vectors (doc_id, embedding, ...). ``where`` applies to both sides before ranking.

    ``index`` is a stored BM25 index of the documents; it serves questions without a condition, others get one of the documents that
    fit. Questions without a vector are searched by words alone.
    """

    documents: DataFrame
    vectors: DataFrame
    top_k_dense: int = 20
    top_k_bm25: int = 20
    top_k_final: int = 5
    rrf_k: int = fusion.RRF_K
    use_bm25: bool = True
    index: bm25.Index | None = None

    def search(self, questions: DataFrame, where: dict[str, Any] | None = None) -> DataFrame:
        """(item_id, doc_id, dense_rank, bm25_rank, rrf_score, rank) for questions (item_id, text, embedding)."""
        near = dense.search(self.vectors, questions, self.top_k_dense, where)
        if self.use_bm25:
            index = self.index if self.index and not where else bm25.Index.of(self.documents.filter(dense.predicate(where)))
            words = bm25.search_index(index, questions, self.top_k_bm25)
        else:
            words = near.select("item_id", "doc_id", "rank").filter(F.lit(False))
        return fusion.reciprocal_rank_fusion(near, words, self.top_k_final, rrf_k=self.rrf_k)


@dataclass
class QAPipeline:
    """``score`` compares question and text (columns question, text), ``generate`` makes an answer of a prompt, ``condense`` a question of a
    condensing prompt, ``embed`` a vector of a text; all map Columns to Columns, a model in batches as a Pandas UDF (see models)."""

    retriever: HybridRetriever
    score: Callable[[Column, Column], Column] | None = fusion.lexical_score
    generate: Callable[[Column], Column] = lambda prompt: F.concat(F.lit("echo:"), F.sha2(prompt, 256))
    rerank_top_k: int = 5
    max_score_gap: float | None = 6.0
    condense: Callable[[Column], Column] = lambda prompt: F.lit(None).cast("string")
    embed: Callable[[Column], Column] = hash_embedding
    condense_turns: int = 3
    generation_turns: int = 1

    def served(self, name: str, service: Callable[[str], Callable]) -> QAPipeline:
        """The same with a language service that answers and condenses, each told its own task.

        ``service`` makes a loader of what the model is told, as ``lambda system: services.chat(url, model, key, system)``. Where a key is missing
        the question stays as it was asked.
        """
        rewrite = models.generator(f"{name}/condense", service(prompt.CONDENSE_PROMPT))
        return replace(self, generate=models.generator(f"{name}/answer", service(prompt.SYSTEM_PROMPT)), condense=lambda text: F.nullif(rewrite(text), F.lit(NO_KEY)))

    def hits(self, questions: DataFrame, where: dict[str, Any] | None = None) -> DataFrame:
        """Ranked hits with text, source_path and page_number; the gap filter follows a reranker only."""
        found = self.retriever.search(questions, where).join(self.retriever.documents, "doc_id")
        if self.score is None:
            return found.filter(F.col("rank") <= self.rerank_top_k).withColumn("place", F.col("rank"))
        asked = found.join(questions.select("item_id", F.col("text").alias("question")), "item_id")
        ranked = fusion.rerank(asked, self.score(F.col("question"), F.col("text")), self.rerank_top_k)
        return fusion.score_gap(ranked, self.max_score_gap).withColumn("place", F.col("rerank_rank"))

    def with_history(self, questions: DataFrame, messages: DataFrame) -> DataFrame:
        """Questions (item_id, text, conv_id, turn, ...) with asked (as it stood), text (made to stand alone), recent and has_history.

        ``messages`` has conv_id, turn, role, text; a question's history are the answered questions of its conversation before its turn.
        A question without history is not rewritten; one that is gets a new vector.
        """
        told = conversation.turns_before(messages, questions.select("item_id", "conv_id", "turn"), max(self.condense_turns, self.generation_turns))
        rows = questions.join(told, "item_id", "left").withColumn("asked", F.col("text"))
        shown = lambda turns, q, a: conversation.told(F.col("turns"), turns, q, a)
        rows = rows.withColumn("recent", shown(self.generation_turns, "Previous Q", "Previous A")).withColumn("has_history", F.col("turns").isNotNull())
        ask = conversation.condense_text(shown(self.condense_turns, "Q", "A"), F.col("asked"))
        rows = rows.withColumn("text", F.when(F.col("has_history"), conversation.condensed(F.col("asked"), self.condense(ask))).otherwise(F.col("asked")))
        vector = F.when(F.col("text") == F.col("asked"), F.col("embedding")).otherwise(self.embed(F.col("text")).cast(questions.schema["embedding"].dataType))
        return materialize(rows.withColumn("embedding", vector).drop("turns"), "asked")

    def answer(self, questions: DataFrame, where: dict[str, Any] | None = None, messages: DataFrame | None = None) -> DataFrame:
        """(item_id, answer, citations, standalone) for every question; those without hits get the fixed answer and no citations.

        With ``messages``, questions have conv_id and turn: they are searched as they stand alone, the prompt shows the question as asked
        and the last turns. ``standalone`` is the rewritten question, null where it was not rewritten.
        """
        if messages is not None:
            questions = self.with_history(questions, messages)
        else:
            questions = questions.withColumns({"asked": F.col("text"), "recent": F.lit(None).cast("string")})
        cited = prompt.citations(self.hits(questions, where), "place")
        context = prompt.contexts(cited).join(questions.select("item_id", "asked", "recent"), "item_id")
        made = context.select("item_id", self.generate(prompt.prompt(F.col("context"), F.col("asked"), F.col("recent"))).alias("answer"))
        listed = cited.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("marker", "source_path", "page_number", "chunk_text", "score"))).alias("citations"))
        answered = prompt.answers(questions, made).join(listed, "item_id", "left")
        return answered.join(questions.select("item_id", conversation.standalone(F.col("asked"), F.col("text")).alias("standalone")), "item_id")
