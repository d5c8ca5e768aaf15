import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import bm25, dense, fusion, prompt
from tessera.plans.retrieval import HybridRetriever, QAPipeline


def _hits(spark, scores):
    rows = [(1, i, i + 1, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "item_id long, doc_id int, rank int, rerank_score double")


@pytest.mark.parametrize(
    "scores, gap, kept",
    [([3.5, -8.2], 6.0, 1), ([-7.630, -8.724, -11.307, -11.341, -11.355], 6.0, 5), ([-20.0], 6.0, 1), ([3.5, -8.2], None, 2), ([3.5, -8.2], 15.0, 2)],
)
def test_score_gap(spark, scores, gap, kept):
    assert fusion.score_gap(_hits(spark, scores), gap).count() == kept


def _brute_bm25(docs, question, k):
    tok = lambda t: re.findall("[a-z0-9]+", t.lower())
    bodies = {d: tok(t) for d, t in docs}
    n, avgdl = len(bodies), sum(map(len, bodies.values())) / len(bodies)
    df = Counter(t for b in bodies.values() for t in set(b))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = []
    for d, b in bodies.items():
        f = Counter(b)
        s = sum(idf.get(t, 0) * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(b) / avgdl)) for t in tok(question) if f[t])
        if round(s, 6) > 0:
            out.append((round(s, 6), d))
    return [(d, s) for s, d in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


DOCS = [(1, "deploy the service"), (2, "rollback the service now"), (3, "the é café deploy deploy"), (4, ""), (5, "x y z"), (6, "the the the")]


@pytest.mark.parametrize("question", ["deploy service", "rollback rollback", "the", "nothing here", "x", ""])
@pytest.mark.parametrize("n", [1, 2, 6])
def test_bm25_against_brute_force(spark, question, n):
    docs = spark.createDataFrame(DOCS[:n], "doc_id long, text string")
    asked = spark.createDataFrame([(9, question)], "item_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in bm25.search(docs, asked, 3).orderBy("rank").collect()]
    assert got == _brute_bm25(DOCS[:n], question, 3)


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "a")], "item_id long, text string")
    assert bm25.search(docs, asked).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert bm25.search(blank, asked).count() == 0


def test_bm25_statistics_are_per_tenant(spark):
    rows = [(1, "a", "deploy"), (2, "a", "other words"), (3, "a", "more words"), (4, "b", "deploy"), (5, "b", "deploy")]
    docs = spark.createDataFrame(rows, "doc_id long, company_id string, text string")
    asked = spark.createDataFrame([(1, "deploy")], "item_id long, text string")
    found = bm25.search(docs, asked, 5, tenant="company_id").collect()
    assert {r["doc_id"] for r in found if r["company_id"] == "a"} == {1}
    alone = bm25.search(docs.filter("company_id = 'a'").drop("company_id"), asked, 5).first()
    assert alone["score"] == next(r["score"] for r in found if r["doc_id"] == 1)


def test_dense_ties_and_short_collections(spark):
    vectors = spark.createDataFrame([(2, [1.0, 0.0], 1), (1, [2.0, 0.0], 2), (3, [0.0, 0.0], 3)], "doc_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "item_id long, embedding array<float>")
    got = [(r["doc_id"], r["score"], r["rank"]) for r in dense.search(vectors, asked, 5).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
    assert {r["doc_id"] for r in dense.search(vectors, asked, 5, {"$or": [{"label": 1}, {"label": {"$in": [3]}}]}).collect()} == {2, 3}
    with pytest.raises(ValueError):
        dense.predicate({"label": {"$near": 1}})


def test_fusion_order_on_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "item_id long, doc_id string, rank long")
    got = fusion.reciprocal_rank_fusion(ranked(["a", "b"]), ranked(["c", "a"]), None).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "c", "b"]
    assert got[0]["rrf_score"] == 1 / 61 + 1 / 62
    same = fusion.reciprocal_rank_fusion(ranked(["a"]), ranked(["b"]), None).orderBy("rank").collect()
    assert [r["doc_id"] for r in same] == ["a", "b"]


def _pipeline(spark, **kw):
    docs = spark.createDataFrame([(1, "deploy the service to production", "t/a.pdf", 1), (2, "rollback procedure: run the script", "t/a.pdf", 2), (3, "unrelated words", None, None)], "doc_id long, text string, source_path string, page_number int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    return QAPipeline(HybridRetriever(docs, vectors, **kw), max_score_gap=None)


def test_bm25_alone_finds_what_has_no_vector(spark):
    asked = spark.createDataFrame([(1, "unrelated", [1.0, 0.0])], "item_id long, text string, embedding array<float>")
    assert 3 in {r["doc_id"] for r in _pipeline(spark).hits(asked).collect()}
    assert 3 not in {r["doc_id"] for r in _pipeline(spark, use_bm25=False).hits(asked).collect()}


def test_answers_and_citations(spark):
    asked = spark.createDataFrame([(1, "rollback script", [0.0, 1.0])], "item_id long, text string, embedding array<float>")
    row = _pipeline(spark).answer(asked).first()
    assert [c["marker"] for c in row["citations"]] == [1, 2]
    assert row["citations"][0]["page_number"] == 2 and row["citations"][0]["source_path"] == "t/a.pdf"
    empty = QAPipeline(HybridRetriever(_pipeline(spark).retriever.documents.filter("false"), _pipeline(spark).retriever.vectors.filter("false")))
    gone = empty.answer(asked).first()
    assert gone["answer"] == prompt.NO_HIT_ANSWER and gone["citations"] is None


def test_where_filters_both_sides(spark):
    docs = spark.createDataFrame([(1, "deploy", "de"), (2, "deploy deploy", "en")], "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(1, [1.0], "de"), (2, [1.0], "en")], "doc_id long, embedding array<float>, lang string")
    asked = spark.createDataFrame([(1, "deploy", [1.0])], "item_id long, text string, embedding array<float>")
    assert [r["doc_id"] for r in HybridRetriever(docs, vectors).search(asked, {"lang": "de"}).collect()] == [1]


def test_prompt_text(spark):
    cited = spark.createDataFrame([(1, 2, "b.pdf", None, "two", 0.5), (1, 1, "a.pdf", 7, "one", 0.9)], "item_id long, marker int, source_path string, page_number int, chunk_text string, score double")
    context = prompt.contexts(cited).first()["context"]
    assert context == "[1] (source: a.pdf, page 7)\none\n[2] (source: b.pdf)\ntwo"
    row = spark.range(1).select(prompt.prompt(F.lit("C"), F.lit("Q?"), F.lit(None).cast("string")).alias("bare"), prompt.prompt(F.lit("C"), F.lit("Q?"), F.lit("R")).alias("full")).first()
    assert row["bare"] == f"Context:\n\nC\n\nQuestion: Q?\n\n{prompt.CLOSING}"
    assert row["full"].startswith(prompt.RECENT_HEAD + "\nR\n\n\nContext:")


def test_bm25_in_small_blocks(spark, monkeypatch):
    """Blocks, pruning and sub-batches of one give what one block gives, over string ids too."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03}", rng.choice("ab"), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id string, company_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)], "item_id long, text string")
    whole = sorted(map(str, bm25.search(df, asked, 4, tenant="company_id").collect()))
    monkeypatch.setattr(bm25, "BLOCK", 2)
    monkeypatch.setattr(bm25, "_PAIRS", 1)
    monkeypatch.setattr(bm25, "_KEPT", 1)
    assert sorted(map(str, bm25.search(df, asked, 4, tenant="company_id").collect())) == whole
    for who in "ab":
        mine = [(d, t) for d, c, t in docs if c == who]
        got = bm25.search(df, asked, 4, tenant="company_id").filter(F.col("company_id") == who)
        for r in asked.collect():
            assert [(x["doc_id"], x["score"]) for x in got.filter(F.col("item_id") == r["item_id"]).orderBy("rank").collect()] == _brute_bm25(mine, r["text"], 4)


def test_questions_without_a_vector_are_searched_by_words(spark):
    documents = spark.createDataFrame([(1, "deploy the service", "a.pdf", 1), (2, "rollback now", "b.pdf", 2), (3, "other words here", "c.pdf", 3)], "doc_id long, text string, source_path string, page_number int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, "deploy", [1.0, 0.0]), (2, "rollback", None)], "item_id long, text string, embedding array<float>")
    found = {(r["item_id"], r["doc_id"]): (r["dense_rank"], r["bm25_rank"]) for r in HybridRetriever(documents, vectors).search(asked).collect()}
    assert found == {(1, 1): (1, 1), (2, 2): (None, 1)}


def test_models_are_called_in_batches(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i}", f"q{i}") for i in range(150)], "i long, text string, question string").repartition(2)

    def load_encoder():
        sizes = []

        def encode(texts):
            assert len(texts) <= models.BATCH
            sizes.append(len(texts))
            return [[float(len(t)), float(len(sizes))] for t in texts]

        return encode

    embed = models.encoder("test-encoder", load_encoder)
    score = models.pair_scorer("test-scorer", lambda: lambda qs, ts: [len(q) + len(t) for q, t in zip(qs, ts, strict=True)])
    generate = models.generator("test-generator", lambda: lambda prompts: [p.upper() for p in prompts])
    got = {r["i"]: r for r in rows.select("i", embed("text").alias("v"), score("question", "text").alias("s"), generate("text").alias("g")).collect()}
    assert got[3]["v"] is None and got[3]["s"] is None and got[3]["g"] is None
    assert got[12]["v"][0] == 7.0 and got[12]["s"] == 10.0 and got[12]["g"] == "TEXT 12"


def test_history_of_a_question(spark):
    """Only answered questions before the question's turn count, the last ones in order; others are asked as they stand."""
    said = [(1, 2 * i, "user", f"q{i}") for i in range(6)] + [(1, 2 * i + 1, "assistant", f"a{i}") for i in range(6)]
    messages = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "x", 1, 9, [1.0]), (2, "y", 1, 0, [1.0]), (3, "z", 2, 5, [1.0]), (4, "w", None, None, [1.0])], "item_id long, text string, conv_id long, turn long, embedding array<float>")
    documents = spark.createDataFrame([], "doc_id long, text string, source_path string, page_number int")
    plan = QAPipeline(HybridRetriever(documents, documents.select("doc_id", F.lit(None).cast("array<float>").alias("embedding"))), condense=lambda p: F.concat(F.lit("S "), F.sha2(p, 256)), embed=lambda t: F.array(F.lit(2.0)))
    got = {r["item_id"]: r for r in plan.with_history(asked, messages).collect()}
    prompt_ = "Conversation history:\nQ: q1\nA: a1\n\nQ: q2\nA: a2\n\nQ: q3\nA: a3\n\nFollow-up question: x\n\nStandalone question:"
    assert got[1]["text"] == "S " + hashlib.sha256(prompt_.encode()).hexdigest() and got[1]["recent"] == "Previous Q: q3\nPrevious A: a3" and got[1]["embedding"] == [2.0]
    assert all(got[i]["text"] == got[i]["asked"] and got[i]["recent"] is None and got[i]["embedding"] == [1.0] for i in (2, 3, 4))
    answered = {r["item_id"]: r for r in plan.answer(asked, messages=messages).collect()}
    assert answered[1]["standalone"] == got[1]["text"] and answered[2]["standalone"] is None and answered[1]["answer"] == prompt.NO_HIT_ANSWER
