"""The inverted index: rows of the plain search, blocks left out, tenants without a name, reruns by tenant."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, inverted


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(900):
        words = rng.choices(common, k=rng.randrange(5, 120)) + ["everywhere"] * (rng.random() < 0.4) * rng.randrange(1, 4)
        words += [f"rare{rng.randrange(200)}" for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(words), rng.choice(["a", "a", "b", None])))
    rows += [(900, None, "a"), (901, "", None), (902, "only here", "solo")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, tenant string").cache()
    asked = [(i, " ".join(rng.sample(common, 2) + [f"rare{i}", "everywhere"])) for i in range(12)] + [(50, "everywhere everywhere rare7"), (51, ""), (52, None), (53, "nowhere"), (54, "only here")]
    return documents, spark.createDataFrame(asked, "item_id long, text string").cache()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("tenant", [None, "tenant"])
def test_rows_of_the_plain_search(corpus, tenant, monkeypatch):
    documents, questions = corpus
    monkeypatch.setattr(inverted, "BLOCK", 16)
    for k in (1, 10):
        assert _rows(inverted.search(inverted.build(documents, tenant), questions, k, tenant)) == _rows(bm25.search(documents, questions, k, tenant))


def test_rows_without_a_tenant_are_found(corpus):
    documents, questions = corpus
    found = bm25.search(documents, questions, 3, "tenant")
    assert found.filter("tenant is null").count() > 20


def test_blocks_are_left_out(spark, corpus, monkeypatch):
    documents, _ = corpus
    monkeypatch.setattr(inverted, "BLOCK", 16)
    blocks = inverted.build(documents).cache()
    assert blocks.agg(F.max("n")).first()[0] < 64
    some = spark.createDataFrame([(0, "rare3 everywhere")], "item_id long, text string")
    _, first, _, more = inverted.opened_blocks(blocks, some, 1)
    key = ["scope", "term", "band", "part"]
    terms = inverted.asked_terms(some).select("term").distinct()
    asked, read = blocks.join(terms, "term").count(), first.select(*key).union(more.select(*key)).distinct().count()
    assert 0 < read < asked / 2 < blocks.count() / 2  # of the common word, only blocks that can hold a document with a rare one
    seen = inverted.question_terms(blocks, some, 1)
    assert {r["term"][:4] for r in seen.filter("essential").collect()} == {"rare"}


def test_stored_by_tenant(spark, corpus, tmp_path):
    documents, questions = corpus
    path = str(tmp_path / "index")
    inverted.store(inverted.build(documents, "tenant"), path)
    want = _rows(bm25.search(documents, questions, 5, "tenant"))
    assert _rows(inverted.search(inverted.stored(spark, path), questions, 5, "tenant")) == want
    plan = inverted.stored(spark, path).filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    # one tenant's documents again: its folders are replaced, the others' stay
    inverted.store(inverted.build(documents.filter("tenant = 'b'"), "tenant"), path)
    assert _rows(inverted.search(inverted.stored(spark, path), questions, 5, "tenant")) == want


def test_empty(spark, corpus):
    none = inverted.build(corpus[0].limit(0), "tenant")
    assert none.count() == 0 and inverted.search(none, corpus[1], 5, "tenant").count() == 0


@pytest.mark.parametrize("tenant", [None, "tenant"])
def test_frequent_terms_are_dealt_over_slots_and_shards(corpus, monkeypatch, tenant):
    documents, questions = corpus
    names = documents.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("doc_id"), "text", "tenant")
    monkeypatch.setattr(inverted, "BLOCK", 16)
    whole = _rows(inverted.build(documents, tenant))
    want = _rows(bm25.search(names, questions, 4, tenant))
    for name, value in (("HOT", 40), ("FILE", 64), ("SHARD", 64), ("_HELD", 50)):
        monkeypatch.setattr(inverted, name, value)
    blocks = inverted.build(documents, tenant)
    assert _rows(blocks) == whole
    assert _rows(inverted.search(inverted.build(names, tenant), questions, 4, tenant)) == want


def test_no_row_for_each_posting_and_question_moves(corpus):
    documents, questions = corpus
    blocks = inverted.build(documents, "tenant")
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in shown(inverted.search(blocks, questions, 3, "tenant")).splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not any("doc_id" in line for line in moved)  # sums are made where a shard's postings are
    assert shown(blocks).count("Exchange hashpartitioning(") == 1  # lists move once
