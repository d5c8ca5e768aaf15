import datetime
import logging

import pytest
from pyspark.sql import functions as F

from tessera import runtime
from tessera.__main__ import main
from tessera.operators import bm25, prompt
from tessera.operators.cache import AnswerCache
from tessera.operators.segments import SegmentedIndex
from tessera.plans.workspace import Workspace
from tessera.sources.config import tenant_config


GUIDE = "Deployment Guide\nThis document explains how to deploy the service to production.\fRollback Procedure\nIf deployment fails, run the rollback script immediately and call the team."


@pytest.fixture
def place(spark, tmp_path):
    def parse(content):  # local, so that it travels to the workers by value
        if content.startswith(b"broken"):
            raise ValueError("broken")
        return content.decode().split("\f")

    configs = tmp_path / "configs"
    configs.mkdir()
    (configs / "template.yaml").write_text("company: {id: x, name: x}\nchunking: {chunk_size: 90, chunk_overlap: 10, min_chunk_length: 20}\nvector_store: {collection_name: c}\n")
    for name in ("acme", "beta"):
        (configs / f"{name}.yaml").write_text(f"company: {{id: {name}, name: {name}}}\n")
    w = Workspace(spark, str(tmp_path / "data"), parse)
    w.add("acme", "Acme")
    w.add("beta", "Beta")
    raw = tmp_path / "data/companies/acme/raw_pdfs"
    config = lambda who="acme": tenant_config(configs / f"{who}.yaml", who, configs / "template.yaml", str(tmp_path / "data/companies"))
    return w, raw, config, ["--root", str(tmp_path / "data"), "--configs", str(configs)]


def test_ingest_ask_change_and_forget(place, capsys):
    w, raw, config, options = place
    (raw / "guide.pdf").write_bytes(GUIDE.encode())
    (raw / "blank.pdf").write_bytes(b" \f ")
    (raw / "bad.pdf").write_bytes(b"broken")
    got = {r["status"]: (r["n"], r["failed"]) for r in w.ingest(config()).collect()}
    assert got == {"ok": (1, False), "skipped_scanned": (1, False), "error": (1, False)}
    assert {r["source_path"].rsplit("/", 1)[1] for r in w.store("acme").documents().collect()} == {"guide.pdf"}
    assert w.store("beta").count() == 0
    row = w.pipeline(config()).answer(w.questions(config(), ["how do I run the rollback script"])).first()
    assert row["citations"][0]["page_number"] == 2
    assert {r["status"] for r in w.ingest(config()).collect()} == {"error", "skipped_scanned"}  # what is ok is not read again
    assert main([*options, "audit", "--company", "acme"], w) == 1
    assert main([*options, "query", "--company", "acme", "--query", "rollback", "--no-llm"], w) == 0
    assert "Rollback" in capsys.readouterr().out
    assert main([*options, "query", "--company", "beta", "--query", "x"], w) == 1
    assert w.info("acme").first()["n_ok"] == 1

    (raw / "guide.pdf").write_bytes(b"An entirely new text on kangaroos, which is long enough to be a chunk.")
    (raw / "bad.pdf").unlink()
    w.ingest(config()).collect()
    texts = [r["document"] for r in w.store("acme").documents().collect()]
    assert len(texts) == 1 and "kangaroos" in texts[0]
    assert main([*options, "ingest", "--company", "acme"], w) == 0

    (raw / "guide.pdf").unlink()
    w.ingest(config()).collect()
    assert w.store("acme").count() == 0
    w.reset("acme")
    assert w.manifest("acme").count() == 0 and (raw / "blank.pdf").exists()
    w.remove("acme", delete_data=True)
    assert not raw.exists() and [r["company_id"] for r in w.registry().collect()] == ["beta"]


def _ready(w, raw, config):
    (raw / "guide.pdf").write_bytes(GUIDE.encode())
    w.ingest(config()).collect()


def test_the_stored_index_follows_the_store(place):
    w, raw, config, _ = place
    _ready(w, raw, config)
    kept = SegmentedIndex(w.spark, f"{w.root}/bm25/company_id=acme")
    first = kept.segments()
    assert len(first) == 1 and w.pipeline(config()).retriever.index is not None and kept.segments() == first
    asked = w.questions(config(), ["rollback script", "kangaroos"])
    by_words = lambda: {(r["item_id"], r["doc_id"]) for r in bm25.search_index(w.index("acme"), asked).collect()}
    assert {i for i, _ in by_words()} == {0}
    (raw / "more.pdf").write_bytes(b"An entirely new text on kangaroos, which is long enough to be a chunk.")
    w.ingest(config()).collect()
    assert {i for i, _ in by_words()} == {0, 1}
    assert kept.segments()[:1] == first and len(kept.segments()) == 2
    added = w.spark.read.parquet(f"{kept.path}/postings").filter(F.col("segment") == kept.segments()[1])
    assert added.count() == 1  # of the new file only


def test_follow_ups_pass_the_cache_by(place):
    w, raw, config, _ = place
    _ready(w, raw, config)
    spark, calls = w.spark, []
    cache = AnswerCache(spark, f"{w.root}/answers", ttl_seconds=100, most=2)
    messages = spark.createDataFrame([(1, 0, "user", "how do I deploy"), (1, 1, "assistant", "like this"), (1, 2, "user", "and undo it?")], "conv_id long, turn long, role string, text string")
    texts = ["how do I run the rollback script", "and undo it?", "how do I run the rollback script"]
    asked = w.questions(config(), texts).withColumn("conv_id", F.when(F.col("item_id") == 1, F.lit(1).cast("long"))).withColumn("turn", F.lit(2).cast("long"))
    plan = w.pipeline(config(), condense=lambda prompt: F.when(prompt.contains("Q: how do I deploy"), F.lit(' "run the rollback script" ')))

    def answer(questions, told):
        calls.append(sorted(r["item_id"] for r in questions.collect()))
        return plan.answer(questions, messages=told)

    ask = lambda now: {r["item_id"]: r for r in cache.answered("acme", asked, messages, answer, now).collect()}
    first, second, late = ask(1000), ask(1050), ask(1101)
    assert calls == [[0], [1], [], [1], [0], [1]]
    assert [first[i]["hit"] for i in range(3)] == [False] * 3 and second[0]["hit"] and not second[1]["hit"] and not late[0]["hit"]
    assert first[0]["answer"] == first[2]["answer"] == second[0]["answer"] and second[1]["answer"] == first[1]["answer"]
    assert first[1]["standalone"] == "run the rollback script" and "Rollback" in first[1]["citations"]
    more = w.questions(config(), ["one", "two"])
    cache.answered("acme", more, None, lambda q, m: plan.answer(q), 1102).collect()
    assert cache.entries().count() == 2 and cache.entries().filter("used = 1102").count() == 2


def test_tenants_are_compared_and_logged(place, caplog):
    w, raw, config, _ = place
    _ready(w, raw, config)
    old = w.spark.createDataFrame([(4, "acme", "q", "a", "[]", 0, datetime.datetime(2024, 1, 1))], "id long, company_id string, question string, answer string, citations_json string, starred int, created_at timestamp")
    found, log = w.compare([config(), config("beta")], ["run the rollback script"], old)
    got = {r["company_id"]: r for r in found.collect()}
    assert got["acme"]["citations"] and got["beta"]["answer"] == prompt.NO_HIT_ANSWER
    assert sorted((r["id"], r["company_id"]) for r in log.collect()) == [(4, "acme"), (5, "acme"), (6, "beta")]
    with runtime.tenant_log(w.spark, "acme", "test"):
        assert w.spark.sparkContext.getLocalProperty("spark.job.description") == "acme: test"
        record = logging.makeLogRecord({})
        assert runtime.TenantFilter().filter(record) and record.tenant == "acme"
    runtime.configure_logging()
    runtime.configure_logging()
    assert len(logging.getLogger("tessera").handlers) == 1


def test_uploads(place):
    w, raw, config, _ = place
    assert w.upload("acme", "../x/guide.pdf", GUIDE.encode()).endswith("acme/raw_pdfs/guide.pdf")
    assert (raw / "guide.pdf").read_bytes() == GUIDE.encode()
    w.upload("acme", "guide.pdf", b"other")
    assert (raw / "guide.pdf").read_bytes() == b"other"
    for who, name, error in (("acme", "..", ValueError), ("acme", "a/", ValueError), ("none", "a.pdf", KeyError)):
        with pytest.raises(error):
            w.upload(who, name, b"")
