"""BPE against the public library, urls against every rule, mixing against a loop, archives and the pipeline's stages."""

import gzip
import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import components, words
from tessera.llm import bpe, mixing, quality, urls, warc
from tessera.llm import queries as llm
from tessera.runtime import load, materialize

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODER = bpe.Coder(bpe.default_vocabulary())


def _check(texts):
    for text, (n, ids), want in zip(texts, CODER.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == ",".join(map(str, want.ids)) and n == len(want.ids)
        assert CODER.decode(want.ids) == LIBRARY.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "'ll 're 'S", "  \n\n ", "\x85\xa0 ", "½٣१Ⅷ"]), max_size=5).map("".join))
def test_bpe_like_the_library(text):
    _check([text])


def test_bpe_long_words_and_cache(monkeypatch):
    _check(["a" * 5000, "é" * 3000, " " * 4000, "ab" * 4000 + "!" * 999, ""])
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    _check([f"word{i} another{i}" for i in range(50)])


def test_bpe_of_a_word_of_a_megabyte():
    """In linear-logarithmic time, like the library; words around the length from which a word is merged by itself too."""
    rng = random.Random(15)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    _check(["".join(rng.choices(base64, k=n)) for n in (510, 511, 512, 513, 1023, 1024, 1025, 20_000)])
    begin = time.process_time()
    (n, ids), = CODER.encode(["".join(rng.choices(base64, k=1_000_000))])
    assert n == ids.count(",") + 1 and time.process_time() - begin < 60


def test_bpe_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in load(spark, small, "documents").collect()}
    for r in llm.queries()["op8_bpe_round_trip"](spark, small).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode_texts(load(spark, small, "documents"), bpe.default_vocabulary()).collect()
    assert all(r["decoded"] == texts[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_urls_against_every_rule(spark):
    rng = random.Random(8)
    labels = ["a", "b", "com", "net", "x", "WWW", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [urls.Rule(h, p, rng.choice(["allow", "block"])) for h, p in {(host().lower(), rng.choice(["/", "/en/", "/en/x", ""])) for _ in range(40)} if h]
    given_urls = [f"http://{host()}{rng.choice(['', '/', '/en/', '/en/xy', '/de?q', '#f'])}" for _ in range(600)] + ["http://a.com/en/"] * 600 + [None, "", "a.com/en/"]
    df = spark.createDataFrame(list(enumerate(given_urls)), "page_id long, url string")
    for r in urls.judge_urls(df, rules, ranges=5).collect():
        h, p = urls.canonical(r["url"])
        fits = [x for x in rules if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)] if h else []
        best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r["rule"], r["verdict"]) == ((str(best), best.verdict) if best else (None, "allow")), r


def test_mix_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randint(0, 30)) for i in range(300)] + [(i, "d", 100) for i in range(300, 302)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, words long"), F.col("words"), F.col("doc_id")).collect()
    totals = {}
    for r in got:
        totals.setdefault(r["source"], [r["source_size"], r["target"], 0])[2] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    sizes = {s: sum(w for _, x, w in rows if x == s) for s in totals}
    assert {s: t[0] for s, t in totals.items()} == sizes
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    target, left, active = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = left / sum(weight[s] for s in active)
        over = {s for s in active if share * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        active -= over
    target |= {s: share * weight[s] for s in active}
    for s, (_, t, taken) in totals.items():
        assert t == pytest.approx(target[s]) and taken == int(t + 1e-9)


def test_ranges_grow_with_the_rows_and_change_nothing(spark):
    assert [mixing.range_digits(n) for n in (0, 10**8, 10**9, 10**12)] == [3, 3, 4, 6]
    df = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 17).alias("words"))
    runs = [sorted(map(str, mixing.mix_sources(df, F.col("words"), F.col("doc_id"), digits=d).collect())) for d in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]


def test_mix_of_rows_without_or_with_one_id(spark):
    """Rows without doc_id have keys of their own, reruns agree on which of two equal sizes the cut takes, and added names are replaced."""
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a", 10 + i % 3), "s", 5.0) for i in range(20)] + [(7, text(c, 10), "s", 5.0) for c in "bcde"] + [(8, None, "s", 1.0), (8, None, "s", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken double")
    report = mixing.mix_report(df).collect()
    assert len(report) == len(rows) and sum(r["taken"] for r in report) == int(report[0]["target"]) and report[0]["source_size"] == sum(len(words(t)) for _, t, _, _ in rows)
    runs = [sorted(str(r) for r in mixing.mixed_documents(x).collect()) for x in (df, df.repartition(3))]
    assert runs[0] == runs[1] and mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed_documents(df).filter("text IS NULL").count() == 2
    clash = mixing.mix_sources(df.select("source", "taken", F.lit("x").alias("size"), F.lit(3).alias("words")), F.col("words"), F.lit(None).cast("string")).collect()
    assert {r["size"] for r in clash} == {3}


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(2, "http://b/\r\nx", "body é"), (1, "http://a/", "body é"), (3, None, ""), (4, "http://c/", None)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    records = warc.original_records(spark, str(tmp_path / "a"))
    rows = {r["page_id"]: r for r in records.collect()}
    assert rows[2]["payload"] == "body é".encode() and rows[2]["record"].endswith(b"\r\n\r\n\r\n\r\n") and b"urn:page:1" in rows[2]["header"]
    assert rows[1]["record"].endswith("\r\n\r\nbody é\r\n\r\n".encode()) and b"Target-URI" not in rows[3]["header"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/x.warc.gz").write_bytes(b"".join(r["member"] for r in warc.compressed(records).orderBy("page_id").collect()))
    again = warc.read_warc(spark, str(tmp_path / "files")).orderBy("at").collect()
    assert [r["header"] + r["block"] + b"\r\n\r\n" for r in again] == [rows[i]["record"] for i in (1, 2, 3, 4)]
    assert list(warc.split_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))) == []


def test_warc_files(spark, tmp_path):
    """Every record goes to a file once, byte for byte, and comes back from it."""
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}", f"body {i % 5}") for i in range(40)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.original_records(spark, str(tmp_path / "a")).repartition(3)
    files = warc.write_files(records, str(tmp_path / "w")).collect()
    assert sum(r["n_records"] for r in files) == 40 and {r["file"] for r in files} == {p.name for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")}
    again = sorted(bytes(r["header"] + r["block"] + b"\r\n\r\n") for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert again == sorted(bytes(r["record"]) for r in records.collect())


def test_damaged_archives_tell_so(spark, tmp_path):
    """Whole records before the damage are kept; a last row tells what is wrong."""
    record = lambda n: b"WARC/1.1\r\nContent-Length: 5\r\n\r\nbody%d\r\n\r\n" % n
    whole = b"".join(gzip.compress(record(n)) for n in range(3))
    files = {"good": whole, "cut": whole[:-12], "short": record(0) + record(1)[:-7], "bare": record(0) + b"WARC/1.1\r\n\r\nx", "tail": record(0) + b"WARC", "empty": b""}
    for name, content in files.items():
        (tmp_path / f"{name}.warc").write_bytes(content)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).orderBy("at").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-5], []).append((bytes(r["block"]), r["error"], r["header"] is None))
    assert got["good"] == [(b"body%d" % n, None, False) for n in range(3)] and "empty" not in got
    for name, n in (("cut", 2), ("short", 1), ("bare", 1), ("tail", 1)):
        assert [x[:2] for x in got[name][:n]] == [(b"body%d" % i, None) for i in range(n)] and len(got[name]) == n + 1
        assert got[name][n][2] and got[name][n][1]
    assert got["cut"][2][1].startswith("damaged compression") and got["bare"][1][1] == "a record has no length" and got["tail"][1][0] == b"WARC"


def test_damaged_payloads_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    other = materialize(spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"other")))
    other.write.mode("overwrite").parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.original_records(spark, str(tmp_path / "a")).collect()


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcdef"), (4, "x", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.record_headers(pages, 5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_pipeline_stages(spark, small):
    """Each stage against a plain version on its own input."""
    docs = load(spark, small, "documents")
    kept = materialize(corpus_pipeline.quality_rules(spark, docs, small))
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in verdict.items() if k}

    lines = materialize(corpus_pipeline.line_dedup(spark, kept, small))
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (kept, lines))
    assert before.keys() == after.keys()
    for d, text in after.items():
        left = iter(before[d].split("\n"))
        assert all(line in left for line in text.split("\n"))  # a subsequence of its lines

    near = materialize(corpus_pipeline.minhash_near_dedup(spark, lines, small))
    want = components(list(after.items()))
    assert {r["doc_id"] for r in near.collect()} == {d for d, (_, root) in want.items() if root == d}

    mixed = materialize(corpus_pipeline.mix_sources(spark, near, small))
    plan = {r["doc_id"]: r for r in mixing.mix_report(near).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
        assert after[r["doc_id"]].startswith(r["text"])
    assert taken == {d: r["taken"] for d, r in plan.items() if r["taken"] or not r["size"]}

    coded = corpus_pipeline.bpe_encode(spark, mixed, small).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert len(coded) == len(texts) and all(r["decodes"] for r in coded)
    ids = sorted((r["doc_id"], tuple(r["ids"])) for r in coded)
    assert ids == sorted((d, tuple(LIBRARY.encode(t, add_special_tokens=False).ids)) for d, t in texts)
    assert corpus_pipeline.run(spark, small).count() == len(coded)
