import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cache, conversation, history, links, manifest
from tessera.runtime import numbered
from tessera.sources import config, pdf, stores
from tessera.sources.vector_store import VectorStore
from tessera.sources.versions import Versions


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), "acme")
    assert store.count() == 0
    row = lambda i, path, seq, v: (i, v, f"text {i}", path, 1, 0, False, "sha", seq)
    schema = "id string, embedding array<float>, document string, source_path string, page_number int, chunk_index int, is_code boolean, file_sha256 string, seq long"
    store.upsert(spark.createDataFrame([row("a:0", "x.pdf", 1, [1.0, 0.0]), row("b:0", "y.pdf", 2, [0.0, 1.0])], schema))
    store.upsert(spark.createDataFrame([row("a:0", "z.pdf", 3, [1.0, 0.0])], schema))
    store.upsert(spark.createDataFrame([], schema))
    assert {(r["id"], r["source_path"]) for r in store.documents().collect()} == {("a:0", "z.pdf"), ("b:0", "y.pdf")}
    assert "embedding" not in store.documents().columns
    assert VectorStore(spark, str(tmp_path), "other").count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, embedding array<float>")
    assert store.query(asked, 1).first()["doc_id"] == "a:0"
    assert store.query(asked, 5, {"source_path": "y.pdf"}).count() == 1
    store.delete([])
    store.delete_by_source("y.pdf")
    assert store.count() == 1
    store.delete(["a:0"])
    assert store.count() == 0
    store.wipe()
    assert store.count() == 0
    for bad in ("", "Acme", "a b", "a/b", "a\n"):
        with pytest.raises(ValueError):
            VectorStore(spark, str(tmp_path), bad)


def test_manifest_file(spark, tmp_path):
    path = str(tmp_path / "manifest")
    entry = lambda p, status, seq: (p, "h", None, "acme", status, seq)
    names = "source_path string, file_sha256 string, clean_path string, company_id string, status string, seq long"
    stores.append_manifest(spark.createDataFrame([entry("a", "ok", 1), entry("b", "error", 2)], names), path)
    stores.append_manifest(stores.next_seq(stores.manifest_log(spark, path), spark.createDataFrame([entry("a", "skipped_scanned", 0)], names).drop("seq")), path)
    (tmp_path / "manifest" / "bad.json").write_text('{"source_path": "c", "status": "ok", "seq": \n\n{broken\n{"source_path": "d", "status": "strange", "seq": 9}\n')
    got = {r["source_path"]: r["status"] for r in stores.load_manifest(spark, path).collect()}
    assert got == {"a": "skipped_scanned", "b": "error"}
    stores.compact_manifest(spark, path)
    assert stores.manifest_log(spark, path).count() == 2


def test_audit_precedence(spark):
    rows = [("e", "error", "h", "gone"), ("s", "skipped_scanned", "h", None), ("m", "ok", "h", "gone"), ("x", "ok", "other", "gone"), ("c", "ok", "h", "gone"), ("o", "ok", "h", "here"), ("n", "ok", "h", None)]
    entries = spark.createDataFrame(rows, "source_path string, status string, file_sha256 string, clean_path string")
    files = spark.createDataFrame([(p, "h") for p in "esxcon"], "source_path string, current_sha256 string")
    clean = spark.createDataFrame([("here",)], "clean_path string")
    audited = manifest.audit(entries, files, clean)
    assert {r["source_path"]: r["outcome"] for r in audited.collect()} == {"e": "ERROR_ENTRY", "s": "SCANNED", "m": "MISSING_SOURCE", "x": "HASH_MISMATCH", "c": "MISSING_CLEAN_FILE", "o": "OK", "n": "OK"}
    assert {r["outcome"]: r["n"] for r in manifest.audit_counts(audited.filter("outcome = 'OK'")).collect()}["SCANNED"] == 0
    assert {r["source_path"] for r in manifest.needs_processing(files, entries, clean).collect()} == set("esxc")


def test_work_list(spark):
    state = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "pending")], "path string, state string")
    paths = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "path string")
    assert {r["path"] for r in manifest.seed(paths, state).collect()} == {"b", "d"}
    after = manifest.mark(state, spark.createDataFrame([("b", "completed"), ("c", "completed")], "path string, state string"))
    assert {r["path"]: r["state"] for r in after.collect()} == {"a": "completed", "b": "completed", "c": "completed"}
    assert manifest.is_complete(after).first()["complete"] and not manifest.is_complete(state).first()["complete"]


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry = stores.load_registry(spark, path)
    assert registry.count() == 0
    registry = stores.add_company(stores.add_company(registry, "acme", "Acme"), "beta", "Beta")
    with pytest.raises(ValueError):
        stores.add_company(registry, "acme", "again")
    with pytest.raises(KeyError):
        stores.get_company(registry, "none")
    stats = spark.createDataFrame([("acme", 3, 40)], "company_id string, total_pdfs long, total_chunks long")
    stores.save_registry(stores.update_stats(registry, stats, "2024-01-02"), path)
    again = stores.load_registry(spark, path)
    assert stores.get_company(again, "acme")["total_chunks"] == 40 and stores.get_company(again, "beta")["last_ingestion"] is None
    assert {r["company_id"]: r["last_ingestion"] for r in manifest.registry_list(again).collect()} == {"acme": "2024-01-02", "beta": "never"}
    assert stores.remove_company(again, "acme").count() == 1


def _history(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "gitlab", "How is security set up?", "Well", "[]", 0, at), (2, "gitlab", "How to deploy 100%?", "See a_b", '[{"marker": 1, "source": "a.pdf"}]', 1, at + datetime.timedelta(1)), (3, "basecamp", "ÉCOLE", "x", None, 0, at)]
    return spark.createDataFrame(rows, "id long, company_id string, question string, answer string, citations_json string, starred int, created_at timestamp")


def test_history(spark):
    h = _history(spark)
    assert [r["id"] for r in history.entries(h, "gitlab").collect()] == [2, 1]
    assert [r["id"] for r in history.entries(h, "gitlab", "SECURITY").collect()] == [1]
    assert [r["id"] for r in history.entries(h, "gitlab", "s%y").collect()] == [1]
    assert [r["id"] for r in history.entries(h, "gitlab", "\\").collect()] == []
    assert history.entries(h, "basecamp", "école").count() == 0
    assert history.entries(h, "gitlab", limit=1).count() == 1
    assert {r["id"]: r["starred"] for r in history.toggle_star(h, F.col("id") == 2).collect()} == {1: 0, 2: 0, 3: 0}
    assert history.delete(h, F.col("id") == 1).count() == 2
    assert {r["id"]: (r["n_sources"], r["starred"]) for r in history.decoded(h).collect()} == {1: (0, False), 2: (1, True), 3: (0, False)}


def test_conversation_edges(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "system", "note"), (1, 4, "assistant", "a2"), (1, 5, "assistant", "more"), (1, 6, "user", "q3"), (1, 7, "assistant", "a3")]
    paired = conversation.pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r["question"], r["answer"]) for r in paired.orderBy("turn").collect()] == [("q2", "a2"), ("q3", "a3")]
    recent = [r["recent"] for r in conversation.generation_window(paired).orderBy("turn").collect()]
    assert recent == [None, "Previous Q: q2\nPrevious A: a2"]
    row = spark.range(1).select(*(conversation.condensed(F.lit("q"), F.lit(x)).alias(f"c{i}") for i, x in enumerate([' "full" ', "  ", '""', "q"])), conversation.standalone(F.lit("q"), F.lit("q")).alias("s")).first()
    assert [row[f"c{i}"] for i in range(4)] == ["full", "q", "q", "q"] and row["s"] is None


def test_links(spark):
    html = '<a href="/docs/a#x">1</a> <A class="b" href="b/../c/">2</A><a href="//else.org/docs">3</a><a href="mailto:x@y">4</a><a href="/docs-old">5</a><a href="/docs/a">6</a><link href="/style.css"><a href="http://[bad">7</a>'
    pages = spark.createDataFrame([(1, "http://h.org/docs/i", html), (2, "http://h.org/", None)], "page_id long, url string, html string")
    got = [r["link"] for r in links.extract_links(pages, "/docs").orderBy("at").collect()]
    assert got == ["http://h.org/docs/a", "http://h.org/docs/c", "http://h.org/docs-old", "http://h.org/docs/a"]
    assert [r["link"] for r in links.extract_links(pages, "/docs", whole_segments=True).orderBy("at").collect()] == [got[0], got[1], got[3]]
    names = spark.createDataFrame([("http://h.org/",), ("http://h.org/a b/c.d?q=1",)], "url string").select(links.file_name(F.col("url")).alias("n")).collect()
    assert [r["n"] for r in names] == ["index.pdf", "a_b__c_d.pdf"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, link string")
    found = links.crawl_levels(spark.createDataFrame([("a",)], "url string"), edges)
    assert {r["url"]: r["depth"] for r in found.collect()} == {"a": 0, "b": 1, "c": 2}
    chain = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}") for i in range(16)], "url string, link string")
    start = spark.createDataFrame([("p00",)], "url string")
    assert {r["url"]: r["depth"] for r in links.crawl_levels(start, chain).collect()} == {f"p{i:02}": i for i in range(17)}
    assert sorted(r["url"] for r in links.crawl_levels(start, chain, 5).collect()) == [f"p{i:02}" for i in range(5)]


def test_links_as_a_parser_finds_them(spark):
    base = "http://h.org/d/e?q=1"
    html = """<a href='/single'>1</a><a href=/bare>2</a><a title="x > y href='no'" class=c href="/q?a=1&amp;b=2">3</a><!-- <a href="/hidden"> -->
        <script>x = '<a href="/script">'</script><a data-href="/data">4</a><A HREF = "../up/./x">5</A><a href="">6</a><a href="?r=2">7</a><a href="&#47;num&#x2F;b&lt;">8</a><a
        href="/line#f">9</a><a href="../../../..">10</a><a href=" /space ">11</a><a name="n">12</a><a href="HTTP://h.org/up">13</a><a href="//h.org/rel/">14</a>"""
    rows = spark.createDataFrame([(1, base, html), (2, "no url", "<a href='/x'>")], "page_id long, url string, html string")
    got = links.extract_links(rows).orderBy("page_id", "at").collect()
    want = ["/single", "/bare", "/q?a=1&b=2", "/up/x", "/d/e?q=1", "/d/e?r=2", "/num/b<", "/line", "", "/space"]
    assert [r["link"] for r in got] == [f"http://h.org{x}" for x in want] + ["HTTP://h.org/up", "http://h.org/rel"]


def test_a_version_that_breaks_off(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "t"))
    assert kept.current() is None
    kept.write(lambda folder: spark.range(1).write.parquet(f"{folder}/rows"))

    def broken(folder):
        spark.range(2).write.parquet(f"{folder}/rows")
        raise OSError("lost")

    with pytest.raises(OSError):
        kept.write(broken)
    assert kept.current().endswith("v-1") and spark.read.parquet(f"{kept.current()}/rows").count() == 1
    for n in (3, 4, 5):
        kept.write(lambda folder, n=n: spark.range(n).write.parquet(f"{folder}/rows"))
    assert kept.current().endswith("v-5") and sorted(x.name for x in (tmp_path / "t").iterdir()) == ["v-4", "v-5"]


def test_checkpoints_are_saved(spark, tmp_path):
    path = str(tmp_path / "c")
    assert stores.load_checkpoint(spark, path).count() == 0
    stores.save_checkpoint(spark.createDataFrame([("a", "pending"), ("b", "completed")], "path string, state string"), path)
    state = stores.load_checkpoint(spark, path)
    stores.save_checkpoint(manifest.mark(state.select("path", "state"), spark.createDataFrame([("a", "failed")], "path string, state string")), path)
    assert {r["path"]: r["state"] for r in stores.load_checkpoint(spark, path).collect()} == {"a": "failed", "b": "completed"}


def test_the_better_text_of_each_page(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    files = stores.discover(spark, [(str(tmp_path), "*.pdf")])

    def parse(content):
        if content == b"c.pdf":
            raise ValueError("broken")
        return ["Title body", "a longer plain text"]

    def chars(content):
        if content == b"b.pdf":
            raise ValueError("no chars")
        place = lambda text, size, top: [{"text": c, "size": size, "fontname": "Sans", "top": top, "x0": float(i)} for i, c in enumerate(text)]
        return [place("Title", 20, 1) + place("body body", 10, 2), place("short", 10, 1)]

    got = {(r["path"].rsplit("/", 1)[1], r["page"]): (r["text"], r["error"], r["extractor"]) for r in pdf.extract_best(files, parse, chars).collect()}
    assert got["a.pdf", 1] == ("## Title\nbody body", None, "plain+chars") and got["a.pdf", 2][0] == "a longer plain text"
    assert got["b.pdf", 1] == ("Title body", None, "plain") and got["c.pdf", None][1] == "ValueError: broken"


def test_cache(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, "k", at(0)), (2, "k", at(5)), (3, "k", at(10)), (4, "k", at(15)), (5, "j", at(5)), (6, "k", at(10))]
    got = {r["event_id"]: r["hit"] for r in cache.cache_hits(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), 10, ["key"]).collect()}
    assert got == {1: False, 2: True, 3: False, 6: True, 4: True, 5: False}


def test_discovery_and_extraction(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    files = stores.discover(spark, [(str(tmp_path / "in"), "*.pdf"), (str(tmp_path / "missing"), "*.pdf")])
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.pdf", "b.pdf"]
    assert stores.discover(spark, []).count() == 0

    def parse(content):
        if content == b"b.pdf":
            raise ValueError("broken")
        return ["one", ""]

    got = pdf.extract(files, parse).orderBy("path", "page").collect()
    assert [(r["page"], r["text"], r["error"]) for r in got] == [(1, "one", None), (2, "", None), (None, None, "ValueError: broken")]


def test_config(tmp_path):
    template = tmp_path / "template.yaml"
    template.write_text("company: {id: company_xxx, name: x}\nsources: [{path: data/company_xxx}]\nchunking: {chunk_size: 300, chunk_overlap: 40}\nvector_store: {collection_name: c}\nretrieval: {top_k: 10}\n")
    own = tmp_path / "acme.yaml"
    own.write_text("company: {id: acme, name: Acme}\nchunking: {chunk_overlap: 20}\n")
    made = config.tenant_config(own, "acme", template)
    assert (made.chunking.chunk_size, made.chunking.chunk_overlap, made.retrieval.top_k) == (300, 20, 10)
    assert made.sources[0].path == "data/companies/acme/raw_pdfs"
    for text, who in (("company: {id: other}\nvector_store: {}\n", "acme"), ("company: {id: acme}\n", "acme"), ("[1]", "acme"), ("a: [", "acme")):
        own.write_text(text)
        with pytest.raises(config.ConfigError):
            config.tenant_config(own, who)
    with pytest.raises(config.ConfigError):
        config.tenant_config(tmp_path / "none.yaml", "acme")
    assert config.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def _queue(start, named, fetched, max_pages, batch):
    """A crawl by a queue: the pages taken, in order, and the saved ones."""
    queue, seen, taken, saved = [start], {start}, [], []
    while queue and len(saved) < max_pages:
        now, queue = queue[:batch], queue[batch:]
        taken += now
        saved += [u for u in now if u in fetched]
        for link in [x for u in now if u in fetched for x in named.get(u, [])]:
            if link not in seen:
                seen.add(link)
                queue.append(link)
    return taken, saved


@pytest.mark.parametrize("seed, batch, max_pages", [(1, 1, 12), (2, 4, 15), (3, 4, 1000), (4, 7, 9)])
def test_crawl_order_is_a_queues(spark, seed, batch, max_pages):
    """Pages in the order they are found, failed ones uncounted, whole batches beyond the limit."""
    rng = random.Random(seed)
    urls = [f"u{i:02}" for i in range(60)]
    named = {u: rng.sample(urls, rng.choice([0, 1, 2, 5])) for u in urls}
    named["u00"] = ["u07", "u03", "u07", "u00", "u50"]
    fetched = {u for u in urls if rng.random() < 0.8} | {"u00", "u07", "u03"}
    edges = spark.createDataFrame([(u, i, x) for u, found in named.items() for i, x in enumerate(found)] + [("u00", 9, None), (None, 0, "u59")], "url string, at long, link string")
    one = lambda us: spark.createDataFrame([(u,) for u in us], "url string")
    got = links.crawl_order(one(["u00", "u00", None]), edges, one(sorted(fetched)), max_pages, batch).orderBy("position").collect()
    taken, saved = _queue("u00", named, fetched, max_pages, batch)
    assert [r["url"] for r in got] == taken and [r["url"] for r in got if r["saved"]] == saved
    assert [r["position"] for r in got] == list(range(len(taken)))


def test_crawl_order_of_nothing(spark):
    none = spark.createDataFrame([], "url string")
    assert links.crawl_order(none, spark.createDataFrame([], "url string, at long, link string"), none, 5, 2).collect() == []


def test_rows_are_numbered_in_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("v"), F.lit("x").alias("n_before"))
    got = numbered(df, ["v"], "n", 10).collect()
    assert [v for _, v in sorted((r["n"], r["v"]) for r in got)] == sorted((i * 7919) % 5003 for i in range(5000))
    assert sorted(r["n"] for r in got) == list(range(10, 5010))
