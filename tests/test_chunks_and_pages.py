import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import chunking, pages
from tessera.operators.chunking import Splitter

PARTS = st.lists(st.sampled_from(["a", "bb ", "c. ", "\n", "\n\n", "; ", " ", "wordword", "```x```", "é"]), max_size=200).map("".join)


@settings(max_examples=200, deadline=None)
@given(PARTS, st.integers(10, 60), st.integers(0, 9))
def test_chunk_invariants(text, size, overlap):
    splitter = Splitter(size, overlap)
    bare = text.strip()
    for piece in splitter.pieces(bare):
        if "```" not in piece.text:
            assert bare[piece.at : piece.at + len(piece.text)] == piece.text and len(piece.text) <= size
    chunks = list(splitter.split(text))
    assert [c.index for c in chunks] == list(range(len(chunks)))
    assert all(len(c.text) <= size + overlap or "```" in c.text for c in chunks)
    kept = "".join("".join(p.text for p in splitter.pieces(bare)).split())
    assert kept == "".join(bare.split())


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        Splitter(50, 50)


def test_overlap_and_exact_pages():
    marked = "<!-- page:1 -->\n\n" + "alpha beta. " * 8 + "\n\n<!-- page:2 -->\n\n" + "gamma delta. " * 8
    exact = list(Splitter(40, 10).split(marked))
    assert exact[0].page_number == 1 and exact[-1].page_number == 2
    page = {"alpha": 1, "beta.": 1, "gamma": 2, "delta.": 2}
    assert all(c.page_number == page[first] for c in exact if (first := c.text.split()[0]) in page)
    assert [c.text for c in Splitter(40, 10).split(marked, "compat")] == [c.text for c in exact]


def test_fences_stay_whole_or_are_fenced_again():
    short = list(Splitter(60, 5).split("before\n\n```py\nx = 1\n```\nafter"))
    assert [c.is_code for c in short] == [False, True, False] and short[1].text == "```py\nx = 1\n```"
    long = list(Splitter(40, 5).split("```\n" + "\n".join(f"line {i} of code" for i in range(9)) + "\n```"))
    assert len(long) > 1 and all(c.is_code and len(c.text) <= 40 for c in long)
    open_ = list(Splitter(40, 5).split("text ``` never closed " + "word " * 20))
    assert not any(c.is_code for c in open_)


def test_markers_in_a_row_and_at_the_start(spark):
    docs = spark.createDataFrame([(1, "<!-- page:1 --><!-- page:2 -->abc<!--page:3-->de"), (2, "no marker"), (3, None), (4, "")], "doc_id long, text string")
    marks = chunking.page_markers(docs)
    assert [(r["marker_offset"], r["page"]) for r in marks.orderBy("marker_no").collect()] == [(0, 1), (0, 2), (3, 3)]
    at = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (2, 0)], "doc_id long, position int")
    got = {(r["doc_id"], r["position"]): r["page"] for r in chunking.page_asof(at, marks).collect()}
    assert got == {(1, 0): 2, (1, 2): 2, (1, 3): 3, (2, 0): None}
    assert [c.page_number for c in Splitter(50, 5).split("<!-- page:1 --><!-- page:2 -->abc")] == [2]


def test_chunk_documents_handles_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk_index"]) for r in chunking.chunk_documents(docs, 50, 5).collect()] == [(3, 0)]
    assert chunking.fixed_width(docs, 10).count() == 2
    assert chunking.fence_segments(docs).count() == 1


LAYOUT = [
    (1, "Deployment Guide", "Helvetica-Bold", 18.0, 72.0), (1, "This document explains how to deploy the service to production.", "Helvetica", 11.0, 102.0),
    (1, "Follow the steps below carefully before releasing.", "Helvetica", 11.0, 117.0), (1, "def deploy():", "Courier", 10.0, 152.0),
    (1, '    run("make build")', "Courier", 10.0, 167.0), (1, '    run("make push")', "Courier", 10.0, 182.0),
    (2, "Rollback Procedure", "Helvetica-Bold", 16.0, 72.0), (2, "If deployment fails, run the rollback script immediately.", "Helvetica", 11.0, 102.0),
]


def _chars(spark):
    rows = [(1, page, i, c, size, font, top, float(i)) for page, line, font, size, top in LAYOUT for i, c in enumerate(line)]
    return spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, size double, fontname string, top double, x0 double")


def test_layout_to_markdown(spark):
    assert pages.body_sizes(_chars(spark)).first()["body_size"] == 11.0
    got = {r["page"]: r["markdown"] for r in pages.page_markdown(_chars(spark)).collect()}
    assert got[1].startswith("## Deployment Guide\nThis document") and got[2].startswith("## Rollback Procedure\n")
    assert '```\ndef deploy():\n    run("make build")\n    run("make push")\n```' in got[1]
    assert got[1].count("```") == 2
    texts = spark.createDataFrame([(1, p, t) for p, t in got.items()] + [(2, 1, " "), (2, 2, None)], "doc_id long, page int, text string")
    marked = {r["doc_id"]: r["markdown"] for r in pages.marked_document(texts).collect()}
    assert marked[1].index("<!-- page:1 -->") < marked[1].index("<!-- page:2 -->")
    assert marked[2] == "<!-- page:1 -->\n\n<!-- page:2 -->"
    flags = {r["doc_id"]: r["is_scanned"] for r in pages.scanned_documents(pages.page_flags(texts)).collect()}
    assert flags == {1: False, 2: True}


def test_better_page(spark):
    row = spark.range(1).select(pages.better_page(F.lit("ab"), F.lit(" cd ")).alias("tie"), pages.better_page(F.lit(" a "), F.lit("cd")).alias("plain")).first()
    assert (row["tie"], row["plain"]) == ("ab", "cd")


def test_text_functions(spark):
    df = spark.createDataFrame([("acme-1", "Jane doe x"), ("Acme", "é"), ("", None), (None, "  a  b ")], "tenant string, name string")
    rows = df.select(fx.valid_tenant_id(F.col("tenant")).alias("v"), fx.initials(F.col("name")).alias("i"), fx.cache_key(F.col("tenant"), F.lit(5)).alias("k")).collect()
    assert [r["v"] for r in rows] == [True, False, False, False]
    assert [r["i"] for r in rows][:2] == ["JD", "É"] and rows[3]["i"] == "AB"
    assert len({r["k"] for r in rows}) == 4 and all(len(r["k"]) == 24 for r in rows)
    vector = spark.range(1).select(fx.hash_embedding(F.lit("hello")).alias("e")).first()["e"]
    import hashlib

    assert vector == [b / 255 for b in hashlib.sha256(b"hello").digest()[:16]]
