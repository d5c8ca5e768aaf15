"""The index in segments gives the scores of one that is made at once."""

import glob
import random

import pytest

from tessera.operators import bm25
from tessera.operators.segments import SegmentedIndex

DDL = "doc_id long, text string, tenant string"


def _text(rng):
    return " ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randrange(1, 30)))


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("tenant", [None, "tenant"])
def test_scores_of_a_rebuild(spark, tmp_path, tenant):
    rng = random.Random(8)
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(3))) for i in range(6)], "item_id long, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"), "bigint", tenant)
    assert index.last() is None and bm25.search_index(index.index(), asked, 5, tenant).count() == 0
    now = {i: (i, _text(rng), rng.choice(["a", "b", None])) for i in range(60)}
    index.apply(spark.createDataFrame(list(now.values()), DDL), of="one")
    before = set(glob.glob(f"{tmp_path}/index/postings/*/*.parquet"))
    # ten documents change (one loses its text), five are new, seven go
    changes = {i: (i, None if i == 3 else _text(rng), "a") for i in [*range(10), *range(100, 105)]}
    gone = list(range(20, 27))
    index.apply(spark.createDataFrame(list(changes.values()), DDL), spark.createDataFrame([(i,) for i in [*gone, 999]], "doc_id long"), of="two")
    now = {i: r for i, r in (now | changes).items() if i not in gone}
    want = _rows(bm25.search(spark.createDataFrame(list(now.values()), DDL), asked, 5, tenant))
    assert _rows(bm25.search_index(index.index(), asked, 5, tenant)) == want
    assert before < set(glob.glob(f"{tmp_path}/index/postings/*/*.parquet"))  # no old file was written again
    assert index.last() == "two" and len(index.segments()) == 2
    written = spark.read.parquet(f"{tmp_path}/index/postings").filter(f"segment = '{index.segments()[1]}'")
    assert written.count() == 15
    # what a broken refresh leaves behind does not count
    index._write(written.drop("segment"), "postings", "00000002-broken")
    index._write(written.select("doc_id"), "gone", "00000002-broken")
    assert _rows(bm25.search_index(index.index(), asked, 5, tenant)) == want
    small = index.compacted(str(tmp_path / "compact"))
    assert len(small.segments()) == 1 and small.live().count() == len(now) and small.last() == "two"
    assert _rows(bm25.search_index(small.index(), asked, 5, tenant)) == want


def test_sync(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"h:{i}", _text(rng)) for i in range(30)]
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4")], "item_id long, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    for part, of in ((rows[:20], "a"), (rows[5:], "b"), (rows[5:], "c"), ([], "d"), (rows, "e")):
        documents = spark.createDataFrame(part, "doc_id string, text string")
        index.sync(documents, of)
        assert index.last() == of and _rows(bm25.search_index(index.index(), asked, 5)) == _rows(bm25.search(documents, asked, 5))
