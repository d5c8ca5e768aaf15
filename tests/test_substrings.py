import datetime
import random

from pyspark.sql import functions as F

from tessera.operators import history
from tessera.operators.substrings import SubstringIndex, needed, trigrams

LOG = "id long, company_id string, question string, answer string, starred int, created_at timestamp"


def _log(spark, n, first=1, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "100%", "é_x", "rollback", "roll back", "", "ALPHABET"]
    at = datetime.datetime(2024, 1, 1)
    said = lambda: rng.choice([None, " ".join(rng.choices(words, k=4))])
    return spark.createDataFrame([(first + i, f"c{i % 3}", said(), f"{said()} entry{first + i:05}", 0, at + datetime.timedelta(seconds=i)) for i in range(n)], LOG)


def test_trigrams(spark):
    df = spark.createDataFrame([("AbCaBc",), ("é€𝄞x",), ("ab",), ("",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(trigrams(F.col("t"))).collect()] == [["abc", "bca", "cab"], ["é€𝄞", "€𝄞x"], [], [], []]
    assert needed("C_ICK%ab") == ["ick"] and needed("a_b") == [] and needed("É€𝄞") == ["É€𝄞"]


def test_rows_are_those_of_the_scan(spark, tmp_path):
    log = _log(spark, 400)
    index = SubstringIndex(spark, str(tmp_path / "i"), 8, 16)
    assert index.matching(log, "alpha").count() == 0 and index.matching(log, "a").count() == 0
    index.refresh(log)
    for search in ("alpha", "ALPHA", "al_ha", "roll%back", "rollback", "100%", "é_x", "x", "_", "nowhere", "alpha b", "entry00007", "0_4", "pha%nowhere"):
        got = sorted(r["id"] for r in index.matching(log, search).collect())
        assert got == sorted(r["id"] for r in history.matching(log, search).collect()), search
    assert index.entries(log, "c1", "beta").collect() == history.entries(log, "c1", "beta").collect()


def test_few_rows_are_read(spark, tmp_path):
    log = _log(spark, 400)
    index = SubstringIndex(spark, str(tmp_path / "i"), 8, 16)
    index.refresh(log)
    assert index.candidates("entry00007").count() <= 12
    found = index.matching(log, "entry00007")
    folders = {r[0] for r in index.rows(log.schema).filter(F.col("id") == 7).select("place").collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    listed = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "place" in listed and all(str(x) in listed for x in folders)
    assert len(index.candidates("entry00007").select("place").distinct().collect()) < 12
    assert index.candidates("no such text").count() == 0 and index.candidates("ab") is None


def test_a_refresh_takes_what_is_new(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "i"), 8, 16)
    first = _log(spark, 50)
    both = first.union(_log(spark, 30, 51, seed=2))
    index.refresh(first)
    files = set((tmp_path / "i").rglob("*.parquet"))
    index.refresh(first)
    assert set((tmp_path / "i").rglob("*.parquet")) == files  # nothing new writes nothing
    index.refresh(both)
    assert files < set((tmp_path / "i").rglob("*.parquet"))
    for search in ("rollback", "entry000", "entry00061", "z"):
        assert sorted(r["id"] for r in index.matching(both, search).collect()) == sorted(r["id"] for r in history.matching(both, search).collect())


def test_one_text_must_hold_it_all(spark, tmp_path):
    rows = [(1, "c", "first half", "second part", 0, None), (2, "c", "first half second part", None, 0, None), (None, "c", "first half", "", 0, None)]
    log = spark.createDataFrame(rows, LOG)
    index = SubstringIndex(spark, str(tmp_path / "i"), 4, 4)
    index.refresh(log)
    assert [r["id"] for r in index.matching(log, "half%part").collect()] == [2]
    assert sorted(r["id"] for r in index.candidates("first%half").collect()) == [1, 2]


def test_a_task_writes_a_bounded_share(spark, tmp_path, monkeypatch):
    from tessera.operators import substrings

    monkeypatch.setattr(substrings, "PART_BYTES", 50)
    log = _log(spark, 400)
    index = SubstringIndex(spark, str(tmp_path / "i"), 2, 2)
    index.refresh(log)
    rows, postings = ([spark.read.parquet(str(f)).count() for f in (tmp_path / "i" / name).rglob("*.parquet")] for name in ("rows", "postings"))
    assert sum(rows) == 400 and max(rows) < 400 / 2  # with one task for a place it has 200 or so
    assert max(postings) < sum(postings) / (2 * 8)  # and with eight for a bucket, a sixteenth
    for search in ("rollback", "pha%e"):
        assert sorted(r["id"] for r in index.matching(log, search).collect()) == sorted(r["id"] for r in history.matching(log, search).collect())
