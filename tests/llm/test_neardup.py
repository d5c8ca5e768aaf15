import random

import numpy as np

from brute import components
from tessera.llm import graph, neardup
from tessera.runtime import load


def _found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}


def test_small_tables(spark, small):
    docs = load(spark, small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert _found(docs) == components(rows)


def test_dense_groups_lose_no_link(spark, monkeypatch):
    """Copies of one text with a few changed words, many of them near the threshold, and texts that share a passage."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: rng.randint(90, 120)]
        rows.append((i, " ".join(w)))
    for i in range(150, 190):
        own = [f"own{i}_{j}" for j in range(rng.randint(5, 60))]
        rows.append((i, " ".join(passage + own)))
    rows += [(190, rows[3][1].upper()), (191, rows[160][1])]
    rng.shuffle(rows)
    want = components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(df) == want
    monkeypatch.setattr(neardup, "SHORT_LIST", 2)  # everything through the prefixes of full sets
    assert _found(df) == want


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 2**63, 500, dtype=np.uint64)])
    x, y = (np.frombuffer(neardup.long_signature(np.unique(s)), np.uint16) for s in (a, b))
    assert abs((x == y).mean() - 1500 / 2500) < 0.1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 150)] + [(200, 200), (None, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b), (3, b + " end"), (4, a + " more"), (4, a + " more")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False)]


def test_rows_without_id_link(spark):
    """A row without doc_id links as any other; alone, or only among its like, its component has no id."""
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["other"] + base[51:]
    lone, twin = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    rows = [(None, base), (7, near), (8, [*near, "end"]), (None, lone), (None, twin), (None, [*twin, "end"]), (9, ["short"])]
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    want = [(None, 96, 7, False), (7, 96, 7, True), (8, 97, 7, False), (None, 56, None, True), (None, 56, None, True), (None, 57, None, True), (9, 1, 9, True)]
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got))) == sorted(map(str, want))


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "x"), (6, c, "x"), (6, c, "y"), (6, c, "x"), (None, c, "z"), (None, None, "x"), (None, None, "x"), (1, " ", "x"), (None, "one", "x"), (None, "one", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = neardup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in [(5, a), (3, b), (6, c), (None, None), (None, None), (1, " "), (None, "one")])
    same = neardup.drop_near_duplicates(df).collect()
    assert sorted(map(str, same)) == sorted(map(str, got.collect()))


def test_a_hub_is_dealt_over_parts(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(7, 500)], "a long, b long")
    found = {(r["a"], r["b"]): r["m"] for r in graph.with_least(edges).collect()}
    assert len(found) == 500 and found[7, 500] == 500 and {m for (a, _), m in found.items() if a == 0} == {1}
