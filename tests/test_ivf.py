"""The inverted file against the full search: exact rows, recall with few cells, cells left unread, hot cells, awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, ivf


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(25, 16))
    vectors = [(i, (centers[i % 25] + rng.normal(size=16) * 0.35).tolist(), i % 7) for i in range(2500)]
    vectors += [(3000 + i, vectors[5][1], 1) for i in range(1200)] + [(9000, [0.0] * 16, 2), (9001, None, 2)]  # a third are copies of one
    questions = [(i, (centers[i % 25] + rng.normal(size=16) * 0.35).tolist()) for i in range(60)] + [(90, [0.0] * 16), (91, None), (92, vectors[5][1])]
    return (
        spark.createDataFrame(vectors, "doc_id long, embedding array<float>, label int").repartition(4).cache(),
        spark.createDataFrame(questions, "item_id long, embedding array<float>").cache(),
    )


@pytest.fixture(scope="module")
def cells(tables, tmp_path_factory):
    keep, ivf.PART = ivf.PART, 200
    made = ivf.Cells.build(tables[0], str(tmp_path_factory.mktemp("ivf") / "index"), 30)
    ivf.PART = keep
    return made


def _rows(df):
    return sorted(map(str, df.select("item_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize("where", [None, {"label": {"$gte": 3}}])
def test_exact_rows(tables, cells, where):
    vectors, questions = tables
    want = _rows(dense.search(vectors, questions, 10, where))
    assert _rows(cells.search(questions, 10, 2, exact=True, where=where)) == want
    assert _rows(cells.search(questions, 10, len(cells.numbers), where=where)) == want


def test_recall_and_pruning(tables, cells):
    vectors, questions = tables
    some = questions.filter("item_id < 60")
    exact = {(r["item_id"], r["doc_id"]) for r in dense.search(vectors, some, 10).collect()}
    found = {(r["item_id"], r["doc_id"]) for r in cells.search(some, 10, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.95
    probes = cells._probes(some.filter("item_id = 3"), 5)
    plan = cells._scan(probes, 10, None, 6)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and probes.select("cell").distinct().count() == 5 < len(cells.numbers) / 4


def test_hot_cells_are_dealt(tables, cells):
    sizes = cells.vectors.groupBy("cell", "part").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 400 and sizes[1] == 3701


def test_few_and_no_vectors(spark, tables, tmp_path):
    vectors, questions = tables
    for name, few in (("none", vectors.limit(0)), ("one", vectors.filter("doc_id = 1")), ("zero", vectors.filter("doc_id = 9000"))):
        made = ivf.Cells.build(few, str(tmp_path / name))
        assert _rows(made.search(questions, 3, exact=True)) == _rows(dense.search(few, questions, 3)), name
