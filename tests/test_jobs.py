"""Both jobs on copies of the small tables, run again over the same and over growing input, and their command lines."""

import glob
import json
import os
import subprocess
import sys

import pytest

from compare import assert_same, views
from conftest import ROOT
from jobs import build_index, common, ingest_documents
from jobs import queries as jobs
from tessera.operators import bm25, inverted
from tessera.sources.buckets import BucketedTable


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_query_against_sql(spark, small, name):
    before = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert_same(jobs.queries()[name](spark, small), views(small), jobs.oracle_sql()[name])
    assert before == (dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def _drop(spark, rows, inbox):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(inbox)


def _files(path):
    return {f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_ingestion_takes_what_is_new(spark, tmp_path):
    inbox = str(tmp_path / "in")
    config = ingest_documents.KNOWN | {"documents": inbox, "chunks": str(tmp_path / "chunks"), "checkpoint": str(tmp_path / "mark"), "buckets": 50, "chunk_size": 10}
    _drop(spark, [(i, f"text number {i}", "a") for i in range(40)] + [(1, "of b", "b"), (2, None, None), (3, "", "b")], inbox)
    assert ingest_documents.run(spark, config)["documents"] == 43
    first, files = sorted(map(str, ingest_documents.read(spark, config).collect())), _files(config["chunks"])
    assert len(first) == 40 * 2 + 3
    # nothing new: nothing is read or written
    assert ingest_documents.run(spark, config) == {"batches": 0, "documents": 0, "folders": 0} and _files(config["chunks"]) == files
    # one changed, one new document: two folders of theirs are written, no other
    _drop(spark, [(7, "changed", "a"), (100, "new", "c")], inbox)
    assert ingest_documents.run(spark, config) == {"batches": 1, "documents": 2, "folders": 2}
    after = _files(config["chunks"])
    assert len({os.path.dirname(f) for f in files - after}) == 1 and len({os.path.dirname(f) for f in after - files}) == 2
    rows = ingest_documents.read(spark, config)
    assert [r["text"] for r in rows.filter("doc_id = 7").collect()] == ["changed"] and [r["source"] for r in rows.filter("doc_id = 100").collect()] == ["c"]
    assert len(set(first) - set(map(str, rows.collect()))) == 2
    # a document that became empty leaves a row that says so
    _drop(spark, [(7, "", "a")], inbox)
    ingest_documents.run(spark, config)
    assert [(r["status"], r["text"]) for r in rows.sparkSession.read.parquet(config["chunks"]).filter("doc_id = 7").collect()] == [("empty", None)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "doc_id long, v string, source string", "source", "doc_id", 1000)
    assert table.rows().count() == 0
    rows = spark.createDataFrame([(i, "old", "s") for i in range(300)] + [(None, "none", None)], "doc_id long, v string, source string")
    table.merge(rows)
    change = spark.createDataFrame([(5, "new", "s"), (5, "newer", "s")], "doc_id long, v string, source string")
    assert table.merge(change) == 1  # one row's folder of the 260 or so
    once = sorted(map(str, table.rows().collect()))
    assert table.merge(change) == 1 and sorted(map(str, table.rows().collect())) == once and len(once) == 302
    assert table.merge(change.limit(0)) == 0 and table.merge(rows.filter("doc_id is null")) == 1 and table.rows().count() == 302


def test_the_index_is_rebuilt_by_tenant(spark, small, tmp_path):
    copy, index = str(tmp_path / "documents"), str(tmp_path / "index")
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    documents.write.parquet(copy)
    config = build_index.KNOWN | {"documents": copy, "index": index, "buckets": 4}
    once = build_index.run(spark, config)
    assert once["documents"] == documents.count() and build_index.run(spark, config) == once
    name = documents.first()["source"]
    documents.filter(documents.source == name).write.mode("overwrite").parquet(str(tmp_path / "one"))
    assert build_index.run(spark, config | {"documents": str(tmp_path / "one")})["blocks"] == once["blocks"]
    questions = spark.read.parquet(f"{small}/benchmark.parquet")
    found = inverted.search(build_index.read(spark, index), questions, 3, "source", buckets=4)
    assert sorted(map(str, found.collect())) == sorted(map(str, bm25.search(documents, questions, 3, "source").collect()))


def test_configuration(tmp_path):
    path = str(tmp_path / "c.json")
    json.dump({"documents": "x", "buckets": 3}, open(path, "w"))
    assert common.load_config(path, {"documents": "y", "index": None}, {"documents": "", "index": "z", "buckets": 1}) == {"documents": "y", "index": "z", "buckets": 3}
    with pytest.raises(ValueError, match="without a value: index"):
        common.load_config(path, {}, {"documents": "", "index": "", "buckets": 1})
    with pytest.raises(ValueError, match="unknown settings"):
        common.load_config(path, {}, {"documents": ""})


def test_command_line(spark, tmp_path):
    inbox = str(tmp_path / "in")
    _drop(spark, [(1, "some words", "a"), (2, "other words", "b")], inbox)
    args = ["--documents", inbox, "--chunks", str(tmp_path / "chunks"), "--checkpoint", str(tmp_path / "mark")]
    environment = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/ingest_documents.py", *args], capture_output=True, text=True, timeout=240, env=environment, cwd=str(tmp_path))
    assert done.returncode == 0, done.stderr[-2000:]
    assert "took 2 documents in 1 batches" in done.stderr
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
