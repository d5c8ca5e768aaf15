"""Each operator and each stage of the pipeline on awkward and on empty tables."""

import pytest

import corpus_pipeline
from tessera.llm import queries as llm
from tessera.runtime import load

DOCUMENT_QUERIES = [q for q in llm.queries() if q.split("_")[0] not in ("op4", "op9")]


@pytest.mark.parametrize("name", llm.queries())
def test_empty_table(spark, empty_dir, name):
    assert llm.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_edges_give_a_row_each(spark, edge_dir, name):
    rows = llm.queries()[name](spark, edge_dir).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["None", *map(str, [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10])])
    again = llm.queries()[name](spark, edge_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("name", ["op4_warc_archive", "op9_filter_urls"])
def test_pages_give_a_row_each(spark, edge_dir, name):
    rows = llm.queries()[name](spark, edge_dir).collect()
    assert sorted(str(r["page_id"]) for r in rows) == sorted(["1", "2", "3", "4", "4", "None", "5"])


def test_edge_values(spark, edge_dir):
    by = lambda name, key="doc_id": {r[key]: r for r in llm.queries()[name](spark, edge_dir).collect()}
    mix = by("op1_mix_sources")
    assert mix[1]["size"] == 0 and mix[10]["taken"] == 0 and mix[5]["size"] == 1
    prints = by("op2_edit_fingerprints")
    assert prints[6]["fingerprint"] == prints[7]["fingerprint"] and prints[1]["fingerprint"] == prints[10]["fingerprint"] and prints[10]["n_chars"] == 0
    quality = by("op3_quality_rules")
    assert quality[10]["n_words"] == 0 and not quality[10]["kept"] and quality[9]["n_dup_lines"] == 49
    archive = by("op4_warc_archive", "page_id")
    assert archive[3]["record_type"] == "revisit" and archive[3]["refers_to"] == 2 and archive[2]["payload_bytes"] == 0
    assert archive[5]["record_type"] == "response" and archive[None]["refers_to"] == 5
    toxic = by("op5_toxicity")
    assert all(0 <= r["score"] <= 1 for r in toxic.values()) and toxic[1]["score"] == toxic[10]["score"]
    lines = by("op6_line_dedup")
    assert lines[10]["text"] is None and lines[1]["text"] == "" and lines[9]["text"] == "a\n" * 50
    lang = by("op7_language_id")
    assert lang[10]["lang_pred"] == "und" and lang[2]["lang_pred"] == "und" and lang[4]["lang_pred"] != "und"
    bpe = by("op8_bpe_round_trip")
    assert bpe[10]["n_tokens"] == 0 and bpe[1]["ids_sha256"] == bpe[10]["ids_sha256"]
    near = by("op10_minhash_near_dedup")
    assert near[7]["component_id"] == 6 and not near[7]["kept"] and near[6]["kept"] and near[2]["n_shingles"] == 0 and near[2]["kept"] and near[3]["n_shingles"] == 1
    drawn = by("op11_importance_resampling")
    assert drawn[10]["n_features"] == drawn[1]["n_features"] == drawn[1]["weight"] == 0 and drawn[3]["n_features"] == 1 and drawn[9]["n_features"] == 99 and drawn[6]["weight"] > drawn[9]["weight"]
    assert drawn[4]["n_features"] == 2 * 48_000 - 1 and [drawn[i]["rank"] for i in (1, 3, 6, 10)] == [None] * 4 and {drawn[4]["rank"], drawn[9]["rank"]} == {None}
    cut = by("op12_suffix_dedup")
    assert cut[10]["n_bytes"] == cut[1]["n_removed"] == cut[6]["n_spans"] == 0 and cut[10]["kept_sha256"] == cut[1]["kept_sha256"]
    assert cut[4]["n_removed"] == cut[4]["n_bytes"] == 30 * 8000 and cut[5]["n_removed"] == 20_000 and cut[5]["n_spans"] == 1
    url = by("op9_filter_urls", "page_id")
    assert url[1]["rule"] == "www.example.com/en/" and url[1]["verdict"] == "allow" and url[5]["verdict"] == "block" and url[2]["rule"] is None and url[4]["host"] == ""


@pytest.mark.parametrize("folder", ["edge_dir", "empty_dir"])
def test_stages(spark, request, folder):
    docs = load(spark, request.getfixturevalue(folder), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
