"""Fences that follow each group's own documents, and removal by row."""

import random

from tessera.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def _document(rng, words, lines, symbols=0, repeated=0, copies=0, letters=5):
    """Prose of so many distinct words in so many lines, with symbols, a run of words said twice, and copies of its first line."""
    made = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) + str(i) for i in range(words)]
    if repeated:
        made[-repeated:] = made[-2 * repeated : -repeated]
    made[:symbols] = [w + "#" for w in made[:symbols]]
    per = -(-words // lines)
    parted = [" ".join(made[i : i + per]) for i in range(0, words, per)]
    return "\n".join(parted + parted[:1] * copies)


def _groups():
    rng = random.Random(11)
    rows = [(i, _document(rng, 60, 4, symbols=i % 3), "en", "short") for i in range(120)]
    rows += [(200 + i, _document(rng, 900, 60, symbols=30 + i % 40, letters=8), "en", "long") for i in range(120)]
    return rng, rows


def test_each_group_has_its_own_fences(spark):
    rng, rows = _groups()
    counts = quality.document_counts(spark.createDataFrame(rows, SCHEMA))
    found = {r["source"]: r for r in quality.thresholds(quality.sketches(counts)).filter("level = 0").collect()}
    for rate, (_, _, side) in quality.RATES.items():
        assert found["short"][f"{rate}_high"] != found["long"][f"{rate}_high"], rate
        assert side == "high" or found["short"][f"{rate}_low"] != found["long"][f"{rate}_low"], rate
    assert found["short"]["size"] == found["long"]["size"] == 120


def test_one_outlier_of_each_rate(spark):
    """What is far off in one group passes in the other; every rate rejects, repeated words below the base rule's share too."""
    rng, rows = _groups()
    bad = {
        900: (_document(rng, 900, 60, symbols=400, letters=8), "long"),
        901: (_document(rng, 900, 60, copies=60, letters=8).replace(" ", " x ", 1), "long"),
        902: (_document(rng, 900, 60, symbols=40, repeated=120, letters=8), "long"),
        903: (_document(rng, 60, 4, letters=30), "short"),
        904: (_document(rng, 60, 4, symbols=40), "short"),
    }
    fine = {910: (_document(rng, 60, 4, repeated=8), "short"), 911: (_document(rng, 900, 60, symbols=66, letters=8), "long"), 912: (_document(rng, 900, 60, symbols=50, copies=2, letters=8), "long")}
    df = spark.createDataFrame(rows + [(i, t, "en", s) for i, (t, s) in {**bad, **fine}.items()], SCHEMA)
    got = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    rejected = {i for i, r in got.items() if not r["kept"]}
    assert rejected == bad.keys()
    assert not got[902]["base_failed"] and got[902]["n_repeat_words"] == 240 and not any(got[i]["base_failed"] for i in (900, 903, 904))


def test_rows_are_removed_by_their_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "a"), (1, "short", "en", "a"), (None, good + " more", None, None), (None, "short", None, None), (None, None, "en", None), (2, good, "de", "b"), (2, good, "de", "b")]
    kept = quality.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in spark.createDataFrame([r for r in rows if r[1] and r[1] != "short"], SCHEMA).collect())


def test_fences_of_small_groups_are_drawn_toward_the_language(spark):
    """A group's quartiles move smoothly with its size; a group without examples takes its language's, then everything's."""
    sketch = lambda level, lang, source, n, q: [(level, lang, source, r, q, n) for r in quality.SKETCHED]
    rows = sketch(0, "en", "few", 1, 1000) + sketch(0, "en", "many", 100_000, 1000) + sketch(0, None, None, 100, 400) + sketch(1, "en", None, 300, 200) + sketch(1, None, None, 100, 400) + sketch(2, None, None, 400, 100)
    found = quality.thresholds(spark.createDataFrame(rows, "level int, lang string, source string, rate string, bucket long, n long"))
    got = {(r["level"], r["lang"], r["source"]): r["symbol_rate_q3"] for r in found.collect()}
    language, unnamed = (300 * 200 + 100 * 100) // 400, (100 * 400 + 100 * 100) // 200
    assert got == {
        (2, None, None): 100, (1, "en", None): language, (1, None, None): unnamed, (0, "en", "few"): (1000 + 100 * language) // 101,
        (0, "en", "many"): (100_000 * 1000 + 100 * language) // 100_100, (0, None, None): (100 * 400 + 100 * unnamed) // 200,
    }


def test_fences_follow_a_documents_own_size(spark):
    """Of two documents with one rate of repeated lines or words, the long one is an outlier and the short one is chance."""
    rng = random.Random(5)
    rows = [(i, _document(rng, 60, 15), "en", "a") for i in range(150)]
    # words end in their number, so longer texts take fewer letters
    rows += [(500, _document(rng, 60, 15, copies=2), "en", "a"), (501, _document(rng, 900, 225, copies=30, letters=4), "en", "a")]
    rows += [(502, _document(rng, 150, 15, repeated=21), "en", "a"), (503, _document(rng, 6000, 15, repeated=850, letters=3), "en", "a")]
    # few events in a very long text are no outlier
    rows += [(504, _document(rng, 6000, 1500, symbols=20, copies=10, repeated=24, letters=3), "en", "a")]
    got = {r["doc_id"]: r for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i]["base_failed"] for i in range(500, 505))
    assert 40 * got[502]["n_repeat_words"] <= got[503]["n_repeat_words"] and 2 * 255 == 17 * 30
    assert {i: r for i, r in got.items() if not r["kept"]}.keys() == {501, 503}, got[504]
