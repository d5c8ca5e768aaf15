"""Repeated substrings against every window of every text."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import suffixes


def plain(texts, length, keep_first):
    """For each text (in order) the flags of covered bytes."""
    starts = defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            starts[t[s : s + length]].append((i, s))
    covered = [bytearray(len(t)) for t in texts]
    for found in starts.values():
        if len(found) > 1:
            for i, s in found[1:] if keep_first else found:
                covered[i][s : s + length] = b"\1" * length
    return covered


def corpus():
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [prose(n) for n in (30, 40, 41, 60, 90, 200)]
    texts = []
    for i in range(120):
        parts = [prose(rng.randrange(60)) for _ in range(rng.randrange(4))]
        for p in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(20)
            parts.insert(rng.randrange(len(parts) + 1), p[a:] if rng.random() < 0.4 else p)
        texts.append("".join(parts))
    # a line in most texts, whose surroundings differ; runs and periods; copies; edges
    texts += [prose(rng.randrange(30)) + shared[2] + prose(rng.randrange(30)) for _ in range(60)]
    texts += ["a" * 300, "ab" * 100, "abc" * 20 + "x" + "abc" * 30, texts[3], texts[3] + "!", texts[5], "", shared[1], shared[1][:-1], "é" * 50]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("bucket", [2048, 1])
def test_against_every_window(spark, monkeypatch, keep_first, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    texts = corpus()
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, row string, start int").repartition(3)
    got = {r["doc_id"]: r for r in suffixes.substring_report(df, 40, keep_first).collect()}
    for i, (t, mask) in enumerate(zip([t.encode() for t in texts], plain([t.encode() for t in texts], 40, keep_first), strict=True)):
        kept = bytes(b for b, m in zip(t, mask) if not m)
        edges = np.flatnonzero(np.diff(np.frombuffer(bytes(mask), np.uint8), prepend=0, append=0))
        want = (len(t), sum(mask), len(edges) // 2, hashlib.sha256(kept).hexdigest())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i


def test_whole_size_of_strings(spark):
    """At 200 bytes: 199 equal bytes stay, 200 go; a null text is an empty one; rows that repeat lose everything."""
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = prose(199), prose(200), prose(700)
    rows = [(1, "x" + a + "x"), (2, "y" + a + "y"), (3, "p" + b), (4, b + "q"), (5, c), (5, c), (6, None), (None, prose(50) + b), (7, "")]
    got = suffixes.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == sorted([("1", 0), ("2", 0), ("3", 200), ("4", 200), ("5", 700), ("5", 700), ("6", 0), ("None", 200), ("7", 0)])


def test_first_copy_stays(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    b = prose(250)
    rows = [(1, "one " + b, "s"), (2, b + " two", "s"), (3, "é" + b, None), (None, b, "s"), (4, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "one " + b, 2: " two", 3: "é", None: "", 4: None}
    with pytest.raises(ValueError, match="16"):
        suffixes.repeated_spans(df, 8)


def test_ranks_follow_bytes():
    data = np.frombuffer(b"banana bandana banana band " * 4, np.uint8)
    starts = np.arange(len(data) - 24 + 1)
    ranks = suffixes.ranks_of_windows(data, starts, 24)
    windows = [data[s : s + 24].tobytes() for s in starts]
    number = {w: i for i, w in enumerate(sorted(set(windows)))}
    assert ranks.tolist() == [number[w] for w in windows]
    earlier, later = suffixes.other_factors(np.array([0, 1, 0, 1, 0, 2, 2]), np.array([5, 3, 2, 3, 9, 1, 0]))
    assert earlier.tolist() == [True, False, False, False, True, True, False] and later.tolist() == [True, False, True, False, False, False, True]


def test_a_window_lies_in_one_surroundings_and_one_piece():
    """Surroundings of a text's anchors share no window and leave none out; so do pieces, and equal windows of one gram have equal cores."""
    rng = random.Random(8)
    prose = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage, length, found = prose(120), 40, defaultdict(set)
    for data in (prose(150) + passage + prose(90), prose(33) + passage, b"ab" * 90, prose(39), passage):
        places, low, high, _, gram, _ = suffixes.anchors_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length)
        assert [s for a, z in zip(low.tolist(), high.tolist(), strict=True) for s in range(a, z - length + 1)] == list(range(len(data) - length + 1))
        for place, a, z, g in zip(places.tolist(), low.tolist(), high.tolist(), gram.tolist(), strict=True):
            pieces = sorted(suffixes.pieces_of(data, place, a, z, length), key=lambda p: p["start"])
            assert [s for p in pieces for s in range(p["start"], p["end"] - length + 1)] == list(range(a, z - length + 1))
            for p in pieces:
                for s in range(p["start"], p["end"] - length + 1):
                    found[data[s : s + length]].add((g, p["core"]))
    assert all(len(x) == 1 for x in found.values())


def test_rows_of_a_hot_passage(spark, monkeypatch):
    """A passage in many different texts meets itself in pieces: fewer rows than bytes, in proportion to the texts."""
    monkeypatch.setattr(suffixes, "BUCKET", 8)
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = prose(400)

    def rows(n):
        counts = {}
        monkeypatch.setattr(suffixes, "materialize", lambda df, name: counts.update({name: df.count()}) or df)
        texts = spark.createDataFrame([(i, prose(250) + passage + prose(250)) for i in range(n)], "doc_id long, text string").cache()
        assert {r["n_removed"] >= 400 for r in suffixes.substring_report(texts).collect()} == {True}
        return counts["pieces"], counts["dealt"]

    few, many = rows(40), rows(80)
    assert many[0] + many[1] < 80 * 100
    assert sum(many) < 3 * sum(few)
