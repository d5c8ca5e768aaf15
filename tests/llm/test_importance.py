"""Importance resampling against a plain version, in many small blocks and parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance


def features(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target):
    """(doc_id, n_features, weight, score, rank) by counting in dictionaries."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, x in rows:
        f = features(x)
        gain = sum(math.floor(1000 * math.log((t[bucket(g)] + 1) * (all_s + 10000) / ((s[bucket(g)] + 1) * (all_t + 10000)))) for g in f)
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), x or ""))
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}={r[4]}".encode()).digest()))
    drawn = able[: 25 * len(able) // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted((*map(str, r[:4]), str(ranks.get(id(r)))) for r in out)


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["THE", "the", "é1", "日本", "a_b", "x-y"]
    rows = [(i, " ".join(["the"] * rng.randrange(9) + rng.choices(words, k=rng.randrange(120)))) for i in range(400)]
    rows += [(None, "one word more " * 9), (5, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (900, None), (901, ""), (902, "--"), (903, "A"), (904, "long " * 30_000)]
    target = [" ".join(rng.choices(words[:60], k=30)) for _ in range(20)] + [None, ""]
    return rows, target


@pytest.mark.parametrize("block, part", [(4 << 20, 1 << 20), (3000, 500)])
def test_against_plain(spark, tables, monkeypatch, block, part):
    rows, target = tables
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance, "PART_FEATURES", part)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, rank string, block int").repartition(3)
    got = importance.resampling_report(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert sorted(tuple(map(str, (r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]))) for r in got) == plain(rows, target)


def test_drawn_rows_are_whole(spark, tables):
    rows, target = tables
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, rank string")
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    drawn = importance.resampled(df, aim)
    assert drawn.columns == df.columns
    report = importance.resampling_report(df, aim).filter("rank is not null").collect()
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r["doc_id"]) for r in report) and len(report) > 50


def test_target_words_are_drawn(spark):
    """Documents in the words of the target come first; an empty target and an empty source do no harm."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"{'t' if i % 4 == 0 else 'o'}{j}" for j in range(50)], k=60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([(" ".join(f"t{j}" for j in range(50)),)] * 40, "text string")
    drawn = [r["doc_id"] for r in importance.resampled(df, aim).collect()]
    assert len(drawn) == 50 and sum(d % 4 == 0 for d in drawn) >= 30
    assert importance.resampling_report(df, aim.limit(0)).count() == 200
    assert importance.resampling_report(df.limit(0), aim).count() == 0
