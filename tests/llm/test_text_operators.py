"""Fingerprints, line dedup, language ID and toxicity against re-derivations, planted cases and held-out rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp
from tessera.llm import langid, linededup, toxicity
from tessera.llm import queries as llm
from tessera.llm.words import Tokens
from tessera.runtime import load


def test_edit_report_against_single_texts(spark, small):
    docs = load(spark, small, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fp.edit_report(docs, buckets=7).collect()}
    own = [fp.fingerprints_of([t])[0] for _, t in rows]
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own[i])
        assert r["edited_fingerprint"] == fp.fingerprints_of([edited])[0]
        assert r["near_edited"] == fp.likeness(own[i], r["edited_fingerprint"]) and r["near_next"] == fp.likeness(own[i], own[(i + 1) % len(rows)])
    near, far = [r["near_edited"] for r in got.values()], [r["near_next"] for r in got.values()]
    assert np.median(near) > 0.6 > 0.3 > np.quantile(far, 0.95)


def test_one_document_follows_itself(spark):
    row = fp.edit_report(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert row[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row[0]["near_next"] == 1.0


def test_walks_side_by_side_and_alone(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300))) for _ in range(120)]
    many = fp.fingerprints_of(texts)
    monkeypatch.setattr(fp.Walker, "SIDE_BY_SIDE", 1000)
    assert many == fp.fingerprints_of(texts)


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(2000))

    def edited(n):
        s = list(base)
        for _ in range(n):
            s[rng.randrange(len(s))] = rng.choice(["", "x", "yz"])
        return "".join(s)

    values = [np.mean([fp.likeness(*fp.fingerprints_of([base, edited(n)])) for _ in range(10)]) for n in (1, 10, 40, 160)]
    assert values == sorted(values, reverse=True) and values[0] > 0.8 and values[-1] < 0.45


def test_similar_documents(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
    rows = [(1, base), (2, base), (3, base[:700] + "qqvvzzww" * 6 + base[760:]), (4, "".join(rng.choice("etaoin shrdlu") for _ in range(1500))), (5, None)]
    prints = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["a"], r["b"]) for r in fp.similar_documents(prints).collect()} == {(1, 3)}


def _walked(text, walk, places):
    """The characters under a walk at steps 1.., one step after another; None once the text has ended."""
    leave, out, i, step = fp.LEAVE[walk], [], 0, 0
    classes = fp.classes_of(text)
    goes = lambda c, s: leave[c, s % fp.PERIOD] == 1
    while step < places:
        out.append(None if i == len(text) else int(fp.DIGIT_OF[classes[i]]))
        if i < len(text) and goes(classes[i], step):
            i += 1
        step += 1
    return out


def test_fingerprint_against_a_literal_walk():
    rng = random.Random(8)
    for n in (0, 1, 5, 40, 300):
        text = "".join(rng.choice("etaoin shrdluéß\n") for _ in range(n))
        (made,) = fp.fingerprints_of([text])
        for walk, part in enumerate(made.split("..")):
            octaves = part.split(".")
            under = _walked(text, walk, 1 << (len(octaves) + 1))
            for octave, digits in enumerate(octaves):
                want = [under[step - 1] for step in fp.sample_steps(octave)]
                assert digits == "".join(fp.END if x is None else fp.DIGITS[x] for x in want)
            assert len(octaves) == max(1, sum(x is not None for x in under).bit_length())


def test_hot_and_missing_ids_fill_several_buckets(spark):
    """Most rows bear one doc_id or none; the report is that of all rows in order, whatever the number of buckets."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)] + [(7, texts[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = fp.Buckets([1, 7, 7, 7, 50], 4)
    used = df.select(cuts.number(df.doc_id, F.xxhash64("text")).alias("b"), "doc_id").distinct().collect()
    assert len({r["b"] for r in used if r["doc_id"] == 7}) == 3 and len({r["b"] for r in used if r["doc_id"] is None}) == 4 and cuts.n == 11
    few, many = ([str(r) for r in fp.edit_report(df, n).collect()] for n in (1, 9))
    assert len(few) == len(rows) and sorted(few) == sorted(many)


def test_similar_documents_of_nothing(spark):
    """Empty tables, rows without doc_id and texts too short for bands have no pairs; equal texts are one class."""
    schema = "doc_id long, text string"
    for rows in ([], [(None, "some text that is long enough to have bands of its own")] * 3, [(1, ""), (2, None), (3, "a"), (4, "b")], [(1, "x" * 90), (2, "x" * 90)]):
        assert fp.similar_documents(fp.fingerprint_documents(spark.createDataFrame(rows, schema))).count() == 0
    assert fp.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0


def test_similar_documents_behind_an_unlike_head(spark, monkeypatch):
    """Every band holds classes that are unlike its first ones; no link is lost and recall against all pairs is measured."""
    monkeypatch.setattr(fp, "HEADS", 2)
    rng = random.Random(10)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(900)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for k in range(3):
            at = rng.randrange(800)
            rows.append((100 + 3 * i + k, t[:at] + rng.choice(["xy", "z", ""]) + t[at + 2 :]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint_documents(df).collect()}
    prints = {d: p for d, p in prints.items() if d == min(x for x, q in prints.items() if q == p)}  # of a class, its representative
    shared = {d: set(fp.bands(p)) for d, p in prints.items()}
    pairs = {(a, b): fp.likeness(prints[a], prints[b]) for a in prints for b in prints if a < b}
    want = {p for p, near in pairs.items() if near >= 0.6 and shared[p[0]] & shared[p[1]]}
    got = {(r["a"], r["b"]) for r in fp.similar_documents(fp.fingerprint_documents(df)).collect()}
    assert got == want
    assert len(want) >= 0.9 * sum(near >= 0.6 for near in pairs.values()) > 0


def test_tokens_of_many_texts():
    """The words of each text as split() gives them; equal words, and only these, have equal hashes."""
    rng = random.Random(16)
    texts = ["", None, "a", " a\x0bb\tc ", "é\u00a0x \u3000y", "no gap", "between texts", "z" * 255 + " " + "z" * 256 + " " + "z" * 257, "z" * 700 + "y " + "z" * 700 + "x", " "]
    texts += ["".join(rng.choices("ab é\n\x1c", k=rng.randint(0, 40))) for _ in range(200)]
    tokens = Tokens.of(pa.array(["skipped", *texts]).slice(1))
    found = [(int(o), tokens.data[s : s + n].tobytes()) for o, s, n in zip(tokens.owner, tokens.start, tokens.length, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    by_hash = {}
    for (_, w), h in zip(found, tokens.hashes().tolist(), strict=True):
        by_hash.setdefault(h, set()).add(w)
    assert all(len(ws) == 1 for ws in by_hash.values()) and len(by_hash) == len({w for _, w in found})
    assert len(Tokens.of(pa.array([], pa.string())).hashes()) == 0


PASSAGE = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))


def _hosts():
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = []
    for i in range(40):
        lines = [line(12) for _ in range(6)]
        if i < 12:
            lines.insert(3, PASSAGE)
        if 5 <= i < 30:
            lines.append(f"Copyright 20{i} example press all rights reserved number {i}7")
        rows.append((i, "\n".join(lines)))
    whole = "\n".join(line(15) for _ in range(5))
    rows += [(100 + i, whole) for i in range(20)]  # exact copies
    rows += [(200 + i, "\n".join(line(12) for _ in range(4)) + "\nyes") for i in range(15)]  # a line too short to be a template
    return rows


def test_passages_and_templates_go_and_copies_stay(spark):
    rows = _hosts()
    got = {r["doc_id"]: r for r in linededup.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = "\n".join(x for x in text.split("\n") if x != PASSAGE and not x.startswith("Copyright"))
        assert got[i]["text"] == want
        assert got[i]["n_dropped"] == text.count("\n") - want.count("\n")


def test_described_lines():
    line = "the server at {} answered with an error and was shut down at once today"
    owner, rows = linededup.describe(pa.array([line.format(x) for x in ("north", "south", "17", "x18y")]))
    a, b, c, d = rows.to_pylist()
    assert owner.tolist() == [0, 1, 2, 3] and a["leads"] == b["leads"] and a["line"] != b["line"] and c["line"] == d["line"] and c["lines"] == d["lines"]
    assert len(a["segments"]) == linededup.SEGMENTS and sum(p == q for p, q in zip(a["segments"], b["segments"], strict=True)) == linededup.SEGMENTS - 1
    texts = ["one two three\n\nfour five six seven\none two three", "one two three", None, "a b\nc", "漢字" * 40]
    owner, rows = linededup.describe(pa.array(texts))
    got = list(zip(owner.tolist(), rows.column("n_tokens").to_pylist(), rows.column("size").to_pylist(), rows.column("segments").to_pylist(), strict=True))
    assert sorted((o, n, size, len(x)) for o, n, size, x in got) == [(0, 3, 3, 0), (0, 4, 4, 1), (1, 3, 3, 0), (4, 1, 15, 0)]
    assert linededup.describe(pa.array([], pa.string()))[1].num_rows == 0


def _by_brute_force(texts):
    """Lines that recur by the template tree, where all texts are different hosts: every leaf and every choice of segments is tried."""
    hosts = {}
    for i, text in enumerate(texts):
        for line in set(text.split("\n")):
            tokens = tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
            n = len(tokens)
            least = next(c for size, c in linededup.LEAST_CONTEXTS if n >= size)
            hosts.setdefault((tokens, least, "line"), []).append((i, line))
            if n < linededup.GENERAL_TOKENS:
                continue
            k = min(linededup.SEGMENTS, n - 3)
            segments = [tokens[3 + (n - 3) * j // k : 3 + (n - 3) * (j + 1) // k] for j in range(k)]
            for wild in (None, 0, 1, 2):
                leads = tuple(None if j == wild else t for j, t in enumerate(tokens[:3]))
                varying = max(b for b in range(linededup.MOST_VARIABLE + 1) if b == 0 or b <= k and 3 * ((n - 3) * b + k * (wild is not None)) <= n * k)
                for gone in itertools.combinations(range(k), varying):
                    key = (n, leads, gone, tuple(x for j, x in enumerate(segments) if j not in gone))
                    hosts.setdefault((key, 2 * least, "template"), []).append((i, line))
    out = set()
    for (_, least, kind), held in hosts.items():
        if len({i for i, _ in held}) >= least and (kind == "line" or len({tuple("<*>" if any(c.isdigit() for c in t) else t for t in x.split()) for _, x in held}) > 1):
            out |= set(held)
    return out


def test_template_tree_against_brute_force(spark):
    """Lines of templates with fields anywhere, from few words or many, over enough hosts or too few, among lines that are like them by chance."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9)))
    few = [word() for _ in range(5)]
    forms = ["user {} logged in from host {} at noon", "{} wrote this piece", "read more about {} here", "the {} of {} is {} and the {} of {} is {}", "a b c d e {} g h i {} k l m {} o p q r", "posted on {} by {} in news", "x {} y {}"]
    texts = []
    for i in range(240):
        own = [" ".join(word() for _ in range(rng.randint(7, 14))) for _ in range(4)]
        form = forms[i % len(forms)]
        fields = [rng.choice(few) if rng.random() < 0.4 else str(rng.randrange(99)) if rng.random() < 0.2 else word() for _ in range(form.count("{}"))]
        own.insert(rng.randrange(4), form.format(*fields))
        texts.append("\n".join(own))
    want = _by_brute_force(texts)
    assert 100 < len(want) < 240
    got = _dropped(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == "\n".join(x for x in text.split("\n") if (i, x) not in want), (text, got[i])


@pytest.mark.parametrize("form", ["user {} logged in from host {} in the east wing", "the user {} logged in from host {} at gate {}", "the server log says that {} came in from host {} and then from {} at noon"])
def test_word_fields_generalise(spark, form):
    """Sixty documents, each with lines of its own and one of a form with words for fields."""
    line = _prose(31)
    texts, want = [], []
    for _ in range(60):
        own = [line() for _ in range(4)]
        texts.append("\n".join([*own[:2], form.format(*(line(1) for _ in range(form.count("{}")))), *own[2:]]))
        want.append("\n".join(own))
    assert _dropped(spark, texts) == dict(enumerate(want))


def test_navigation_lines_around_one_own_line(spark):
    line = _prose(33)
    menu, footer = [line(4) for _ in range(10)], line(9)
    own = [line(14) for _ in range(12)]
    assert _dropped(spark, ["\n".join([*menu, x, footer]) for x in own]) == dict(enumerate(own))


def test_what_has_only_recurring_lines(spark):
    """A patchwork of recurring lines is emptied; of a text that is there twice both rows stay whole. Lines of unspaced scripts recur too."""
    line = _prose(34)
    shared, unspaced = [line(12) for _ in range(4)], "網站地圖聯絡我們隱私政策" * 6
    texts = ["\n".join([line() for _ in range(4)] + [s for k, s in enumerate([*shared, unspaced]) if k != i % 5]) for i in range(20)]
    got = _dropped(spark, [*texts, "\n".join([shared[2], "", unspaced, shared[0]]), *["\n".join(shared[1:3])] * 2])
    assert [got[i] for i in range(20)] == ["\n".join(t.split("\n")[:4]) for t in texts]
    assert got[20] == "" and got[21] == got[22] == "\n".join(shared[1:3])


def test_language_held_out(spark, small):
    docs = load(spark, small, "documents")
    got = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.95


def _ppm(grams, context, byte):
    """Probability of a byte after a context by escapes with exclusion, from all grams of four bytes; the slow, literal way."""
    seen = {}
    for g in grams:
        if g[len(g) - 1 - len(context) : -1] == context:
            seen[g[-1]] = seen.get(g[-1], 0) + 1
    shorter = (lambda b: _ppm(grams, context[1:], b)) if context else (lambda b: 1 / 256)
    if not seen:
        return shorter(byte)
    whole = sum(seen.values()) + (len(seen) if len(seen) < 256 else 0)
    if byte in seen:
        return seen[byte] / whole
    return len(seen) / whole * shorter(byte) / (1 - sum(shorter(b) for b in seen))


def _model(**texts):
    counted = [np.unique(langid.grams(langid.fold(t)), return_counts=True) for t in texts.values()]
    return langid.Model(list(texts), [g for g, _ in counted], [n for _, n in counted])


def test_code_lengths_against_literal_version():
    text = "abracadabra abba\ncab é"
    model = _model(x=text)
    padded = b"\n" * 3 + langid.fold(text)
    grams = [padded[i : i + 4] for i in range(len(padded) - 3)]
    (tree,) = langid.trees(model)
    for context in (b"abr", b"bra", b"\n\n\n", b"bzb", b"zza", b"zzz"):
        every = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
        p = np.exp2(-tree.lengths(every))
        assert p.sum() == pytest.approx(1)
        for byte in (*b"abcz \n", 0xC3, 0xFF):
            assert p[byte] == pytest.approx(_ppm(grams, context, byte))
    raw = b"\n" * 3 + langid.fold("Cabbage é")
    want = -sum(np.log2(_ppm(grams, raw[i : i + 3], raw[i + 3])) for i in range(len(raw) - 3))
    bits = langid.text_bits(model, ["Cabbage é", "", None])
    assert bits[0, 0] == pytest.approx(want) and not bits[1:].any()
    assert langid.predict(_model(a=text, b=text), ["cab"]) == [("a", 0.5)]


def test_a_full_context_has_no_escape():
    raw = bytes(range(256)) * 2
    g, n = np.unique(langid.grams(raw), return_counts=True)
    (tree,) = langid.trees(langid.Model(["x"], [g], [n]))
    every = (np.arange(256) | 0x01010100).astype(np.uint32)
    assert np.exp2(-tree.lengths(every)).sum() == pytest.approx(1)


def test_many_languages_and_scripts(spark):
    """Sixty languages in three scripts, each with syllables of its own; rare ones are learned too, whatever the block of bytes."""
    rng = random.Random(12)
    rows, i = [], 0
    for k in range(60):
        first = (0x61, 0x430, 0x4E00)[k % 3]
        letters = [chr(first + rng.randrange(24 if k % 3 < 2 else 400)) for _ in range(14)]
        syllables = ["".join(rng.choices(letters, k=2)) for _ in range(25)]
        for _ in range(30 if k else 300):
            rows.append((i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(40)), f"l{k:02}"))
            i += 1
    got = {r["doc_id"]: r for r in langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(d, lang) for d, _, lang in rows if got[d]["held_out"]]
    assert len({lang for _, lang in held}) == 60
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.97


def test_toxicity_held_out_and_gradients(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    scores = {r["doc_id"]: r for r in llm.queries()["op5_toxicity"](spark, folder).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if scores[r["doc_id"]]["held_out"]}
    assert docs.count() == len(scores) and all(zlib.crc32(str(d).encode()) % 3 == 1 for d in truth)
    good, bad = ([scores[d]["score"] for d in truth if truth[d] == y] for y in (0, 1))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in scores.values())


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    projected = rng.normal(0, 1, (5, 3, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    label, weight = np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32)

    def loss():
        z = net.forward(projected, mask).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - label * z)).mean())

    grads, dprojected = net.gradients(projected, mask, label, weight)
    for name in ("forward", "backward", "attend", "context", "out", "out_bias"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-2
            up = loss()
            flat[i] = kept - 1e-2
            down = loss()
            flat[i] = kept
            assert (up - down) / 2e-2 == pytest.approx(g[i], abs=2e-3, rel=0.05), name
    projected[1, 2, 4] += 1e-2
    up = loss()
    projected[1, 2, 4] -= 2e-2
    assert (up - loss()) / 2e-2 == pytest.approx(dprojected[1, 2, 4], abs=2e-3, rel=0.05)


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 1000):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def _dropped(spark, texts):
    got = linededup.without_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["text"] for r in got}


def _prose(seed):
    rng = random.Random(seed)
    return lambda n=12: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.mark.parametrize("hosts", [2, 3])
def test_long_passages_recur_from_two_hosts(spark, hosts):
    """A passage of six lines goes from every host, a shorter one stays, and copies and near copies of one text stay whole."""
    line = _prose(hosts)
    passage, short = [line(n) for n in (12, 9, 14, 3, 12, 11)], [line(), line()]
    texts, want = [], []
    for k in range(hosts):
        own = [line() for _ in range(6 + k)]
        texts.append("\n".join([*own[:2], *passage, *own[2:4], *short, *own[4:]]))
        want.append("\n".join([*own[:4], *short, *own[4:]]))
    whole = [line() for _ in range(12)]
    for k in range(hosts):
        edited = whole[:]
        edited[k * 3] = " ".join([*edited[k * 3].split()[:-1], line(1)])
        texts += ["\n".join(whole), "\n".join(edited)]
    texts.append("\n".join(whole[:7]))
    assert _dropped(spark, texts) == dict(enumerate(want + texts[hosts:]))


def test_hosts_that_share_most_lines(spark):
    """A licence of 21 lines in 20 documents that have one line each of their own."""
    line = _prose(5)
    licence = [line() for _ in range(21)]
    own = [line() for _ in range(20)]
    assert _dropped(spark, ["\n".join([*licence[:9], x, *licence[9:]]) for x in own]) == dict(enumerate(own))


def test_toxicity_of_unspaced_text():
    """Every run of six bytes of a word of any length enters, and a toxic phrase far inside it moves the score."""
    word = "".join(chr(0x4E00 + i) for i in range(300)).encode()
    pieces = toxicity.words_of(word.decode())
    assert all(len(p) <= toxicity.WORD_BYTES for p in pieces)
    assert all(any(word[i : i + 6] in p for p in pieces) for i in range(len(word) - 5))
    assert toxicity.words_of("a" * 64) == [b"a" * 64] and toxicity.words_of("b" * 65)[-1].endswith(b"b")
    rng = random.Random(3)
    clean = lambda n: "".join(chr(0x4E00 + rng.randrange(200)) for _ in range(n))
    bad = "黑暗仇恨辱骂"
    texts = [clean(60 + i % 40) + (bad if i % 2 else "") + clean(50) for i in range(120)]
    network = toxicity.train(texts, [i % 2 for i in range(120)])
    low, high = toxicity.Scorer(network).scores([(x := clean(90)) + clean(40), x + bad + clean(40)])
    assert high > 0.7 > 0.3 > low


def test_a_leaf_has_many_templates(spark):
    """Two templates of one leaf, and one of five tokens, each with a variable word; another one has too few hosts."""
    line = _prose(9)
    forms = ["posted here by {} in the news section of our site today", "posted here by {} who also wrote many other long fine pieces", "posted here by {} today"]
    rare = "posted here by {} when nobody else cared to look for it"
    texts, want = [], []
    for i in range(42):
        own = [line() for _ in range(4)] + ([rare.format(line(1))] if i < 6 else [])
        texts.append("\n".join([*own[:2], forms[i % 3].format(line(1)), *own[2:]]))
        want.append("\n".join(own))
    assert _dropped(spark, texts) == dict(enumerate(want))


@pytest.mark.parametrize("hosts", [9, 10])
def test_hosts_of_a_template_are_merged_from_its_lines(spark, hosts):
    """A line in near copies of one text, which are one host, and its variants in other texts: the template recurs from ten hosts on."""
    line = _prose(35)
    form, whole = "the server says that {} has left us for good today", [line(9) for _ in range(12)]
    texts, want = [], []
    for k in range(15):
        edited = whole[:]
        edited[k % 6] = " ".join([*edited[k % 6].split()[:-1], line(1)])
        texts.append("\n".join([*edited[:4], form.format("north"), *edited[4:]]))
        want.append("\n".join(edited))
    for _ in range(hosts - 1):
        own = [line() for _ in range(4)]
        texts.append("\n".join([*own, form.format(line(1))]))
        want.append("\n".join(own))
    assert _dropped(spark, texts) == dict(enumerate(want if hosts == 10 else texts))


def test_rows_of_a_hot_line_of_many_templates(spark, monkeypatch):
    """A line in many texts, with variants in others, stands in dozens of templates: hosts are not counted for each text and template."""
    line = _prose(36)
    hot = line(19).split()

    variants = [" ".join([*hot[:at], line(1), *hot[at + 1 :]]) for at in range(3, 19) for _ in range(8)]
    texts = ["\n".join([line(), line(), x]) for x in [" ".join(hot)] * 320 + variants]
    made, materialized = {}, linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, name: made.setdefault(name, []).append(out := materialized(df, name)) or out)
    assert _dropped(spark, texts) == {i: "\n".join(t.split("\n")[:2]) for i, t in enumerate(texts)}
    rows = sum(x.count() for name in ("keyed", "merged") for x in made.get(name, []))  # of keys and texts whose hosts are counted
    assert rows < linededup.MOST_HOSTS * len(texts)
