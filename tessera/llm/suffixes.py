"""Exact duplicates of substrings, by arrays of longest previous factors over a sampled suffix array.

A repeated string of LENGTH bytes holds the same sampled grams wherever it stands: of the grams in each window of LENGTH bytes, the one with
the least hash is its anchor (the last of equal ones). Only suffixes around anchors whose gram occurs again can repeat, so the suffix array is made of these:

1. Anchors, with a hash of their surroundings (the windows of LENGTH bytes whose anchor they are, so that each window lies in one), are
   counted, those that are equal within a text where it is read. An anchor that occurs once drops out with its suffixes. Occurrences with equal surroundings repeat in all their windows; the first stands for them.
2. Different surroundings of one anchor form a bucket of the suffix array. A bucket's suffixes, one for each window, are sorted by
   their first LENGTH bytes (doubling ranks). In suffix order the previous and the next smaller position tell whether an equal window lies
   earlier; the previous and next larger, whether one lies later.
3. A bucket of very many surroundings is not sorted in one task: its windows are dealt in small pieces, by a digest of the bytes that all
   windows of a piece share. A piece of which these occur once has no repeated window. Of pieces that are equal as a whole the first stands for
   them; only where pieces differ around equal bytes are their windows dealt one by one, and first and last positions are aggregates.

Windows with an earlier (or any other) equal are covered: later copies go and the first stays, or all go.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import slices
from tessera.llm.neardup import row_key
from tessera.llm.words import mix
from tessera.runtime import discard, materialize

#: Bytes of a repeated string.
LENGTH = 200
#: Surroundings of an anchor that one task sorts; more are dealt by window.
BUCKET = 2048
#: Bytes of surroundings that are sorted at once, beyond a whole bucket.
SORT_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(12).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    whole = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    whole[: len(values)] = values
    whole = whole.reshape(-1, width)
    upto = np.minimum.accumulate(whole, axis=1).ravel()
    onward = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, texts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another: the anchors' places in ``data``, where their surroundings start and end, their texts, hashes of their grams and of their surroundings."""
    gram = length // 2
    sizes = np.diff(texts)
    owner = np.flatnonzero(sizes >= length)
    if not len(owner):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    grams = rolling.of(at, at + gram)
    least = least_of_runs((grams & ~_LOW) | (_LOW - at.astype(np.uint64)), length - gram + 1)
    fits = np.zeros(len(data) + 1, np.int8)  # windows that lie within one text
    np.add.at(fits, texts[owner], 1), np.add.at(fits, texts[owner + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(fits, dtype=np.int8)[: len(least)] > 0)
    places = (_LOW - (least[windows] & _LOW)).astype(np.int64)
    begins = np.flatnonzero(np.diff(places, prepend=-1))  # the windows of an anchor follow one another
    low, high = windows[begins], windows[np.append(begins[1:], len(windows)) - 1] + length
    places = places[begins]
    shape = (places - low).astype(np.uint64) << np.uint64(32) | (high - places).astype(np.uint64)
    return places, low, high, np.searchsorted(texts, low, "right") - 1, mix(grams[places]), mix(rolling.of(low, high) ^ mix(shape + np.uint64(1)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    texts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[texts[0] : texts[-1]], texts - texts[0]


def once_a_text(text: np.ndarray, gram: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors in order: those that are the first of a text with their gram and surroundings, how often these occur in it, and which anchors are of several."""
    order = np.lexsort((np.arange(len(text)), around, gram, text))
    t, g, a = text[order], gram[order], around[order]
    begins = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (a[1:] != a[:-1])])) if len(order) else order
    times = np.diff(np.append(begins, len(order)))
    several = np.empty(len(order), bool)
    several[order] = np.repeat(times > 1, times)
    first = order[begins]
    back = np.argsort(first, kind="stable")
    return first[back], times[back], several


def anchors(documents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc_id, row, place, start, end, anchor, around, times, own of each text of ``length`` bytes or more; the last seven are arrays.

    Anchors with equal surroundings in one text, as in a run of one word, are given once, with ``times``; ``own`` are the surroundings of
    all of them, or of all but the first.
    """
    narrow = documents.filter(F.octet_length("text") >= length).select("doc_id", row_key().alias("row"), "text")
    names = ["doc_id", "row", "place", "start", "end", "anchor", "around", "times", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, texts = _bytes_of(b.column("text"))
            places, low, high, text, gram, around = anchors_of(data, texts, length)
            first, times, several = once_a_text(text, gram, around)
            if keep_first:
                several[first] = False
            a, z, t = low[several], high[several], text[several]
            begins = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] > z[:-1])])) if len(a) else np.empty(0, np.int64)
            ends = np.append(begins[1:], len(a)) - 1 if len(a) else begins
            of = t[begins]
            own = pa.StructArray.from_arrays([pa.array(a[begins] - texts[of]), pa.array(z[ends] - texts[of])], ["start", "end"])
            cuts = lambda x: pa.array(np.searchsorted(x, np.arange(len(texts))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts(text[first]), pa.array(x)) for x in (*((at - texts[text])[first] for at in (places, low, high)), gram.view(np.int64)[first], around.view(np.int64)[first], times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *lists, pa.ListArray.from_arrays(cuts(of), own)], names=names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, row binary, place array<long>, start array<long>, end array<long>, anchor array<long>, around array<long>, times array<long>, own array<struct<start: long, end: long>>")


def ranks_of_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank of the window of ``length`` bytes at each start among all of them, in order of their bytes; equal windows share one.

    Ranks of eight bytes are doubled: two ranks of a width side by side order twice that width, and at last two that overlap order ``length``.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    ranks = np.unique(np.ndarray((len(data) + length,), ">u8", padded, strides=(1,)).astype(np.uint64), return_inverse=True)[1]
    width = 8
    while width * 2 <= length:
        ranks = np.unique(ranks[:-width] * np.int64(len(padded)) + ranks[width:], return_inverse=True)[1]
        width *= 2
    return np.unique(ranks[starts] * np.int64(len(padded)) + ranks[starts + length - width], return_inverse=True)[1]


def other_factors(ranks: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal window lies at a smaller, and at a larger position. One position that is given several times is no other one.

    This is the array of longest previous factors where only lengths of a whole window count: within a run of equal windows in suffix
    order, ordered by position, the previous (and next) smaller position exists for all but the run's first.
    """
    order = np.lexsort((position, ranks))
    r, p = ranks[order], position[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(r))))
    earlier, later = np.empty(len(r), bool), np.empty(len(r), bool)
    earlier[order] = p > p[first][run]
    later[order] = p < p[np.append(first[1:], len(r)) - 1][run] if len(r) else False
    return earlier, later


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, by row and in order, as covered intervals: (row, start, end)."""
    new = (np.diff(row, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1 if len(start) else at
    return row[at], start[at], start[last] + length


def order_of(doc_id: Column) -> list[Column]:
    """Documents in order: those without doc_id last, then by a digest of doc_id and text."""
    return [doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.col("row")]


def repeated_spans(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(row, start, end): byte intervals covered by strings of ``length`` bytes that start elsewhere too, or earlier if ``keep_first``.

    ``row`` is the digest of doc_id and text. Intervals of a row may overlap. Strings are judged on the input; matches never cross
    documents and may overlap themselves. Null, empty and shorter texts have none. Of rows that are repeated whole each is
    a document of its own; to keep the first of them is to keep them all. An empty table gives no rows.
    """
    if length < 16:
        raise ValueError("repeated strings have 16 bytes at least")
    found = materialize(anchors(documents, length, keep_first), "anchors")
    own = materialize(found.select("row", F.explode("own").alias("x")).select("row", "x.start", "x.end"), "own")
    once = found.select("doc_id", "row", F.posexplode("anchor").alias("i", "anchor"), "place", "start", "end", "around", "times")
    each = once.select("anchor", F.get("around", "i").alias("around"), *order_of(F.col("doc_id")), *(F.get(c, "i").alias(c) for c in ("start", "end", "place", "times")))
    again = found.select(F.explode(F.arrays_zip("anchor", "around", "times")).alias("x")).groupBy("x.anchor").agg(F.sum("x.times").alias("n"), (F.min("x.around") == F.max("x.around")).alias("alike"))
    again = materialize(again.filter("n > 1").select("anchor", "alike"), "again")
    live = materialize(each.join(again, "anchor"), "live")  # read back, both sides of later joins are plain exchanges, and hot ones can be split
    discard(found, again)

    first = F.min(F.struct("last", "doc_id", "row", "start", "end", "place")).alias("first")
    distinct = materialize(live.groupBy("anchor", "around").agg(F.sum("times").alias("n"), first, F.first("alike").alias("alike")), "surroundings")
    several = distinct.filter("n > 1").select("anchor", "around", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start"))
    alike = live.select("anchor", "around", "row", "start", "end").join(several, ["anchor", "around"])
    if keep_first:
        alike = alike.filter((F.col("row") != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    whole = alike.select("row", "start", "end")

    buckets = distinct.filter("not alike")
    sizes = buckets.groupBy("anchor").agg(F.count("*").alias("size"))
    wanted = buckets.join(sizes, "anchor").select("anchor", (F.col("size") > BUCKET).alias("hot"), "first.row", "first.place", "first.start", "first.end")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "hot", "place", "start", "end")).alias("wanted"))  # no more than a text has anchors
    texts = documents.select("doc_id", row_key().alias("row"), "text").join(materialize(wanted, "wanted").hint("shuffle_hash"), "row").dropDuplicates(["row"])
    cut = materialize(surroundings(texts, length), "windows")
    sorted_ = cut.filter(~F.col("hot")).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _sort_buckets(b, length, keep_first), "row binary, start long, end long")

    parts = cut.filter("hot").select("last", "doc_id", "row", F.explode("pieces").alias("x")).select("last", "doc_id", "row", "x.*")
    at = F.struct("last", "doc_id", "row", "start")
    cores = parts.groupBy("core").agg(F.count("*").alias("n"), (F.min("full") != F.max("full")).alias("differ"))
    shared = materialize(parts.join(materialize(cores.filter("n > 1").select("core", "differ"), "cores"), "core"), "pieces")
    equal = materialize(shared.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(at).alias("low")), "equal")
    found = shared.drop("windows").join(equal.filter("n > 1").select("core", "full", "low"), ["core", "full"])
    if keep_first:
        found = found.filter(at != F.col("low"))
    pieces = found.select("row", "start", "end")

    firsts = shared.filter("differ").join(equal.select("core", "full", "low"), ["core", "full"]).filter(at == F.col("low"))
    dealt = firsts.select("last", "doc_id", "row", F.posexplode("windows").alias("i", "window"), "start").withColumn("start", F.col("start") + F.col("i"))
    dealt = materialize(dealt.drop("i"), "dealt")
    judged = dealt.groupBy("window").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low != high")
    hot = dealt.join(materialize(judged, "judged"), "window")
    if keep_first:
        hot = hot.filter(at != F.col("low"))
    hot = hot.select("row", "start", (F.col("start") + length).alias("end"))
    return own.union(whole).union(sorted_).union(pieces).union(hot)


_CUT = "anchor long, hot boolean, last boolean, doc_id {}, row binary, start long, bytes binary, pieces array<struct<core: binary, full: binary, start: long, end: long, windows: array<binary>>>"
_PIECES = pa.list_(pa.struct([("core", pa.binary()), ("full", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("windows", pa.list_(pa.binary()))]))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pieces_of(data: bytes, place: int, start: int, end: int, length: int) -> Iterator[dict]:
    """The windows of ``data[start:end]`` in pieces by their distance to ``place``, so that equal windows of one gram lie in like pieces.

    ``core`` tells the bytes that all windows of such a piece have, whether or not they are all here; ``full`` those of the windows that are.
    """
    step = math.isqrt(length - length // 2 + 1)
    last = end - length  # the last window's start
    for k in range((place - last) // step, (place - start) // step + 1):
        a, b = max(place - k * step - step + 1, start), min(place - k * step, last)
        core = data[place - k * step : place - k * step - step + 1 + length]
        yield {"core": _digest(b"%d:" % k + core), "full": _digest(data[a : b + length]), "start": a, "end": b + length, "windows": [_digest(data[s : s + length]) for s in range(a, b + 1)]}


def surroundings(texts: DataFrame, length: int) -> DataFrame:
    """The wanted anchors' surroundings: the bytes of those in small buckets, digests of the windows of the others, in pieces."""
    kind = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "hot", "last", "row", "start", "bytes", "pieces"]
        for b in slices(batches, "text"):
            rows, of = [], []
            for i, (row, text, wanted) in enumerate(zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True)):
                data = text.encode()
                for w in wanted:
                    start, end = w["start"], w["end"]
                    of.append(i)
                    if w["hot"]:
                        rows.append((w["anchor"], True, row, start, None, list(pieces_of(data, w["place"], start, end, length))))
                    else:
                        rows.append((w["anchor"], False, row, start, data[start:end], None))
            for i in range(0, len(rows), 4096):
                doc_id = b.column("doc_id").take(pa.array(of[i : i + 4096], pa.int64()))
                a, h, r, s, x, w = zip(*rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h), doc_id.is_null(), doc_id, pa.array(r, pa.binary()), pa.array(s, pa.int64()), pa.array(x, pa.binary()), pa.array(w, _PIECES)], names=[*names[:3], "doc_id", *names[3:]])

    return texts.mapInArrow(run, _CUT.format(kind.simpleString()))


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Covered intervals of surroundings that come bucket by bucket; whole buckets of about SORT_BYTES are sorted at once."""

    def covered(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        pieces = table.column("bytes").to_pylist()
        size = np.array(list(map(len, pieces)))
        begin = np.concatenate([[0], np.cumsum(size)])
        place = np.array(table.column("start").to_pylist(), np.int64)
        keys = list(zip(table.column("last").to_pylist(), table.column("doc_id").to_pylist(), table.column("row").to_pylist(), strict=True))
        number = {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: (k[0], 0 if k[0] else k[1], k[2])))}
        document = np.array([number[k] for k in keys], np.int64)
        n = np.maximum(size - length + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        ranks = ranks_of_windows(np.frombuffer(b"".join(pieces), np.uint8), begin[owner] + within, length)
        start = place[owner] + within
        position = document[owner] << np.int64(40) | start
        earlier, later = other_factors(ranks, position)
        chosen = np.unique(position[earlier if keep_first else earlier | later])
        row, a, b = _runs(chosen >> 40, chosen & np.int64((1 << 40) - 1), length)
        names = [k[2] for k in number]
        return pa.RecordBatch.from_pydict({"row": pa.array([names[i] for i in row], pa.binary()), "start": pa.array(a, pa.int64()), "end": pa.array(b, pa.int64())})

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        # up to the last bucket of the batch, all buckets are whole
        new = np.flatnonzero(np.diff(np.array(b.column("anchor"))))
        starts = int(new[-1]) + 1 if len(new) else 0
        if starts or (held and held[-1].column("anchor")[-1] != b.column("anchor")[0]):
            held.append(b.slice(0, starts))
            size += held[-1].nbytes
            if size >= SORT_BYTES:
                yield covered(pa.Table.from_batches(held))
                held, size = [], 0
        held.append(b.slice(starts))
    if held:
        yield covered(pa.Table.from_batches(held))


def _judged(documents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The columns of ``documents`` under numbers, with ``__spans``, the covered intervals in order."""
    spans = repeated_spans(documents, length, keep_first).groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    return documents.withColumn("__row", row_key()).join(materialize(spans, "spans").hint("shuffle_hash"), "__row", "left")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Intervals in order as maximal ones; those that touch are one."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def substring_report(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row, bytes that repeat being removed; see repeated_spans.

    Null texts count as empty. Texts below ``length`` bytes lose nothing, repeated rows and copies lose the same, very long texts count whole. Columns
    other than doc_id and text play no part; an empty table gives no rows.
    """
    rows = _judged(documents.select("doc_id", "text"), length, keep_first).select("doc_id", "text", "__spans")
    kind = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            spans = [merged(s) for s in b.column("__spans").to_pylist()]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                       pa.array([hashlib.sha256(_rest(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()), pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], span)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=kind.names)

    return rows.mapInArrow(run, kind)


def without_repeats(documents: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """The rows with their columns, later copies of repeated strings cut out of the texts, and the first kept, or all cut.

    Where a cut would split a character, the whole character goes. Null texts stay null; a text may become empty. Other columns stay as they are.
    """
    names = {c: f"__c{i}" for i, c in enumerate(documents.columns)}
    judged = _judged(documents, length, keep_first).select(*(F.col(c).alias(n) for c, n in names.items()), "__spans")
    text = names["text"]
    kept = T.StructType([f for f in judged.schema if f.name != "__spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            cleaned = [None if t is None else _rest(t.encode(), merged(s)).decode(errors="ignore") for t, s in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cleaned, pa.string()) if n == text else b.column(n) for n in kept.names], names=kept.names)

    return judged.mapInArrow(run, kept).select(*(F.col(n).alias(c) for c, n in names.items()))
