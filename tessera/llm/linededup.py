"""Line deduplication with a log-template tree.

A line's way through the tree of fixed depth is its number of tokens and its leading tokens; tokens with a digit are
variable fields from the start. Each line goes to the leaf of its own leading tokens and to those in which one of these is a
wildcard. What follows in a leaf is compared token by token, in lines of many tokens by up to eight segments. A leaf holds any
number of templates: each choice of segments that leaves two thirds of the tokens constant names one, and lines that agree
in the segments kept are its instances. Leaves, and segments of a leaf, with too few lines for any template drop out first.

A template recurs if its lines stand in enough different hosts, not merely in copies of one document. Hosts are compared
by sketches: in each of BINS bins the least hash of a run of three tokens, with the line that it stands in. Outside the lines
that two hosts share, both must have something of their own, and that must not be alike (as it is in edited copies);
so hosts of a long licence differ by their one own line, and copies, excerpts and near copies count once. Besides
lines, passages count: the shortest runs of lines from each line onwards, and up to each line, that have PASSAGE_TOKENS tokens.
Two hosts, neither a near copy of the other, make a passage recur. What recurs is dropped from every host.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import slices
from tessera.llm.words import Tokens, mix
from tessera.runtime import materialize

#: Leading tokens that name a leaf, after the number of tokens.
DEPTH = 3
SEGMENTS = 8
#: A token counts once for so many bytes, so that lines of unspaced scripts have a size; and the size from which lines can recur.
TOKEN_BYTES, LEAST_SIZE = 16, 3
#: Hosts from which a line recurs, by its size: short lines recur by chance.
LEAST_CONTEXTS = ((30, 4), (8, 5), (LEAST_SIZE, 6))
#: A template with variable fields: least tokens, times as many hosts, and segments that may vary at most.
GENERAL_TOKENS, GENERAL_FACTOR, MOST_VARIABLE = 4, 2, 3
#: By number of segments and of those that vary, the choices of segments that a template keeps, as bits.
KEPT = {(k, b): [sum(1 << i for i in x) for x in combinations(range(k), k - b)] for k in range(1, SEGMENTS + 1) for b in range(min(k, MOST_VARIABLE) + 1)}

#: Parts over which the lines of a leaf are dealt; no more than the least lines of a leaf that goes on.
LEAF_PARTS = 8
#: Tokens of a passage, which recurs from two hosts on.
PASSAGE_TOKENS = 50
#: Bins of a document's sketch; and the different hosts that are told apart of each line, as many as any rule asks for.
BINS, MOST_HOSTS = 64, 12
#: Lines, and sketches of their second and further hosts, that a worker holds before it hands them on.
_HELD_KEYS, _HELD_SKETCHES = 20_000, 30_000

#: Stands for a token with a digit.
_FIELD = np.uint64(0x3C2A3E3C2A3E3C2A)
_NEXT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_STEP, _LENGTH = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_LAST = np.uint64(np.iinfo(np.uint64).max)
_ROWS = pa.schema([("line", pa.int64()), ("n_tokens", pa.int32()), ("size", pa.int32()), ("leads", pa.list_(pa.int32())), ("segments", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("sketch", pa.binary()), ("lines", pa.int64())])


class Lines(NamedTuple):
    """Lines that hold a token: whose they are, which line of the text, their tokens' hashes and sums over these by place; and the number of texts."""

    owner: np.ndarray
    number: np.ndarray
    n_tokens: np.ndarray
    start: np.ndarray
    sums: np.ndarray
    words: np.ndarray
    size: np.ndarray
    n_texts: int

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash of the tokens between two places of all tokens."""
        return mix(self.sums[end] - self.sums[begin])

    def hashes(self) -> np.ndarray:
        return mix(self.part(self.start, self.start + self.n_tokens) ^ (self.n_tokens.astype(np.uint64) * _LENGTH))


def lines_of(texts: pa.Array) -> Lines:
    """All lines of all texts at once; tokens with a digit are variable fields and all alike."""
    tokens = Tokens.of(texts)
    words = tokens.hashes()
    field = np.zeros(len(words), bool)
    field[np.searchsorted(tokens.start, np.flatnonzero((tokens.data >= 48) & (tokens.data <= 57)), "right") - 1] = True
    words[field] = _FIELD
    feeds = np.flatnonzero(tokens.data == 10)
    row = np.searchsorted(feeds, tokens.start)
    first = np.ones(len(words), bool)
    first[1:] = (row[1:] != row[:-1]) | (tokens.owner[1:] != tokens.owner[:-1])
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(words)))
    owner = tokens.owner[start]
    power = np.cumprod(np.full(int(n.max(initial=0)) + 1, _STEP, np.uint64))
    place = np.arange(len(words)) - np.repeat(start, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[place], dtype=np.uint64)])
    heavy = np.concatenate([[0], np.cumsum(np.where(field, 1, np.maximum(tokens.length // TOKEN_BYTES, 1)))])
    return Lines(owner, row[start] - np.searchsorted(feeds, tokens.texts[owner]), n, start, sums, words, heavy[start + n] - heavy[start], len(texts))


def sketches(lines: Lines, hashes: np.ndarray) -> np.ndarray:
    """[texts, BINS]: in each bin the least hash of three tokens in a line (high half) with its line's hash (low half); all ones where there is none."""
    of = np.repeat(np.arange(len(hashes)), lines.n_tokens)
    runs = lines.words.copy()
    for k, factor in enumerate(_NEXT, 1):
        runs[:-k] += np.where(of[k:] == of[:-k], lines.words[k:] * factor, np.uint64(0))
    runs = mix(runs)
    out = np.full(lines.n_texts * BINS, _LAST)
    at = lines.owner[of] * BINS + (runs & np.uint64(BINS - 1)).astype(np.int64)
    np.minimum.at(out, at, (runs >> np.uint64(32) << np.uint64(32)) | (hashes >> np.uint64(32))[of])
    return out.reshape(-1, BINS)


def describe(texts: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
    """The owner, and line, n_tokens, size, leads, segments of every distinct line of LEAST_SIZE or more; its places among the lines of
    that size; and, in a text's first row, its sketch and a hash of the set of all of its lines."""
    lines = lines_of(texts)
    hashes = lines.hashes()
    order = np.lexsort((hashes, lines.owner))
    owner, line = lines.owner[order], hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    everything, order, owner, line = order, order[first], owner[first], line[first]
    sets = np.zeros(len(texts), np.uint64)
    np.bitwise_xor.at(sets, owner, mix(line))
    eligible = lines.size >= LEAST_SIZE
    place = np.cumsum(eligible) - 1
    sketch, held = sketches(lines, hashes), everything[eligible[everything]]
    kept = eligible[order]
    times = np.diff(np.append(np.flatnonzero(first), len(first)))[kept]
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32()), pa.array(place[held], pa.int32()))
    n, start, size = lines.n_tokens[order][kept], lines.start[order][kept], lines.size[order][kept]
    general = n >= GENERAL_TOKENS

    def hashed(counts: np.ndarray, values) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(counts)])
        j, which = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts), np.repeat(np.arange(len(n)), counts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((values(j, which) >> np.uint64(33)).astype(np.int32), pa.int32()))

    leads = hashed(np.where(general, DEPTH, 0), lambda j, which: lines.words[start[which] + j])
    more = n - DEPTH
    k = np.where(general, np.minimum(SEGMENTS, more), 0)
    at = lambda j, which: start[which] + DEPTH + more[which] * j // k[which]
    segments = hashed(k, lambda j, which: lines.part(at(j, which), at(j + 1, which)))
    owner = owner[kept]
    lead = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    shown = pa.array([sketch[i].tobytes() if x else None for i, x in zip(owner.tolist(), lead.tolist(), strict=True)], pa.binary())
    columns = [line[kept].view(np.int64), n.astype(np.int32), size.astype(np.int32), leads, segments, places, shown, pa.array(sets[owner].view(np.int64), mask=~lead)]
    return owner, pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_ROWS)


def line_rows(documents: DataFrame) -> DataFrame:
    """copy (a hash of the text) and what ``describe`` tells of each of its lines; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            owner, rows = describe(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("copy").take(pa.array(owner)), *rows.columns], names=["copy", *_ROWS.names])

    narrow = documents.select(F.xxhash64("text").alias("copy"), "text")
    return narrow.mapInArrow(run, "copy long, line long, n_tokens int, size int, leads array<int>, segments array<int>, places array<int>, sketch binary, lines long")


def needed_contexts(size: Column) -> Column:
    out = None
    for least, contexts in LEAST_CONTEXTS:
        out = F.when(size >= least, contexts) if out is None else out.when(size >= least, contexts)
    return out


def passages(places: list[int], lines: list[int], sizes: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Hash and lines of the shortest runs of PASSAGE_TOKENS tokens, from each line onwards and up to each line; ``places`` ascend, and a run has no gap."""
    found: set[tuple[int, int]] = set()
    begin = 0
    for end in range(1, len(places) + 1):
        if end < len(places) and places[end] == places[end - 1] + 1:
            continue
        total = np.concatenate([[0], np.cumsum(sizes[begin:end])])
        size = end - begin
        to = np.searchsorted(total, total[:-1] + PASSAGE_TOKENS)
        back = np.searchsorted(total, total[1:] - PASSAGE_TOKENS, "right") - 1
        found.update((begin + i, begin + j) for i, j in enumerate(to.tolist()) if j <= size)
        found.update((begin + i, begin + j) for j, i in enumerate(back.tolist(), 1) if i >= 0)
        begin = end
    for i, j in found:
        yield xxhash.xxh3_64_intdigest(np.array(lines[i:j], np.int64).tobytes(), 1) - (1 << 63), lines[i:j]


def passage_rows(held: DataFrame) -> DataFrame:
    """copy, key and lines of each passage of the lines that more than one text has."""
    texts = held.groupBy("copy").agg(F.array_sort(F.collect_set(F.struct("place", "line", "size"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies, keys, members = [], [], []
            for copy, x in zip(b.column("copy").to_pylist(), b.column("x").to_pylist(), strict=True):
                for key, lines in passages([r["place"] for r in x], [r["line"] for r in x], [r["size"] for r in x]):
                    copies.append(copy), keys.append(key), members.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(keys, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["copy", "key", "lines"])

    return texts.mapInArrow(run, "copy long, key long, lines array<long>")


def differing(sketch: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each other sketch whether its text is another host, whether it is no near copy either, and whether it has nothing of its own."""
    mine, theirs, last = sketch >> np.uint64(32), others >> np.uint64(32), _LAST >> np.uint64(32)
    either, equal = ((mine != last) | (theirs != last)).sum(1), ((mine == theirs) & (mine != last)).sum(1)
    shared = ((sketch == others) & (mine != last)).sum(1)
    own, their_own = (mine < theirs).sum(1), (theirs < mine).sum(1)
    other = equal - shared < np.minimum(own, their_own)  # of what either has outside shared lines, less than half is in the other's, as fields of a template leave
    return other, other & (4 * equal < 3 * either), their_own == 0


class Hosts:
    """Sketches of texts of which no two are copies, MOST_HOSTS at most; sets of hosts merge by adding one's sketches to the other's."""

    def __init__(self) -> None:
        self.raw: list[bytes] = []
        self.copies: list[int] = []  # the text of each
        self.kept: np.ndarray | None = None  # made when a second sketch comes

    def add(self, raw: bytes, copy: int) -> None:
        if not self.raw:
            self.raw.append(raw)
            self.copies.append(copy)
            return
        if len(self.raw) == MOST_HOSTS or raw in self.raw:
            return
        sketch, n = np.frombuffer(raw, np.uint64), len(self.raw)
        if self.kept is None:
            self.kept = np.empty((2, BINS), np.uint64)
            self.kept[0] = np.frombuffer(self.raw[0], np.uint64)
        other, _, within = differing(sketch, self.kept[:n])
        if not other.all():
            if len(of := np.flatnonzero(~other & within)):  # the text has all of an excerpt, which told nothing apart
                self.kept[of[0]], self.raw[of[0]], self.copies[of[0]] = sketch, raw, copy
            return
        if n == len(self.kept):
            self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
        self.kept[n] = sketch
        self.raw.append(raw)
        self.copies.append(copy)

    def apart(self) -> bool:
        """Whether two of them are not even near copies."""
        return any(differing(self.kept[i], self.kept[:i])[1].any() for i in range(1, len(self.raw)))


def _partial_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, copy and sketch of a task's own hosts, from copy, keys and sketch of texts."""
    hosts: dict[int, Hosts] = {}

    more = 0

    def found() -> pa.RecordBatch:
        held = list(hosts.values())
        keys = np.repeat(np.fromiter(hosts, np.int64, len(hosts)), [len(h.raw) for h in held])
        copies = pa.array([x for h in held for x in h.copies], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys), copies, pa.array([x for h in held for x in h.raw], pa.binary())], names=["key", "copy", "sketch"])

    for b in batches:
        for copy, keys, raw in zip(b.column("copy").to_pylist(), b.column("keys").to_pylist(), b.column("sketch").to_pylist(), strict=True):
            for k in keys:
                if k not in hosts:
                    hosts[k] = Hosts()
                    more -= 1
                before = len(hosts[k].raw)
                hosts[k].add(raw, copy)
                more += len(hosts[k].raw) - before
            if len(hosts) >= _HELD_KEYS or more >= _HELD_SKETCHES:
                yield found()
                hosts.clear()
                more = 0
    yield found()


def _all_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, its number of hosts (MOST_HOSTS stands for more), whether two are apart, and a text of each; rows are in order of keys."""
    key, hosts = None, Hosts()
    row = lambda: (key, len(hosts.raw), hosts.apart(), hosts.copies)
    for b in batches:
        out = []
        for k, copy, raw in zip(b.column("key").to_pylist(), b.column("copy").to_pylist(), b.column("sketch").to_pylist(), strict=True):
            if k != key:
                if hosts.raw:
                    out.append(row())
                key, hosts = k, Hosts()
            hosts.add(raw, copy)
        yield _host_rows(out)
    yield _host_rows([row()] if hosts.raw else [])


def _host_rows(rows: list[tuple[int, int, bool, list[int]]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "hosts", "apart", "copies"])


def hosts_of(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """key, hosts, apart, copies (a text of each host) from rows of key, copy, least (texts that it takes at least); ``texts`` has the sketch of each copy."""
    own = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("least").alias("least"), F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("texts"))
    counts = materialize(own.filter(F.col("n") >= F.col("least")).select("key", "n", "texts"), "counts")
    shown = materialize(counts.groupBy("n", "texts").agg(F.min("key").alias("key")), "shown")  # keys of the same texts have the same hosts
    often = keyed.join(shown.select("key").hint("shuffle_hash"), "key").groupBy("copy").agg(F.collect_list("key").alias("keys"))  # at most the keys of the text's own lines
    part = often.join(texts, "copy").select("copy", "keys", "sketch").mapInArrow(_partial_hosts, "key long, copy long, sketch binary")
    found = materialize(part.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(_all_hosts, "key long, hosts int, apart boolean, copies array<long>"), "hosts")
    return materialize(found.join(shown, "key").drop("key").join(counts, ["n", "texts"]).select("key", "hosts", "apart", "copies"), "counted")


def recurring_lines(rows: DataFrame) -> DataFrame:
    """copy, line (hash) of every line to be dropped, from the rows of ``line_rows``."""
    texts = rows.filter(F.col("sketch").isNotNull()).select("copy", "sketch").dropDuplicates(["copy"])
    again = materialize(rows.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= 2).select("line"), "again")
    routed = materialize(common_leaves(rows), "routed")
    needed = again.withColumn("again", F.lit(True)).unionByName(routed.select("line").distinct(), allowMissingColumns=True)
    needed = materialize(needed.groupBy("line").agg(F.max("again").alias("again")), "needed")
    # read back, both sides of the join are plain exchanges, and a hot line's can be split; of all lines only these go on. The smaller
    # side, whose lines are distinct, is hashed, so that the larger one need not be sorted; neither is broadcast, as both grow
    held = materialize(rows.drop("sketch", "lines").join(needed.hint("shuffle_hash"), "line"), "held")
    several = materialize(held.filter("again").select("copy", F.explode("places").alias("place"), "line", "size").distinct(), "several")
    runs = materialize(passage_rows(several), "passages")
    single = held.filter("again").select(F.col("line").alias("key"), "copy", needed_contexts(F.col("size")).alias("least")).distinct()
    instances = template_lines(held, routed)
    # lines that stand in the same templates have their hosts counted once, together; a template's hosts are merged from one text of each
    # of these, MOST_HOSTS at most for each such class, so its rows grow neither with the texts of a frequent line nor with a line's variants
    alike = F.xxhash64(F.bit_xor(F.xxhash64("key")), F.count("*"))
    classes = materialize(instances.groupBy("line").agg(alike.alias("class")), "classes")
    of_classes = held.select("line", "copy").join(classes, "line").select("class", "copy", F.lit(1)).distinct()
    keyed = materialize(single.union(runs.select("key", "copy", F.lit(2))).union(of_classes), "keyed")
    counted = hosts_of(keyed, texts)
    parts = instances.join(classes, "line").groupBy("key", "class").agg(F.max("least").alias("least"))
    parts = materialize(parts.join(counted.select(F.col("key").alias("class"), "hosts", "copies"), "class"), "parts")
    merged = hosts_of(materialize(parts.select("key", F.explode("copies").alias("copy"), "least").distinct(), "merged"), texts)
    hosts = parts.select("key", "hosts").union(merged.select("key", "hosts")).groupBy("key").agg(F.max("hosts").alias("hosts"))
    alone = single.select("key", "least").distinct().join(counted, "key").filter(F.col("hosts") >= F.col("least")).select(F.col("key").alias("line"))
    general = instances.join(hosts, "key").filter(F.col("hosts") >= F.col("least")).select("line")
    dropped = held.select("copy", "line").join(materialize(alone.union(general).distinct(), "dropped"), "line", "left_semi")
    return dropped.unionByName(_lines_of_passages(runs, counted)).distinct()


def _leaf(wild: int) -> Column:
    """The leaf of a line's leading tokens, of which number ``wild`` is a wildcard; -1: none is."""
    lead = lambda i: F.lit(None).cast("int") if i == wild else F.get("leads", F.lit(i))
    return F.xxhash64("n_tokens", F.lit(wild), *map(lead, range(DEPTH)))


def common_leaves(rows: DataFrame) -> DataFrame:
    """(leaf, line) of the leaves with a wildcard that have lines enough for a template; a leaf without one lies within three of them."""
    least = (GENERAL_FACTOR * needed_contexts(F.col("size"))).alias("least")
    wide = rows.filter(F.col("n_tokens") >= GENERAL_TOKENS).select("line", least, F.explode(F.array(*map(_leaf, range(DEPTH)))).alias("leaf"))
    leaves = wide.groupBy("leaf").agg(F.count("*").alias("n"), F.min("least").alias("least")).filter(F.col("n") >= F.col("least")).select("leaf")
    # a leaf's lines are dealt over parts, to each of which the leaf goes; it has more lines than there are parts
    each = materialize(leaves, "leaves").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LEAF_PARTS - 1))))
    dealt = wide.select("leaf", "line", F.pmod(F.col("line"), F.lit(LEAF_PARTS)).cast("int").alias("part"))
    return dealt.join(each.hint("shuffle_hash"), ["leaf", "part"]).dropDuplicates(["leaf", "part", "line"]).drop("part")


def template_lines(held: DataFrame, routed: DataFrame) -> DataFrame:
    """key, line, least of the templates with variable fields that have enough lines to recur, whatever their hosts.

    Of templates that have the same lines one is kept.
    """
    lines = held.filter(F.col("n_tokens") >= GENERAL_TOKENS).groupBy("line").agg(
        F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("n_tokens", "leads", "segments")), F.min(GENERAL_FACTOR * needed_contexts(F.col("size"))).alias("least"))
    lines = materialize(lines.join(routed.select("line").distinct(), "line", "left_semi"), "lines")
    own = lines.select(_leaf(-1).alias("leaf"), F.lit(0).alias("wild"), "line")
    to = routed.select("leaf", F.lit(1).alias("wild"), "line").unionByName(own)
    size = F.size("segments")
    room = F.expr(f"size(segments) * (n_tokens - 3 * wild) div (3 * (n_tokens - {DEPTH}))")
    varying = F.least(F.greatest(room, F.lit(0)), F.lit(MOST_VARIABLE), size).cast("int")
    spread = materialize(to.join(lines, "line").select("leaf", "line", "segments", "n", "least", varying.alias("varying")), "spread")
    parts = spread.select("leaf", "line", "least", "n", F.posexplode("segments").alias("at", "segment"))
    common = parts.groupBy("leaf", "at", "segment").agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter(F.col("n") >= F.col("least")).select("leaf", "at", "segment")
    fixed = parts.select("leaf", "line", "at", "segment").join(materialize(common, "common"), ["leaf", "at", "segment"]).groupBy("leaf", "line").agg(F.count("*").alias("fixed"))
    near = spread.join(fixed, ["leaf", "line"], "left").filter(F.coalesce("fixed", F.lit(0)) >= size - F.col("varying"))
    kept = None
    for (k, b), choices in KEPT.items():
        here = (size == k) & (F.col("varying") == b)
        kept = F.when(here, F.lit(choices)) if kept is None else kept.when(here, F.lit(choices))
    each = near.select("leaf", "line", "segments", "n", "least", F.explode(kept).alias("kept"))
    values = F.transform("segments", lambda x, i: F.when(F.get(F.lit([1 << j for j in range(SEGMENTS)]), i).bitwiseAND(F.col("kept")) > 0, x))
    each = materialize(each.select(F.xxhash64("leaf", "kept", values).alias("key"), "line", "n", "least"), "choices")
    found = each.groupBy("key").agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.max("least").alias("least"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("set"))
    found = found.filter((F.col("lines") > 1) & (F.col("n") >= F.col("least"))).groupBy("set", "lines").agg(F.min("key").alias("key"))
    return materialize(each.select("key", "line", "least").join(materialize(found.select("key"), "found"), "key"), "templates")


def _lines_of_passages(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """copy, line of the passages that recur."""
    recurring = counted.filter(F.col("apart") | (F.col("hosts") >= LEAST_CONTEXTS[0][1])).select("key")
    return runs.join(recurring, "key").select("copy", F.explode("lines").alias("line")).distinct()


def without_recurring(documents: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All documents with their columns; ``text`` has lost the lines of recurring templates; ``counts`` names two added columns,
    the text's lines and those dropped.

    Kept lines stay byte for byte, in order. Null texts stay null and empty ones empty. Lines of a size below LEAST_SIZE stay.
    A document of which no word would remain stays whole if its lines are just those of another row, for near-duplicate
    detection to judge; else only its blank lines and those below LEAST_SIZE are left. What goes follows from a row's text alone, so repeated rows are
    treated alike, and so are rows without doc_id. An empty table gives no rows. Input columns of the added names are replaced.
    """
    rows = materialize(line_rows(documents), "rows")
    drops = recurring_lines(rows).groupBy("copy").agg(F.collect_list("line").alias("__drop"))  # at most the text's own lines
    heads = rows.filter(F.col("lines").isNotNull()).select("copy", "lines")
    twice = heads.groupBy("lines").agg(F.count("*").alias("n")).filter("n > 1").select("lines")
    whole = heads.join(twice, "lines", "left_semi").select("copy", F.lit(True).alias("__whole")).distinct()
    drops = materialize(drops.join(whole, "copy", "left").withColumnRenamed("copy", "__copy"), "drops")  # so that a hot copy can be split
    columns = [c for c in documents.columns if c not in counts]
    joined = documents.select(*columns).withColumn("__copy", F.xxhash64("text")).join(drops.hint("shuffle_hash"), "__copy", "left")  # the list grows with the data
    names = [*columns, *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            column = b.column("text")
            hosts = pc.indices_nonzero(b.column("__drop").is_valid()).cast(pa.int64())  # only these texts are taken apart
            texts, wholes = column.take(hosts), b.column("__whole").take(hosts).to_pylist()
            drops = [set(d) for d in b.column("__drop").take(hosts).to_pylist()]
            found = lines_of(texts)
            lost: list[set[int]] = [set() for _ in drops]
            for k, number, h in zip(found.owner.tolist(), found.number.tolist(), found.hashes().view(np.int64).tolist(), strict=True):
                if h in drops[k]:
                    lost[k].add(number)
            made, gone = texts.to_pylist(), np.zeros(b.num_rows, np.int64)
            for k, (i, out) in enumerate(zip(hosts.to_pylist(), lost, strict=True)):
                kept = [p for number, p in enumerate(made[k].split("\n")) if number not in out]
                if out and (not wholes[k] or any(p.encode("utf-8", "surrogatepass").split() for p in kept)):
                    made[k], gone[i] = "\n".join(kept), len(out)
            total = pc.if_else(pc.equal(pc.fill_null(pc.binary_length(column), 0), 0), 0, pc.add(pc.fill_null(pc.count_substring(column, "\n"), 0), 1))
            text = pc.replace_with_mask(column, b.column("__drop").is_valid(), pa.array(made, column.type))
            new = {"text": text, counts[0]: total.cast(pa.int64()), counts[1]: pa.array(gone)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns] + [f"{c} long" for c in counts])
    return joined.mapInArrow(run, schema)


def cleaned(documents: DataFrame) -> DataFrame:
    """The documents with their columns, without recurring lines; n_chars, where there is one, follows the text."""
    out = without_recurring(documents, ("__n_lines", "__n_dropped"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
