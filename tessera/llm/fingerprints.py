"""Document fingerprints that keep edit distance: a randomised edit embedding.

Shared random walks read a text from its first character on: at every step a hash of (step, character) decides whether
to advance, and the embedded string holds the character under the walk. Texts that differ by an edit fall
out of step and, as the walks are shared, into step again after a few characters, so their embeddings differ in a
number of places bounded by the edit distance. A walk that waits at a character leaves it at the first later
step that lets it go; that step is looked up at once, so a walk costs one lookup a character.

The fingerprint samples the embedding at fixed steps: in every octave of steps [2^k, 2^(k+1)) the same number,
so that short and long texts alike have samples over their whole length. Bands of sampled places make candidates
of texts that agree in a whole band; comparing full fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import batch_of, slices
from tessera.runtime import discard, materialize, shuffle_partitions

WALKS = 2
#: Steps after which the shared randomness repeats; a power of two.
PERIOD = 1 << 12
#: Characters are told apart by a class; the walk's table has a row for each.
CLASSES = 256
#: Samples of each walk in every octave of steps.
SAMPLES = 24
OCTAVES = 40
#: The digits of a sample, and the one that stands for the end of the text.
DIGITS = "0123456789abcdef"
END = "-"
#: Candidates agree in all BAND_WIDTH samples of one of the bands of an octave.
BAND_WIDTH = 8
#: Classes of a band with which all others of it are compared in a round.
HEADS = 64
#: Share of the embedding in which two unlike texts of one language agree by chance; likeness counts from there.
CHANCE = 0.13

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leave[walk, class, step]: steps until the walk has left a character; digit of a class; sampled steps[octave]."""
    rng = np.random.default_rng(2)
    go = rng.integers(0, 2, (WALKS, CLASSES, PERIOD), dtype=np.int8).astype(bool)
    go[:, :, -1] = True  # no class waits for ever
    leave = np.empty((WALKS, CLASSES, PERIOD), np.int64)
    wait = np.zeros((WALKS, CLASSES), np.int64)
    for step in [*range(PERIOD - 1, -1, -1)] * 2:
        wait = np.where(go[:, :, step], 1, wait + 1)
        leave[:, :, step] = wait
    digits = rng.permutation(np.arange(CLASSES) % len(DIGITS)).astype(np.uint8)
    return leave, digits, rng


LEAVE, DIGIT_OF, _RNG = _tables()
#: Sampled steps of each octave as shares of its width, in order.
SHARES = np.sort(_RNG.random((OCTAVES, SAMPLES)), axis=1)


def sample_steps(octave: int) -> np.ndarray:
    """Distinct places need no distinct steps: small octaves repeat theirs."""
    return (1 << octave) + (SHARES[octave] * (1 << octave)).astype(np.int64)


def classes_of(text: str) -> np.ndarray:
    """The class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return ((points * _MIX) >> np.uint64(56)).astype(np.int64)


class Walker:
    """Walks many texts side by side, one lookup a character and walk; the few longest go on one by one."""

    #: Texts from which walking side by side is quicker.
    SIDE_BY_SIDE = 48

    def __init__(self) -> None:
        self.table = LEAVE.reshape(WALKS, -1)
        self.lists: list[list[int]] | None = None

    def _alone(self, walk: int, codes: np.ndarray, now: int) -> tuple[list[int], int]:
        if self.lists is None:
            self.lists = [t.tolist() for t in self.table]
        table, mask, steps = self.lists[walk], PERIOD - 1, []
        for c in (codes * PERIOD).tolist():
            steps.append(now)
            now += table[c + (now & mask)]
        return steps, now

    def arrivals(self, codes: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text, steps[walk, i]: when the walk reaches character i; the last column is when it has left the text.

        ``starts[j]`` are the steps at which the walks of text j begin.
        """
        if not codes:
            return []
        order = sorted(range(len(codes)), key=lambda j: -len(codes[j]))
        lengths = np.array([len(codes[j]) for j in order])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        flat = np.concatenate([codes[j] for j in order])
        found = np.empty((WALKS, len(flat)), np.int64)
        at = np.stack([starts[j] for j in order], axis=1)
        walk, i = np.arange(WALKS)[:, None], 0
        while (active := int(np.searchsorted(-lengths, -i, "left"))) > self.SIDE_BY_SIDE:
            here, now = begins[:active] + i, at[:, :active]
            found[:, here] = now
            now += self.table[walk, flat[here] * PERIOD + (now & (PERIOD - 1))]
            i += 1
        for k in range(active):
            for w in range(WALKS):
                found[w, begins[k] + i : ends[k]], at[w, k] = self._alone(w, flat[begins[k] + i : ends[k]], int(at[w, k]))
        out: list[np.ndarray] = [found[:, :0]] * len(codes)
        for k, j in enumerate(order):
            out[j] = np.concatenate([found[:, begins[k] : ends[k]], at[:, k : k + 1]], axis=1)
        return out


def render(steps: np.ndarray, codes: np.ndarray) -> str:
    """The fingerprint from a text's arrival steps: walks in turn, octaves up to the one in which the walk ends, parted by dots."""
    parts = []
    for w in range(WALKS):
        last = int(steps[w, -1])
        octaves = max(1, last.bit_length())
        wanted = np.concatenate([sample_steps(o) - 1 for o in range(octaves)])  # octaves count from step 1
        place = np.searchsorted(steps[w, :-1], wanted, "right") - 1
        over = wanted >= last
        shown = DIGIT_OF[codes[np.minimum(place, len(codes) - 1)]] if len(codes) else np.zeros(len(wanted), np.uint8)
        letters = np.frombuffer(DIGITS.encode(), np.uint8)[shown]
        letters = np.where(over, ord(END), letters).astype(np.uint8).tobytes().decode()
        parts += [letters[o * SAMPLES : (o + 1) * SAMPLES] for o in range(octaves)]
        parts.append("")
    return ".".join(parts[:-1])


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of steps at which the embeddings agree, octaves weighing as many steps as the longer text has there, less chance."""
    if a == b:
        return 1.0
    total = agreed = 0.0
    for x, y in zip(a.split(".."), b.split(".."), strict=True):
        first, second = x.split("."), y.split(".")
        if len(first) < len(second):
            first, second = second, first
        for octave, digits in enumerate(first):
            longer = np.frombuffer(digits.encode(), np.uint8)
            other = np.frombuffer((second[octave] if octave < len(second) else END * SAMPLES).encode(), np.uint8)
            counted = (longer != ord(END)) | (other != ord(END))
            n = int(counted.sum())
            if n:
                weight = (1 << octave) / SAMPLES
                total += weight * n
                agreed += weight * int(((longer == other) & counted).sum())
    share = agreed / total if total else 1.0
    return float(min(1.0, max(0.0, (share - CHANCE) / (1 - CHANCE))))


def fingerprints_of(texts: list[str]) -> list[str]:
    codes = [classes_of(t) for t in texts]
    zero = np.zeros(WALKS, np.int64)
    return [render(s, c) for s, c in zip(Walker().arrivals(codes, [zero] * len(codes)), codes, strict=True)]


def fingerprint_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its fingerprint; an input column fingerprint is replaced. Null counts as empty; equal texts have equal fingerprints."""
    kept = [f for f in df.schema.fields if f.name not in (text, "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            made = fingerprints_of([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(made, pa.string())], names=[*(f.name for f in kept), "fingerprint"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("fingerprint", T.StringType())]))


class EditReport:
    """Turns rows in order of doc_id, each bucket closed by a copy of the row after it, into rows of the report."""

    def __init__(self) -> None:
        self.walker = Walker()
        self.waiting: tuple | None = None

    def rows(self, ids: list, buckets: list[int], copies: list[bool], texts: list[str]) -> Iterator[tuple]:
        codes = [classes_of(t) for t in texts]
        zero = np.zeros(WALKS, np.int64)
        steps = self.walker.arrivals(codes, [zero] * len(codes))
        prints = [render(s, c) for s, c in zip(steps, codes, strict=True)]
        new = list(zip(ids, buckets, copies, texts, codes, steps, prints, strict=True))
        rows = [self.waiting, *new] if self.waiting else new
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2] and a[1] == b[1]]
        self.waiting = rows[-1] if rows and not rows[-1][2] else None
        tails = [b[4][: len(a[3]) // 4] for a, b in pairs]
        cuts = [len(a[3]) - len(a[3]) // 4 for a, _ in pairs]
        walked = self.walker.arrivals(tails, [a[5][:, cut].copy() for (a, _), cut in zip(pairs, cuts, strict=True)])
        for (a, b), cut, tail, more in zip(pairs, cuts, tails, walked, strict=True):
            edited = render(np.concatenate([a[5][:, :cut], more], axis=1), np.concatenate([a[4][:cut], tail]))
            text = a[3][:cut] + b[3][: len(tail)]
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            yield a[0], len(a[3]), digest, a[6], edited, likeness(a[6], edited), likeness(a[6], b[6])


_REPORT = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class Buckets:
    """Cuts (doc_id, hash of text) into buckets of about as many rows each, in order, null doc_ids last.

    ``bounds`` are quantiles of doc_id in order; one that repeats belongs to a doc_id that fills buckets by itself, which are
    then cut by the hash, as are those of ``nulls`` rows without doc_id.
    """

    def __init__(self, bounds: list, nulls: int):
        self.values = sorted(set(bounds))
        times = [bounds.count(v) for v in self.values] if len(self.values) < len(bounds) else [1] * len(bounds)
        self.own, self.first, at = [0], [0], 1  # buckets of the bound's own value, where they begin
        for n in times:
            self.own.append(n if n > 1 else 0)
            self.first.append(at)
            at += (n if n > 1 else 0) + 1
        self.nulls, self.null_first = max(1, nulls), at
        self.n = at + self.nulls

    def number(self, value: Column, text_hash: Column) -> Column:
        """The bucket of a row; the bound is found by a two-level search."""
        share = (text_hash / F.lit(2.0**64)) + 0.5
        part = lambda n: F.least(F.floor(share * n), n - 1).cast("int")
        of_nulls = self.null_first + part(F.lit(self.nulls))
        if not self.values:
            return F.when(value.isNull(), of_nulls).otherwise(0)
        side = max(1, int(len(self.values) ** 0.5))
        groups = [self.values[i : i + side] for i in range(0, len(self.values), side)]
        below = lambda array: F.size(F.filter(array, lambda x: x <= value))
        group = F.greatest(below(F.array(*(F.lit(g[0]) for g in groups))) - 1, F.lit(0))
        held = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group + 1)
        j = group * side + below(held)
        own, first = F.element_at(F.lit(self.own), j + 1), F.element_at(F.lit(self.first), j + 1)
        is_bound = (j > 0) & (F.element_at(F.array(*map(F.lit, self.values)), F.greatest(j, F.lit(1))) == value)
        return F.when(value.isNull(), of_nulls).otherwise(first + F.when(is_bound & (own > 0), part(F.greatest(own, F.lit(1)))).otherwise(own)).cast("int")


def edit_report(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the start of the next document's text).

    Null counts as empty. Rows are ordered by doc_id (null last), rows of one doc_id by a hash of their text, then by text; a
    table of one row follows itself. Texts move once, to the bucket of their doc_id, and the first row of each bucket is sent
    to the bucket before as well; a bucket's rows pass in order, a few at a time. A doc_id, or none, that many rows bear fills
    several buckets. Rows that are repeated whole stay together and follow one another. An empty table gives no rows.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    buckets = buckets or shuffle_partitions(spark)
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = documents.select(F.percentile_approx("doc_id", shares, 100 * buckets), F.count("*"), F.count("doc_id")).first()
    cuts = Buckets(sorted(found[0] or []) if buckets > 1 else [], -(-buckets * (found[1] - found[2]) // max(1, found[1])))
    text = F.coalesce("text", F.lit(""))
    placed = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).withColumn("bucket", cuts.number(F.col("doc_id"), F.col("hash")))
    # a row per bucket comes to the driver; a null doc_id has buckets of its own
    firsts = {r["bucket"]: r["first"] for r in placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect()}
    filled = sorted(firsts)
    ids, hashes, targets = [None] * cuts.n, [None] * cuts.n, [None] * cuts.n
    for i, b in enumerate(filled):
        ids[b], hashes[b], targets[b] = firsts[b]["doc_id"], firsts[b]["hash"], filled[i - 1]
    at = lambda values, type_: F.element_at(F.array(*(F.lit(v).cast(type_) for v in values)), F.col("bucket") + 1)
    is_first = F.col("doc_id").eqNullSafe(at(ids, kind)) & (F.col("hash") == at(hashes, "long"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    both = F.when(is_first, F.array(own, F.struct(at(targets, "int").alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    rows = placed.select("doc_id", "text", "hash", F.explode(both).alias("to")).select("doc_id", "text", "hash", "to.bucket", "to.copy")
    # a copy is needed once, and only of the first row; repeated rows follow it and are passed over
    ordered = rows.repartitionById(cuts.n, "bucket").sortWithinPartitions("bucket", "copy", "doc_id", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = EditReport()
        for b in slices(batches, "text", 1 << 21):
            columns = [b.column(c).to_pylist() for c in ("doc_id", "bucket", "copy", "text")]
            made = list(report.rows(*columns))
            out = batch_of(_REPORT, **{name: [r[i + 1] for r in made] for i, name in enumerate(_REPORT.names)})
            ids = pa.array([r[0] for r in made], b.schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([ids, *out.columns], names=["doc_id", *_REPORT.names])

    return ordered.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def bands(fingerprint: str) -> list[str]:
    """Names of the bands: BAND_WIDTH neighbouring samples of one octave, of octaves long enough to tell texts apart."""
    out = []
    for walk, part in enumerate(fingerprint.split("..")):
        for octave, digits in enumerate(part.split(".")):
            if octave >= 4:
                out += [f"{walk}.{octave}.{i}.{digits[i : i + BAND_WIDTH]}" for i in range(0, SAMPLES, BAND_WIDTH) if set(digits[i : i + BAND_WIDTH]) != {END}]
    return out


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and a hash of each of its bands."""
    for b in batches:
        names = [bands(p) for p in b.column("print").to_pylist()]
        flat = [xxhash.xxh64_intdigest(x) - (1 << 63) for n in names for x in n]
        owner = np.repeat(np.arange(len(names)), [len(n) for n in names])
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(flat, pa.int64())], names=["doc_id", "band"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = [likeness(x, y) for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(near, pa.float64())], names=["a", "b", "likeness"])


def _heads(left: DataFrame) -> DataFrame:
    """band and the HEADS smallest doc_ids of each band of two or more: parts of a band, by a hash, give theirs first."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    few = salted.withColumn("place", place("band", "salt")).filter(F.col("place") <= HEADS)
    few = few.withColumn("place", place("band")).filter(F.col("place") <= HEADS)
    heads = few.groupBy("band").agg(F.collect_list("doc_id").alias("heads")).filter(F.size("heads") > 1)  # HEADS of them at most
    return materialize(heads, "heads")


def similar_documents(prints: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, likeness): pairs of class representatives of at least ``threshold``.

    ``prints`` has doc_id and fingerprint. Equal fingerprints form one class, represented by its smallest doc_id; rows without
    doc_id take no part, empty texts share a class. In each round the classes left in a band are compared with its HEADS first
    ones, which then leave it, until no band holds two classes. So all classes that meet in a band are compared, and none hides
    another, while a round gives no more than HEADS pairs for a band's class. Pairs come once; no rows give none.
    """
    made = materialize(prints.filter(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("fingerprint").alias("print")), "classes")
    left = materialize(made.mapInArrow(_posted, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, band long"), "bands")
    found = None
    while True:
        counts = _heads(left)
        if counts.isEmpty():
            break
        pairs = left.join(counts, "band").select("band", "doc_id", F.explode("heads").alias("head")).filter(F.col("doc_id") > F.col("head"))
        pairs = materialize(pairs, "pairs")
        side = lambda x: made.select(F.col("doc_id").alias(x), F.col("print").alias(f"p{x}"))
        apart = pairs.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
        kind = made.schema["doc_id"].dataType.simpleString()
        like = materialize(apart.mapInArrow(_measured, f"a {kind}, b {kind}, likeness double").filter(F.col("likeness") >= threshold), "like")
        found = like if found is None else found.union(like)
        heads = counts.select("band", F.explode("heads").alias("doc_id"))
        rest = left.join(counts.select("band"), "band", "left_semi").join(heads, ["band", "doc_id"], "left_anti")
        now = materialize(rest, "bands")
        discard(left, pairs)
        left = now
    if found is None:
        return made.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness")).filter(F.lit(False))
    return found.dropDuplicates(["a", "b"])
