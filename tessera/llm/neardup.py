"""Near-duplicate documents: an inverted join over the coordinates of MinHash signatures.

Documents with equal shingle sets form one class, found by a digest. Each class is posted under the
(coordinate, value) pairs of its signature. Two classes that link agree in ``MATCHES`` of ``COORDINATES`` pairs but for
odds of about 1 in 100,000 (a similarity of just 0.75; far less above), so with pairs in order of rising frequency
they meet within each one's first n - MATCHES + 1 pairs: only this prefix is posted, and pairs that nobody else has,
most of them, drop out at once. Posting lists are merged by skipping: every class is first compared with the
list's most typical member, and what these verified links connect is skipped from then on. What a list
still holds in different components goes through the same prefix argument over the full shingle sets (a link
needs three quarters of the larger set, so the rarest quarter of each must meet), which leaves out classes that
merely share a frequent passage; short lists are compared outright. Candidates go on if a longer signature
agrees in enough coordinates (again at odds of a millionth for a link), and every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import batch_of, slices
from tessera.llm.graph import components
from tessera.llm.words import Tokens, mix, windows
from tessera.runtime import materialize

WIDTH = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES, MATCHES = 32, 13
#: The longer signature, in 16-bit values, of classes that may link.
LONG_COORDINATES, LONG_MATCHES = 256, 160
#: Classes of a posting list that stay together where the list is joined.
LIST_PART = 256
#: Lists of more classes are merged over the prefixes of full sets.
SHORT_LIST = 16

_SEEDS = np.random.default_rng(10).integers(0, 2**63, (2, LONG_COORDINATES), dtype=np.uint64)
_FACTORS, _OFFSETS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def shingle_sets_of(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; of the whole sequence where it has fewer words."""
    tokens = Tokens.of(texts).lower()
    hashes, bounds = tokens.hashes(), tokens.bounds().tolist()
    return [np.unique(windows(hashes[a:b], min(width, b - a))) if b > a else hashes[:0] for a, b in zip(bounds, bounds[1:])]


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least value of each coordinate's hash over the set."""
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024]
        least = np.minimum(least, (part[None, :] * _FACTORS[:coordinates, None] + _OFFSETS[:coordinates, None]).min(1))
    return least


def long_signature(shingles: np.ndarray) -> bytes:
    """16 bits of each of LONG_COORDINATES values; the first COORDINATES are those of the signature."""
    return (mix(signature(shingles, LONG_COORDINATES)) >> np.uint64(48)).astype(np.uint16).tobytes()


def row_key() -> Column:
    """A digest of doc_id and text, which tells rows of one doc_id, or of none, apart."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("="), F.coalesce("text", F.lit("")))))


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, row (its key), n_shingles, node (digest of the set; null without words), signature."""
    narrow = documents.select("doc_id", row_key().alias("row"), "text")
    schema = pa.schema([("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets_of(b.column("text"))
            out = batch_of(schema, n_shingles=[len(s) for s in sets], node=[set_digest(s) for s in sets], signature=[signature(s).view(np.int64) if len(s) else None for s in sets])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *out.columns], names=["doc_id", "row", *schema.names])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, row binary, n_shingles long, node binary, signature array<long>")


def shingle_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes), long (signature), size of the classes in ``nodes`` (node, row), made anew from
    their representatives' texts. A row's key is no hot key, and only texts that are wanted become sets."""
    once = Window.partitionBy("row").orderBy(F.lit(1))  # repeated rows lie together after the join
    texts = documents.select(row_key().alias("row"), "text").hint("merge").join(nodes.select("row", "node"), "row")  # the list grows with the data and is not broadcast
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary()), ("long", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets_of(b.column("text"))
            kept = [(n, s) for n, s in zip(b.column("node").to_pylist(), sets, strict=True) if set_digest(s) == n]
            yield batch_of(schema, node=[n for n, _ in kept], shingles=[s.tobytes() for _, s in kept], long=[long_signature(s) for _, s in kept], size=[len(s) for _, s in kept])

    made = texts.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("node", "text")
    return made.mapInArrow(run, "node binary, shingles binary, long binary, size long")


def rarest_first(postings: DataFrame, node: str, item: str, extra: list[str], needed: Column) -> DataFrame:
    """The prefix of each node's items in order of (frequency, item), so far that any two nodes with ``needed`` items in common meet.

    ``postings`` has one row per node and item with the node's number of items as ``total``. Items of one node only
    count as its first and are left out; ``place`` counts them.
    """
    shared = postings.groupBy(item).agg(F.count("*").alias("freq")).filter("freq > 1")
    shared = materialize(shared, "shared")  # read back, both sides of the join are plain exchanges, and a hot item's can be split
    kept = postings.join(shared, item)
    place = Window.partitionBy(node).orderBy("freq", item)
    held = Window.partitionBy(node)
    ranked = kept.withColumns({"__place": F.row_number().over(place), "__held": F.count("*").over(held)})
    placed = ranked.withColumn("place", F.col("total") - F.col("__held") + F.col("__place"))
    return placed.filter(F.col("place") <= F.col("total") - needed + 1).select(node, item, "freq", "place", *extra)


def matching(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose signatures, short and long, agree in enough coordinates."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("long").alias(f"l{x}"), F.col("size").alias(f"n{x}"))
    near = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint16).reshape(b.num_rows, -1) for n in ("la", "lb"))
                agree = x == y
                kept = (agree[:, :COORDINATES].sum(1) >= MATCHES) & (agree.sum(1) >= LONG_MATCHES)
                yield b.select(["a", "b"]).filter(pa.array(kept))

    return both.mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets link."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for a, c, x, y in zip(*(b.column(n).to_pylist() for n in ("a", "b", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    kept.append((a, c))
            yield batch_of(schema, a=[k[0] for k in kept], b=[k[1] for k in kept])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Texts without words, null ones among them, have no shingles, link with nothing and are kept. Repeated rows and copies
    are one class; rows that repeat the smallest doc_id itself are all kept. Rows without doc_id link as any others; only
    where no row that they reach has one is their component_id null, and kept true. Very long texts count whole. An
    empty table gives no rows.
    """
    return grouped(documents).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, node, group (one value for each component; null without words), component_id of every row."""
    signed = materialize(signatures(documents), "signatures")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    classes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(first_row, F.first("signature").alias("signature"))
    classes = materialize(classes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), "signature"), "classes")
    tokens = classes.select("node", F.posexplode("signature").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("token"), F.lit(COORDINATES).alias("total"))
    postings = materialize(rarest_first(tokens, "node", "token", [], F.lit(MATCHES)), "postings")

    typical = postings.groupBy("node").agg(F.sum(F.log2("freq")).alias("weight")).join(classes.select("node", "row"), "node")
    nodes = materialize(typical, "nodes")
    ranked = postings.join(nodes, "node")
    heads = ranked.groupBy("token").agg(F.max(F.struct("weight", "node"))["node"].alias("head"), F.max("freq").alias("freq"))
    # a long list's classes are dealt over parts, to each of which its head goes
    parts = lambda: (F.col("freq") / LIST_PART).cast("int")
    each = heads.withColumn("part", F.explode(F.sequence(F.lit(0), parts()))).drop("freq")
    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("node"), parts() + 1).cast("int"))
    first = dealt.join(each, ["token", "part"]).filter(F.col("node") != F.col("head"))
    first = first.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    sets = materialize(shingle_sets(documents, nodes), "sets")
    links = materialize(confirmed(matching(first, sets), sets), "links")

    rooted = components(links)
    placed = postings.join(rooted, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    lists = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("length"))
    still = materialize(placed.join(lists.filter(F.col("low") != F.col("high")).select("token", "length"), "token"), "lists")

    one = still.filter(F.col("length") <= SHORT_LIST)
    two = one.select("token", F.col("node").alias("b"), F.col("root").alias("root_b"))
    short = one.join(two, "token").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b"))).select(F.col("node").alias("a"), "b")

    rest = still.filter(F.col("length") > SHORT_LIST).select("node", "root").distinct()
    items = rest.join(sets, "node").select("node", "shingles").mapInArrow(_explode_sets, "node binary, shingle long, total long")
    needed = F.ceil(F.col("total") * PERCENT / 100)
    prefix = rarest_first(items, "node", "shingle", ["total"], needed).join(rest, "node")
    prefix = materialize(prefix.select("node", "shingle", "place", "total", "root"), "prefix")
    of_smaller = prefix.filter(F.col("place") <= F.col("total") - F.ceil(F.col("total") * 2 * PERCENT / (100 + PERCENT)) + 1)
    other = of_smaller.select(F.col("node").alias("b"), "shingle", F.col("root").alias("root_b"), F.col("total").alias("nb"), F.col("place").alias("pb"))
    smaller = (F.col("nb") < F.col("total")) | ((F.col("nb") == F.col("total")) & (F.col("b") < F.col("node")))
    near = 100 * F.col("nb") >= PERCENT * F.col("total")
    room = (100 + PERCENT) * (1 + F.least(F.col("total") - F.col("place"), F.col("nb") - F.col("pb"))) >= PERCENT * (F.col("total") + F.col("nb"))
    meets = (F.col("__s") == F.col("shingle")) & (F.col("root") != F.col("root_b")) & smaller & near & room
    long = prefix.join(other.withColumnRenamed("shingle", "__s"), meets).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    more = materialize(confirmed(matching(short.union(long).distinct(), sets), sets), "links")

    rooted = components(links.union(more))
    named = rooted.join(classes.select("node", "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    labels = named.join(least, "root").select("node", "root", "least")
    of_class = classes.select("node", "rep").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("group"), F.coalesce("least", "rep").alias("component"))
    of_class = materialize(of_class, "components")  # so that a class with a large share of all documents can be split
    out = signed.select("doc_id", "row", "n_shingles", "node").join(of_class, "node", "left")
    return out.select("doc_id", "row", "n_shingles", "node", "group", F.coalesce("component", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id"))


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each class, with the size of its set."""
    schema = pa.schema([("node", pa.binary()), ("shingle", pa.int64()), ("total", pa.int64())])
    for b in slices(batches, "shingles"):
        sets = b.column("shingles").to_pylist()
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        nodes = b.column("node").take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
        yield batch_of(schema, node=nodes, shingle=np.frombuffer(b"".join(sets), np.int64), total=np.repeat(sizes, sizes))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``documents``, and all rows without words.

    The row that stays has the smallest doc_id (none counts as largest); of several texts under it, one, and of a row that is
    repeated, one. Other texts under a doc_id stay or go with their own groups.
    """
    found = grouped(documents).filter(F.col("node").isNotNull()).groupBy("row", "group").agg(F.any_value("doc_id").alias("doc_id"), F.count("*").alias("n"))
    found = materialize(found, "grouped")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"].alias("row"))
    repeated = materialize(found.filter("n > 1").join(first, "row", "left_semi").select(F.col("row").alias("__row")), "repeated")
    removed = materialize(found.join(first.select("row"), "row", "left_anti").select(F.col("row").alias("__row")).union(repeated), "removed")
    keyed = documents.withColumn("__row", row_key())
    once = keyed.join(removed.hint("shuffle_hash"), "__row", "left_anti").select(*documents.columns)
    # of rows that are repeated whole, one; the partial aggregation leaves one to each task before they move
    several = keyed.join(repeated, "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*documents.columns)).alias("kept"))
    return once.unionByName(several.select("kept.*"))
