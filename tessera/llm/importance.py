"""Resampling by importance: documents that look like a target collection are drawn more often.

Features are runs of one and two words. Their strings go through a dictionary of distinct features, in three steps:

1. A block of documents becomes the list of its distinct words and, for each document, the numbers of its words; the block's
   distinct features with their counts follow from these.
2. Each block's features are dealt over parts by a hash, packed by part. A part, one worker's at a time, holds all blocks'
   counts of its features: it makes a dictionary of the distinct strings, hashes each of them once, adds up the counts of each bucket, and
   answers every block with the buckets of the features that it sent.
3. Buckets give gains (a bounded table). A block's answers meet the block again, and gains times counts give the documents' weights.

A feature reaches a part once for each block, however often it stands there, so no word is hot; the number of parts grows with the
features, so a part's dictionary is bounded. The draw adds Gumbel noise from a hash of the doc_id and takes the highest scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import batch_of, slices
from tessera.llm.neardup import row_key
from tessera.llm.words import Tokens, mix
from tessera.runtime import materialize, shuffle_partitions

BUCKETS = 10_000
#: Words from which a document can be drawn, the share that is drawn, and the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: Bytes of text in a block, and features (repeats counted) for which there is one part.
BLOCK_BYTES, PART_FEATURES = 4 << 20, 2 << 20

#: Fixed value: bytes of words, before A-Z are lower-cased; all others separate.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array) -> Tokens:
    """The lower-cased words of a column of strings; null texts have none."""
    column = column.cast(pa.large_string()).fill_null("")
    texts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[texts[0] : texts[-1]]
    texts = texts - texts[0]
    word = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[texts] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(starts)
    return Tokens(data, texts, np.searchsorted(texts, start, "right") - 1, start, np.flatnonzero(ends) + 1 - start).lower()


def strings(lengths: np.ndarray, data) -> pa.Array:
    """Strings that lie one after another in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def packed(values: pa.Array, counts: np.ndarray | None = None) -> tuple[bytes, int]:
    """Lengths, counts if there are any, and bytes of strings, compressed; and the size of it all."""
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    raw = np.diff(offsets).astype(np.int32).tobytes()
    if counts is not None:
        raw += counts.astype(np.int32).tobytes()
    raw += memoryview(values.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def unpacked(blob: bytes, size: int, n: int, counted: bool) -> tuple[np.ndarray, np.ndarray | None, memoryview]:
    raw = memoryview(pa.decompress(blob, size, "zstd"))
    counts = np.frombuffer(raw, np.int32, n, 4 * n) if counted else None
    return np.frombuffer(raw, np.int32, n), counts, raw[4 * n * (2 if counted else 1) :]


class Block(NamedTuple):
    """Distinct words of some documents, the number of each word in reading order, and where each document's words begin."""

    words: pa.Array
    ids: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Block:
        tokens = words_of(texts)
        inside = np.zeros(len(tokens.data) + 1, np.int8)
        inside[tokens.start] += 1
        np.add.at(inside, tokens.start + tokens.length, -1)
        body = tokens.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        coded = strings(tokens.length, body).dictionary_encode()
        return Block(coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64), tokens.bounds())

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct features in order, for each occurrence its place among them, and each occurrence's document.

        A word's code is its number w; the code of the pair (v, w) is (v + 1) * number of words + w.
        """
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        paired = np.flatnonzero(owner[1:] == owner[:-1])
        codes = np.concatenate([self.ids, (self.ids[paired] + 1) * len(self.words) + self.ids[paired + 1]])
        distinct, place = np.unique(codes, return_inverse=True)
        return distinct, place, np.concatenate([owner, owner[paired]])

    def parts(self, distinct: np.ndarray, n_parts: int) -> np.ndarray:
        """The part of each distinct feature, the same in all blocks."""
        offsets = np.frombuffer(self.words.buffers()[1], np.int64, len(self.words) + 1, self.words.offset * 8)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        hashes = Tokens(data, offsets, offsets[:0], offsets[:-1], np.diff(offsets)).hashes()
        first, second = distinct // max(len(self.words), 1) - 1, distinct % max(len(self.words), 1)
        return mix(np.where(first < 0, np.uint64(0), hashes[first] * _STEP) + hashes[second]) % np.uint64(n_parts)

    def strings(self, distinct: np.ndarray) -> pa.Array:
        """The features of these codes as strings."""
        first, second = distinct // max(len(self.words), 1) - 1, distinct % max(len(self.words), 1)
        single = pa.array(first < 0)
        last = self.words.take(pa.array(second))
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(np.maximum(first, 0))), last, pa.scalar(" ", pa.large_string()))
        return pc.if_else(single, last, pairs)


def blocks(documents: DataFrame) -> DataFrame:
    """A row for each block of documents: block, doc_ids, rows (their keys), sizes (words of each), n_words, words, words_size, ids, ids_size."""
    narrow = documents.select("doc_id", row_key().alias("row"), "text")
    kind, most = narrow.schema["doc_id"].dataType.simpleString(), BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", most):
            block = Block.of(b.column("text"))
            words, words_size = packed(block.words)
            ids = block.ids.astype(np.int32).tobytes()
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = {
                "block": pa.array([number]), "doc_ids": one(b.column("doc_id")), "rows": one(b.column("row").cast(pa.binary())), "sizes": one(pa.array(np.diff(block.bounds))),
                "n_words": pa.array([len(block.words)]), "words": pa.array([words], pa.binary()), "words_size": pa.array([words_size]), "ids": pa.array([pa.compress(ids, "zstd", asbytes=True)], pa.binary()), "ids_size": pa.array([len(ids)]),
            }
            yield pa.RecordBatch.from_pydict(columns)
            number += 1

    return narrow.mapInArrow(run, f"block long, doc_ids array<{kind}>, rows array<binary>, sizes array<long>, n_words long, words binary, words_size long, ids binary, ids_size long")


def _restored(row: dict) -> Block:
    lengths, _, data = unpacked(row["words"], row["words_size"], row["n_words"], counted=False)
    ids = np.frombuffer(pa.decompress(row["ids"], row["ids_size"], "zstd"), np.int32).astype(np.int64)
    return Block(strings(lengths, data), ids, np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)]))


_SENT = "part long, block long, target boolean, n long, size long, features binary"


def sent_features(made: DataFrame, target: bool, n_parts: int) -> DataFrame:
    """The distinct features of each block with their counts, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = _restored(row)
                distinct, place, _ = block.features()
                counts = np.bincount(place, minlength=len(distinct))
                part = block.parts(distinct, n_parts)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1)) if len(order) else order
                values, counts = block.strings(distinct[order]), counts[order]
                rows = [(int(part[order[i]]), j - i, *packed(values.slice(i, j - i), counts[i:j])) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)])]
                for i in range(0, len(rows), 64):
                    p, n, blob, size = zip(*rows[i : i + 64])
                    yield pa.RecordBatch.from_pydict({"part": pa.array(p), "block": pa.array([row["block"]] * len(p)), "target": pa.array([target] * len(p)), "n": pa.array(n), "size": pa.array(size), "features": pa.array(blob, pa.binary())})

    return made.select("block", "sizes", "n_words", "words", "words_size", "ids", "ids_size").mapInArrow(run, _SENT)


def _answer_type(n_buckets: int) -> type:
    return np.uint16 if n_buckets <= 1 << 16 else np.int32


_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("buckets", pa.binary()), ("bucket", pa.int32()), ("in_source", pa.int64()), ("in_target", pa.int64())])


def dictionary(sent: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (block, part, buckets), the answers, and rows (bucket, in_source, in_target), the counts of each bucket in a task's features."""

    def answer(rows: list[dict], totals: np.ndarray) -> pa.RecordBatch:
        opened = [unpacked(r["features"], r["size"], r["n"], counted=True) for r in rows]
        distinct = strings(np.concatenate([x[0] for x in opened]), b"".join(x[2] for x in opened)).dictionary_encode()
        of_distinct = np.array([zlib.crc32(x) % n_buckets for x in distinct.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
        buckets = of_distinct[distinct.indices.to_numpy()]
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        answers = []
        for r, x, found in zip(rows, opened, np.split(buckets, cuts), strict=True):
            totals[int(r["target"])] += np.bincount(found, x[1], n_buckets).astype(np.int64)
            if not r["target"]:
                answers.append((r["block"], r["part"], found.astype(_answer_type(n_buckets)).tobytes()))
        none = [None] * len(answers)
        return batch_of(_ANSWER, block=[a[0] for a in answers], part=[a[1] for a in answers], buckets=[a[2] for a in answers], bucket=none, in_source=none, in_target=none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, n_buckets), np.int64)
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield answer(held, totals)
                    held = []
                held.append(row)
        if held:
            yield answer(held, totals)
        seen = np.flatnonzero(totals.any(0))
        none = [None] * len(seen)
        yield batch_of(_ANSWER, block=none, part=none, buckets=none, bucket=seen.astype(np.int32), in_source=totals[0][seen], in_target=totals[1][seen])

    dealt = sent.repartitionById(shuffle_partitions(sent.sparkSession), F.col("part").cast("int")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part long, buckets binary, bucket int, in_source long, in_target long")


def bucket_gains(counts: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, in_source, in_target) -> (bucket, gain), a row for each bucket that is in use, so n_buckets at most."""
    sums = counts.groupBy("bucket").agg(F.sum("in_source").alias("s"), F.sum("in_target").alias("t"))
    both = sums.join(F.broadcast(sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    double = lambda c, more: (F.col(c) + more).cast("double")
    ratio = double("t", 1) * double("all_s", n_buckets) / (double("s", 1) * double("all_t", n_buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(documents: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id, row (a digest of doc_id and text), n_features, weight of every row of ``documents``; ``target`` needs a text only.

    The weight is the floored mean of the gains of a document's features, repeats counted. Null and empty texts, and those without a word,
    have no features and weight 0. Very long texts count whole, in a block of their own; repeated rows and ties get equal weights. With an empty target
    all gains follow from the source alone; an empty source gives no rows. Columns other than doc_id and text play no part.
    """
    spark = documents.sparkSession
    made = materialize(blocks(documents), "blocks")
    aim = materialize(blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), "target-blocks")
    n_words = made.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    n_parts = 1 + 2 * n_words // PART_FEATURES
    found = materialize(dictionary(sent_features(made, False, n_parts).union(sent_features(aim, True, n_parts)), n_buckets), "dictionary")
    gain = np.zeros(n_buckets, np.int64)
    for r in bucket_gains(found.filter(F.col("bucket").isNotNull()).select("bucket", "in_source", "in_target"), n_buckets).collect():  # n_buckets rows at most
        gain[r["bucket"]] = r["gain"]
    gains = spark.sparkContext.broadcast(gain)
    kind = documents.schema["doc_id"].dataType

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _restored(row)
        distinct, place, owner = block.features()
        order = np.argsort(block.parts(distinct, n_parts), kind="stable")
        answers = right.sort_by("part").column("buckets").to_pylist()
        of_feature = np.empty(len(distinct), np.int64)
        of_feature[order] = gains.value[np.frombuffer(b"".join(answers), _answer_type(n_buckets))]
        n = np.bincount(owner, minlength=len(row["sizes"]))
        upto = np.concatenate([[0], np.cumsum(of_feature[place[np.argsort(owner, kind="stable")]])])
        ends = np.concatenate([[0], np.cumsum(n)])
        total = upto[ends[1:]] - upto[ends[:-1]]
        lists = left.combine_chunks()
        weight = np.floor_divide(total, np.maximum(n, 1))
        return pa.table({"doc_id": lists.column("doc_ids").chunk(0).flatten(), "row": lists.column("rows").chunk(0).flatten(), "n_features": pa.array(n.astype(np.int64)), "weight": pa.array(weight)})

    answers = found.filter(F.col("block").isNotNull()).select("block", "part", "buckets")
    return made.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, f"doc_id {kind.simpleString()}, row binary, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from a digest of the doc_id; rows without one share theirs."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to rows with doc_id, row, n_features and an integer score: 1, 2, 3... for the drawn ones, else null.

    The noise spreads even rows of equal weight over thousands of scores, no more than a part in 2,700 to each. So the rows of a score
    are sorted by themselves, and start after those of all higher scores; there are as many scores as gains and noise can give (some ten thousands).
    """
    able = F.col("n_features") >= 2 * least_words - 1
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.col("score").desc())
    places = counts.select("score", (F.sum("n").over(higher.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__before"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(1))) * percent / 100).alias("__drawn"))
    places = places.filter(F.col("__before") < F.col("__drawn"))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    top = scored.filter(able).join(places, "score").withColumn("rank", F.col("__before") + F.row_number().over(within))
    top = top.withColumn("rank", F.when(F.col("rank") <= F.col("__drawn"), F.col("rank")))
    rest = scored.join(places.select("score"), "score", "left_anti").union(scored.filter(~able).join(places.select("score"), "score", "left_semi"))
    names = [*scored.columns, "rank"]
    return top.select(*names).union(rest.withColumn("rank", F.lit(None).cast("long")).select(*names))


def resampling_report(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``documents``; see weights and ranked.

    Of equal scores the smaller doc_id goes first, rows without doc_id last, then a digest of the text decides. Repeated rows have
    ranks of their own. Null and empty texts are too short to be drawn; an empty table gives no rows.
    """
    scored = weights(documents, target).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return ranked(materialize(scored, "scores")).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn rows with their columns, whole: the given share of those with enough words, the likest to the target first in line."""
    scored = materialize(weights(documents, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
    drawn = ranked(scored, percent).filter(F.col("rank").isNotNull()).groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("__n"))
    keyed = documents.withColumns({"__row": row_key(), "__tie": F.monotonically_increasing_id()})
    chosen = keyed.join(materialize(drawn, "drawn"), "__row")
    # repeated rows are alike, so any of them are the ones that were drawn
    return chosen.withColumn("__copy", F.row_number().over(Window.partitionBy("__row").orderBy("__tie"))).filter("__copy <= __n").select(*documents.columns)
