"""Language identification by prediction by partial matching.

For each language a variable-order context tree over all 256 byte values (orders 0 to 3) is counted once and frozen. A byte
that its context has seen costs its share; otherwise the escape is paid (as many chances as the context has distinct
followers) and the next shorter context predicts, without the bytes just excluded; below order 0 all bytes are alike. As
a follower in a context is one in all shorter contexts too, what exclusion leaves of these depends on the context alone: so
a tree is two sorted tables for each order, code lengths by gram and escapes by context, and holds only what was seen.
A text's code length in a language is the exact sum over its bytes. The language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import batch_of, slices

#: Documents of each language that are learned from, the first by a hash of doc_id; texts are taken whole.
TRAIN_DOCUMENTS = 300
ORDER = 3
UNKNOWN = "und"
#: Bytes of text whose grams a worker handles at once, divided by the number of languages beyond a few.
_BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> bytes:
    """A-Z lower-cased UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(raw: bytes) -> np.ndarray:
    """Every byte with the ORDER bytes before it, packed; line feeds stand before the text."""
    b = np.frombuffer(b"\n" * ORDER + raw, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


@dataclass
class Model:
    """Sparse frozen counts: for each language, packed grams and how often they occur."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    digest: str = field(init=False)

    def __post_init__(self) -> None:
        h = xxhash.xxh3_128()
        for name, g, c in zip(self.languages, self.grams, self.counts, strict=True):
            h.update(name.encode()), h.update(g.tobytes()), h.update(c.tobytes())
        self.digest = h.hexdigest()


@dataclass
class Tree:
    """The frozen context tree of one language; lists are by order."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> Tree:
        """From packed grams of ORDER + 1 bytes, in order and distinct, and their counts."""
        tree = Tree([], [], [], [])
        below = np.full(256, 1 / 256)  # probability of each byte where nothing has been seen
        for order in range(ORDER + 1):
            packed, at = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1 & 0xFFFFFFFF), return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(packed))
            contexts, of = np.unique(packed >> np.uint32(8) if order else np.zeros_like(packed), return_inverse=True)
            total, distinct = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            whole = np.where(distinct == 256, total, total + distinct)
            share = n / whole[of]
            shorter = below[packed] if not order else below[np.searchsorted(tree.grams[-1], packed & np.uint32((1 << 8 * order) - 1))]
            left = np.maximum(1 - np.bincount(of, weights=shorter, minlength=len(contexts)), 1e-12)
            tree.grams.append(packed), tree.bits.append(-np.log2(share)), tree.contexts.append(contexts)
            tree.escapes.append(-np.log2(np.where(distinct == 256, 1.0, distinct / whole) / left))
            below = share
        return tree

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each packed gram after the bytes before it."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            key = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1 & 0xFFFFFFFF)
            seen, at = _find(self.grams[order], key)
            out[left[seen]] += self.bits[order][at[seen]]
            left, key = left[~seen], key[~seen]
            known, at = _find(self.contexts[order], key >> np.uint32(8) if order else np.zeros_like(key))
            out[left[known]] += self.escapes[order][at[known]]
        out[left] += 8
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


_TREES: dict[str, list[Tree]] = {}


def trees(model: Model) -> list[Tree]:
    """The model's trees, kept by the worker."""
    if model.digest not in _TREES:
        _TREES.clear()
        _TREES[model.digest] = [Tree.of(g, c) for g, c in zip(model.grams, model.counts, strict=True)]
    return _TREES[model.digest]


def text_bits(model: Model, texts: list[str | None]) -> np.ndarray:
    """Bits of each whole text in each language. Equal grams of a block of text are looked up once."""
    out = np.zeros((len(texts), len(model.languages)))
    raws = [fold(t) if t else b"" for t in texts]
    if not any(raws):
        return out
    packed = np.concatenate([grams(r) for r in raws])
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    for i in range(0, len(packed), _BLOCK):
        distinct, at = np.unique(packed[i : i + _BLOCK], return_inverse=True)
        of = owner[i : i + _BLOCK]
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for k, tree in enumerate(trees(model)):
            out[of[begins], k] += np.add.reduceat(tree.lengths(distinct)[at], begins)
    return out


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score); the score is the posterior share of the winner, 0 for ``und``. Of languages with equal codes the first by name wins."""
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    bits = text_bits(model, texts)
    best = bits.argmin(1)
    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    return [(model.languages[k], float(s)) if has_letter(t) else (UNKNOWN, 0.0) for t, k, s in zip(texts, best, share, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(documents: DataFrame, allowed: Column, train_documents: int = TRAIN_DOCUMENTS) -> Model:
    """Count the context trees of every language on its first ``train_documents`` documents by hash, where ``allowed`` holds.

    Texts are taken whole. What comes to the driver are the distinct grams of this sample, which is bounded for each language;
    the ids of the sample are broadcast. Without a text of any language the model is empty.
    """
    usable = documents.filter(F.coalesce(allowed, F.lit(False)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("size"))  # a row for each language, fewer than the model's own
    # by hash, only about four times the sample of each language reaches the ranking, however large the language
    place = F.xxhash64("doc_id", F.lit(7))
    drawn = F.pmod(place, F.lit(1 << 30)) * F.col("size") < F.lit(float(4 * train_documents << 30))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ranked = usable.select("doc_id", "lang").join(F.broadcast(sizes), "lang").filter(drawn).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= train_documents)
    sample = ranked.select("lang", "doc_id").distinct()
    texts = usable.join(F.broadcast(sample), ["lang", "doc_id"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b in slices(batches, "text"):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts_ = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                parts = [grams(fold(t)) for t, x in zip(texts_, langs, strict=True) if x == lang and t]
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield batch_of(schema, lang=[lang] * len(g), gram=g.astype(np.int64), n=n)

    rows = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    rows = rows.sort_values(["lang", "gram"])
    parts = {x: p for x, p in rows.groupby("lang")}
    return Model(list(parts), [p["gram"].to_numpy(np.uint32) for p in parts.values()], [p["n"].to_numpy(np.int64) for p in parts.values()])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace ``text`` by lang_pred and score; input columns of these names are replaced.

    Texts that are null or have no letter are ``und`` with score 0; repeated rows get equal results. Texts of any length are
    coded whole. Of languages with equal codes the first by name wins; an empty model says ``und`` of everything.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's distinct grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, _BLOCK):
            found = predict(shared.value, b.column(text).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def language_report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``; see learn and identify. A null doc_id is not learned from, its held_out is null."""
    model = learn(documents, ~held_out(F.col("doc_id")))
    return identify(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
