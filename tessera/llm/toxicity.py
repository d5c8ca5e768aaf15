"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A document is cut into overlapping windows of words. Each word enters with an embedding of its own and the sum of the
embeddings of its character runs (of three, four and six bytes), both hashed; nothing else is known of a word. Gated
recurrent units read a window in both directions, attention weighs their states, and a logistic unit scores the pooled
state. A document's logit is that of its highest window; all windows of all texts are scored.

Labels are those of whole documents. The first epochs learn from every window of every training document under its document's
label; the later ones score all of these windows and follow the gradient of the highest one. A part of the training
documents is held back from that; all of them calibrate the score.

Word inputs, projected into the gates of both directions, are kept by word, so a word costs its products once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import slices

#: Words in a window, and from one window's start to the next one's.
WINDOW, STRIDE = 48, 36
#: Labelled documents that are learned from at most: the first by a hash of doc_id, each label up to half.
TRAIN_DOCUMENTS = 4000
#: Bytes of text that these may have, half for either label; what lies beyond, in the order of the hash, is not learned from.
TRAIN_BYTES = 64 << 20
WORD_ROWS, RUN_ROWS, DIM, HIDDEN = 1 << 16, 1 << 17, 12, 8
#: Lengths of the character runs, in bytes of a word with its ends marked.
RUNS = (3, 4, 6)
COMMON_RUNS = 30
#: Longest word in bytes; a longer one, as unspaced scripts have, enters as overlapping pieces, so that each of its runs is in one of them.
WORD_BYTES = 64
#: Windows a step; least steps over all windows, then over the highest window of each document, and between two looks for these; whole epochs.
BATCH, ALL_STEPS, TOP_STEPS, LOOK_STEPS = 128, 400, 300, 30
#: Sizes of the steps of the weights and of the embeddings.
RATE, EMBED_RATE = 0.01, 0.02
#: Share of the words that a training step leaves out, so that no document is known by a single rare word.
DROPOUT = 0.1
#: One training row in so many only takes part in calibrating the score.
HELD_BACK = 10
THRESHOLD = 0.7
#: Words whose inputs a worker keeps; the table is emptied when full.
CACHE_WORDS = 200_000
_SCORE_WINDOWS = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, with ASCII punctuation stripped from their ends unless nothing else is there; pieces of long ones."""
    words = [w.strip(b".,;:!?\"'()[]*#&%$|<>") or w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not any(len(w) > WORD_BYTES for w in words):
        return words
    overlap = RUNS[-1] - 1
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, max(1, len(w) - overlap), WORD_BYTES - overlap)]


def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its row; and the rows of its character runs (bytes of its UTF-8, ends marked), one word's after another's, with their numbers."""
    rows = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words), np.int64, len(words))
    marked = [b"^" + w + b"$" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(RUNS[-1] - 1, np.uint64)])
    value, found, of = data, [], []
    for n in range(2, RUNS[-1] + 1):
        value = value << np.uint64(8) | padded[n - 1 : n - 1 + len(data)]
        if n not in RUNS:
            continue
        whole = left >= n
        found.append((value[whole] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(40))
        of.append(owner[whole])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return rows, (np.concatenate(found)[order] % np.uint64(RUN_ROWS)).astype(np.int64), np.bincount(of, minlength=len(words))


def run_scale(lengths: np.ndarray) -> np.ndarray:
    """By what a word's sum over its runs is multiplied: 1, less from COMMON_RUNS runs on, so that the noise of many runs does not grow."""
    return np.sqrt(COMMON_RUNS / np.maximum(lengths, COMMON_RUNS)).astype(np.float32)


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover ``n`` words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Parameters by name; gates are ordered reset, update, candidate for the forward and then the backward direction."""

    p: dict[str, np.ndarray]
    #: Slope and offset that turn a document's highest logit into that of its label.
    calibration: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        n = 2 * DIM
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        p = {
            "word": draw(WORD_ROWS, DIM, scale=0.02), "run": draw(RUN_ROWS, DIM, scale=0.02),
            "input": draw(n, 6 * HIDDEN, scale=0.4), "bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": draw(HIDDEN, 3 * HIDDEN, scale=0.3), "backward": draw(HIDDEN, 3 * HIDDEN, scale=0.3),
            "attend": draw(2 * HIDDEN, HIDDEN, scale=0.4), "context": draw(HIDDEN, scale=0.4),
            "out": draw(2 * HIDDEN, scale=0.4), "out_bias": np.zeros(1, np.float32),
        }
        return Network(p)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words, with their rows, run rows and numbers of these."""
        rows, flat, lengths = encode_words(words)
        runs = np.add.reduceat(self.p["run"][flat], np.cumsum(lengths) - lengths, axis=0) * run_scale(lengths)[:, None]
        return np.concatenate([self.p["word"][rows], runs], axis=1), rows, flat, lengths

    def direction(self, gates: np.ndarray, mask: np.ndarray, weights: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States [steps, windows, HIDDEN] of one direction over its projected inputs; ``keep`` holds what learning needs."""
        steps, n, _ = gates.shape
        h, states, tape = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            recurrent = h @ weights
            ru = _sigmoid(gates[t, :, : 2 * HIDDEN] + recurrent[:, : 2 * HIDDEN])
            r, u = ru[:, :HIDDEN], ru[:, HIDDEN:]
            c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * recurrent[:, 2 * HIDDEN :])
            m = mask[t, :, None]
            new = h + m * (1 - u) * (c - h)
            if keep:
                tape.append((h, r, u, c, recurrent[:, 2 * HIDDEN :], m))
            states[t] = h = new
        return states, tape

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from projected inputs [steps, windows, 6 * HIDDEN]."""
        ahead, tape_a = self.direction(projected[:, :, : 3 * HIDDEN], mask, self.p["forward"], keep)
        behind, tape_b = self.direction(projected[::-1, :, 3 * HIDDEN :], mask[::-1], self.p["backward"], keep)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        hidden = np.tanh(both @ self.p["attend"])
        score = np.where(mask > 0, hidden @ self.p["context"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (logit, (both, hidden, weight, pooled, tape_a, tape_b)) if keep else logit

    def _back(self, grad: np.ndarray, tape: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32)
        dw, dh = np.zeros_like(weights), np.zeros_like(grad[0])
        for t in range(len(tape) - 1, -1, -1):
            h, r, u, c, rec, m = tape[t]
            d = grad[t] + dh
            dc = d * m * (1 - u) * (1 - c * c)
            du = d * m * (h - c) * u * (1 - u)
            dr = dc * rec * r * (1 - r)
            out[t] = np.concatenate([dr, du, dc], axis=1)
            through = np.concatenate([dr, du, dc * r], axis=1)
            dw += h.T @ through
            dh = d * (1 - m * (1 - u)) + through @ weights.T
        return out, dw

    def gradients(self, projected: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted logistic loss, and with respect to ``projected``."""
        logit, (both, hidden, attention, pooled, tape_a, tape_b) = self.forward(projected, mask, keep=True)
        d = (_sigmoid(logit) - label) * weight / len(label)
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["out"]
        dboth = attention[:, :, None] * dpool
        da = np.einsum("tnh,nh->tn", both, dpool)
        ds = attention * (da - (attention * da).sum(0))
        g["context"] = np.einsum("tn,tnk->k", ds, hidden)
        dhid = ds[:, :, None] * self.p["context"] * (1 - hidden * hidden)
        g["attend"] = np.einsum("tnh,tnk->hk", both, dhid)
        dboth = dboth + dhid @ self.p["attend"].T
        out_a, g["forward"] = self._back(dboth[:, :, :HIDDEN], tape_a, self.p["forward"])
        out_b, g["backward"] = self._back(dboth[::-1, :, HIDDEN:], tape_b, self.p["backward"])
        return g, np.concatenate([out_a, out_b[::-1]], axis=2)


class Scorer:
    """A network with the projected inputs of words that it has met."""

    def __init__(self, network: Network):
        self.network = network
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def _meet(self, words: list[bytes]) -> None:
        if len(self.place) + len(words) >= CACHE_WORDS:
            self.place.clear()
        while len(self.place) + len(words) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            x = self.network.features(part)[0]
            first = len(self.place) + 1  # row 0 is no word
            self.table[first : first + len(part)] = x @ self.network.p["input"] + self.network.p["bias"]
            self.place.update(zip(part, range(first, first + len(part)), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The calibrated score of each whole text; texts without words have that of a window without words."""
        slope, offset = self.network.calibration
        return _sigmoid(slope * self.highest([words_of(t) for t in texts]) + offset)

    def highest(self, parted: list[list[bytes]]) -> np.ndarray:
        """The highest window's logit of each list of words."""
        return self.peaks(parted)[0]

    def peaks(self, parted: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit of each list of words, and where that window starts."""
        distinct = set().union(*parted) if parted else set()
        fresh = distinct - self.place.keys()
        if len(self.place) + len(fresh) >= CACHE_WORDS:
            self.place.clear()
            fresh = distinct
        self._meet(sorted(fresh))
        codes = [np.fromiter(map(self.place.__getitem__, ws), np.int32, len(ws)) for ws in parted]
        spans = [(j, s, min(WINDOW, len(c) - s)) for j, c in enumerate(codes) for s in window_starts(len(c))]
        spans.sort(key=lambda x: x[2])
        best, at = np.full(len(parted), -np.inf), np.zeros(len(parted), np.int64)
        for i in range(0, len(spans), _SCORE_WINDOWS):
            part = spans[i : i + _SCORE_WINDOWS]
            steps = max(1, part[-1][2])
            index = np.zeros((steps, len(part)), np.int32)
            for k, (j, s, n) in enumerate(part):
                index[:n, k] = codes[j][s : s + n]
            mask = (index > 0).astype(np.float32)
            mask[0] = 1
            for (j, s, _), logit in zip(part, self.network.forward(self.table[index], mask).tolist(), strict=True):
                if logit > best[j]:
                    best[j], at[j] = logit, s
        return best, at


def calibrate(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit in which label 1 weighs ``prior`` in all; a little ridge keeps the slope finite."""
    n = np.bincount(labels, minlength=2)
    weight = np.where(labels == 1, prior / n[1], (1 - prior) / n[0]) * len(labels)
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - labels)) + 0.5 * (beta - [1, 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - step / max(1.0, np.abs(step).max())
    return max(0.05, float(beta[0])), float(beta[1])


class Trainer:
    """Steps of gradient descent on a network: Adam for its weights, Adagrad for the embeddings that a step touches."""

    def __init__(self, network: Network, rng: np.random.Generator):
        self.network, self.rng, self.steps = network, rng, 0
        self.dense = [k for k in network.p if k not in ("word", "run")]
        self.first, self.second = ({k: np.zeros_like(network.p[k]) for k in self.dense} for _ in range(2))
        self.squares = {k: np.full(len(network.p[k]), 1e-2, np.float32) for k in ("word", "run")}

    def epoch(self, windows: list[list[bytes]], labels: np.ndarray) -> None:
        """One pass over the windows in random order; both labels weigh the same."""
        share = labels.mean()
        weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for part in np.array_split(self.rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            self.step([windows[i] for i in part], labels[part], weights[part])

    def step(self, windows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray) -> None:
        p = self.network.p
        words = sorted(set().union(*windows)) or [b""]
        local = {w: k + 1 for k, w in enumerate(words)}
        x, rows, flat, lengths = self.network.features(words)
        index = np.zeros((max(1, *map(len, windows)), len(windows)), np.int64)
        for k, window in enumerate(windows):
            index[: len(window), k] = [local[w] for w in window]
        index *= self.rng.random(index.shape) >= DROPOUT
        mask = (index > 0).astype(np.float32)
        mask[0] = 1
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), x @ p["input"] + p["bias"]])
        g, projected = self.network.gradients(table[index], mask, labels, weights)
        order = np.argsort(index, axis=None, kind="stable")
        used, cuts = np.unique(index.ravel()[order], return_index=True)
        grad = np.zeros_like(table)
        grad[used] = np.add.reduceat(projected.reshape(-1, 6 * HIDDEN)[order], cuts, axis=0)
        grad = grad[1:]
        g["input"], g["bias"] = x.T @ grad, grad.sum(0)
        dx = grad @ p["input"].T
        self.steps += 1
        for k in self.dense:
            self.first[k] = 0.9 * self.first[k] + 0.1 * g[k]
            self.second[k] = 0.99 * self.second[k] + 0.01 * g[k] ** 2
            p[k] -= RATE * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-6)
        for name, where, part in (("word", rows, dx[:, :DIM]), ("run", flat, np.repeat(dx[:, DIM:] * run_scale(lengths)[:, None], lengths, axis=0))):
            order = np.argsort(where, kind="stable")
            touched, cuts = np.unique(where[order], return_index=True)
            total = np.add.reduceat(part[order], cuts, axis=0)
            self.squares[name][touched] += (total**2).mean(1)
            p[name][touched] -= EMBED_RATE * total / np.sqrt(self.squares[name][touched])[:, None]


def epochs(steps: int, examples: int) -> int:
    return max(1, -(-steps * BATCH // max(1, examples)))


def train(texts: list[str | None], labels: list[int], prior: float | None = None, seed: int = 5) -> Network:
    """Fit the network; the same rows in the same order give the same network. ``prior`` is the share of label 1 to expect."""
    documents, y = [words_of(t) for t in texts], np.array(labels, np.int64)
    network = Network.fresh(seed)
    if len(set(labels)) < 2:
        network.calibration = (0.0, 2.0 if labels and labels[0] else -2.0)
        return network
    rank = np.empty(len(y), np.int64)  # held back are every so many rows of either label, where there are enough
    for label in (0, 1):
        rank[y == label] = np.arange((y == label).sum())
    back = rank % HELD_BACK == HELD_BACK - 1
    if len(set(y[back])) < 2:
        back[:] = False
    fit = np.flatnonzero(~back)
    windows = [(documents[i][s : s + WINDOW], y[i]) for i in fit for s in window_starts(len(documents[i]))]
    trainer = Trainer(network, np.random.default_rng(seed))
    for _ in range(epochs(ALL_STEPS, len(windows))):
        trainer.epoch([w for w, _ in windows], np.array([label for _, label in windows], np.float32))
    again = epochs(LOOK_STEPS, len(fit))
    for _ in range(epochs(TOP_STEPS, again * len(fit))):
        scorer = Scorer(network)
        starts = np.concatenate([scorer.peaks([documents[i] for i in fit[k : k + 256]])[1] for k in range(0, len(fit), 256)])
        for _ in range(again):
            trainer.epoch([documents[i][s : s + WINDOW] for i, s in zip(fit, starts, strict=True)], y[fit].astype(np.float32))
    scorer = Scorer(network)
    logits = np.concatenate([scorer.highest(documents[k : k + 256]) for k in range(0, len(documents), 256)])
    network.calibration = calibrate(logits, y, prior or float(y.mean()))
    return network


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(documents: DataFrame, labels: DataFrame, allowed: Column, most: int = TRAIN_DOCUMENTS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Train on at most ``most`` labelled documents of ``most_bytes`` in all, half of them of either label where there are enough.

    What comes to the driver are the sample's ids with the sizes of its texts, then the texts that fit. Labels other than 0 and
    1, null ones and rows for which ``allowed`` is null are not learned from; a document with both labels is learned under each.
    """
    usable = labels.filter(F.coalesce(allowed, F.lit(False)) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id", F.lit(5))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    parts = [usable.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(most // 2) for y in (0, 1)]
    sample = parts[0].union(parts[1]).withColumn("order", order)
    found = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(F.broadcast(sample), "doc_id")
    chosen, room = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for r in found.groupBy("order", "doc_id", "toxic").agg(F.sum("bytes").alias("bytes")).orderBy("order", "doc_id", "toxic").collect():
        room[r["toxic"]] -= r["bytes"]
        if room[r["toxic"]] >= 0:
            chosen.append((r["doc_id"], r["toxic"]))
    if not chosen:
        return train([], [], prior)
    fitting = documents.sparkSession.createDataFrame(chosen, sample.select("doc_id", "toxic").schema)
    rows = documents.select("doc_id", "text").join(F.broadcast(fitting), "doc_id").orderBy("doc_id", "text").limit(most).collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], prior)


def score_documents(df: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Replace ``text`` by score; an input column score is replaced.

    Null and empty texts get the score of no words. Texts of any length are read whole, window by window, and words beyond
    WORD_BYTES as overlapping pieces. Equal texts, repeated rows among them, get equal scores; an empty table gives no rows.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "score")]
    shared = df.sparkSession.sparkContext.broadcast(network)  # its size is fixed by the constants above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, text, 1 << 21):
            scores = scorer.scores(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "score"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``; a null doc_id has a null held_out.

    Only labels of documents that are not held out are learned from. Where only one label is left, or none, every text has
    the same score.
    """
    network = learn(documents, labels, ~held_out(F.col("doc_id")))
    scored = score_documents(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), network)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
