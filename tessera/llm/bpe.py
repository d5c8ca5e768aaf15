"""Byte-level BPE encoding and decoding over a public vocabulary file.

A word (pre-token) is merged with a segment tree over the ranks of its adjacent pairs: the root holds the
leftmost pair of lowest rank, a merge changes three leaves, and each change climbs to the root in logarithmic
time, until the root holds no mergeable pair. All words of a batch that were not seen before are merged at
once: trees of equal width lie in one array, and each step merges at the root of every unfinished tree. A word of
many bytes, which would be the only unfinished one for most of its steps, has a tree in plain lists instead.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.arrow import batch_of, slices

#: Fixed value: the pattern that parts text before merging (public, shipped with the vocabulary).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

_NONE = np.int64(1) << 62
#: Words that a worker keeps with their ids; the table is emptied when full.
CACHE_WORDS = 300_000
#: Cells of the trees that are merged at once.
_TREE_CELLS = 1 << 19
#: Bytes from which a word is merged by itself.
_LONG_WORD = 512


def byte_letters() -> dict[str, int]:
    """Letters by which vocabulary files spell bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spell = lambda t: bytes(letters[c] for c in t)
        self.bytes_of = {i: spell(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        found = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where it cannot merge or a side is missing (-1)."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)


def merge_trees(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Merge every row of ``symbols`` (rows x width, width a power of two, -1 after the end); merged-away cells become -1."""
    n, width = symbols.shape
    bits = np.int64(width - 1).item().bit_length()
    symbols = symbols.copy()
    following = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()  # the next live cell; width: none
    preceding = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    right = np.full((n, width), -1, np.int64)
    right[:, :-1] = symbols[:, 1:]
    ranks = vocabulary.ranks(symbols.ravel(), right.ravel()).reshape(n, width)
    tree = np.full((n, 2 * width), _NONE, np.int64)
    tree[:, width:] = np.where(ranks < _NONE, ranks << bits | np.arange(width), _NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        at, merged = root & (width - 1), vocabulary.merged[root >> bits]
        gone = following[rows, at]
        after = following[rows, gone]
        before = preceding[rows, at]
        symbols[rows, at], symbols[rows, gone] = merged, -1
        following[rows, at] = after
        has_after, has_before = after < width, before >= 0
        preceding[rows[has_after], after[has_after]] = at[has_after]
        next_symbol = np.where(has_after, symbols[rows, np.minimum(after, width - 1)], -1)
        last_symbol = np.where(has_before, symbols[rows, np.maximum(before, 0)], -1)
        new_right, new_left = vocabulary.ranks(merged, next_symbol), vocabulary.ranks(last_symbol, merged)
        tree[rows, width + at] = np.where(new_right < _NONE, new_right << bits | at, _NONE)
        tree[rows, width + gone] = _NONE
        tree[rows[has_before], width + before[has_before]] = np.where(new_left < _NONE, new_left << bits | before, _NONE)[has_before]
        for leaf in (width + at, width + gone, width + np.where(has_before, before, at)):
            node = leaf >> 1
            while node[0] >= 1:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1
        rows = rows[tree[rows, 1] < _NONE]
    return symbols


def merge_word(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """Merge one word of any length; a step costs the levels of the tree that it changes."""
    n = len(symbols)
    width = max(2, 1 << (n - 1).bit_length())
    bits, mask, none = width.bit_length() - 1, width - 1, int(_NONE)
    rank_of, merged = vocabulary.rank_of, vocabulary.merged.tolist()
    symbols = [*symbols, *[-1] * (width + 1 - n)]  # the last cell stands beyond the end
    following, preceding = [*range(1, n), *[width] * (width + 2 - n)], list(range(-1, width))
    tree = [none] * (2 * width)

    def pair(at: int, after: int) -> int:
        rank = rank_of.get(symbols[at] << 20 | symbols[after], -1) if after < width else -1
        return none if rank < 0 else rank << bits | at

    for i in range(n - 1):
        tree[width + i] = pair(i, i + 1)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while (root := tree[1]) < none:
        at = root & mask
        gone, before = following[at], preceding[at]
        after = following[gone]
        symbols[at], symbols[gone] = merged[root >> bits], -1
        following[at] = after
        if after < width:
            preceding[after] = at
        changed = [(at, pair(at, after)), (gone, none)]
        if before >= 0:
            changed.append((before, pair(before, at)))
        for leaf, value in changed:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    return [x for x in symbols if x >= 0]


class Coder:
    """Encoder and decoder with a bounded table of words already merged: word -> (number of ids, ids joined by commas)."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[int, str]] = {}

    def _learn(self, words: Iterable[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) >= _LONG_WORD:
                ids = merge_word(self.vocabulary.byte_ids[np.frombuffer(raw, np.uint8)].tolist(), self.vocabulary)
                self.known[w] = (len(ids), ",".join(map(str, ids)))
                continue
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, entries in by_width.items():
            step = max(1, _TREE_CELLS // width)
            for i in range(0, len(entries), step):
                self._merge(width, entries[i : i + step])

    def _merge(self, width: int, entries: list[tuple[str, bytes]]) -> None:
        cells = np.full((len(entries), width), -1, np.int64)
        lengths = np.array([len(raw) for _, raw in entries])
        cells[np.arange(width) < lengths[:, None]] = self.vocabulary.byte_ids[np.frombuffer(b"".join(raw for _, raw in entries), np.uint8)]
        merged = merge_trees(cells, self.vocabulary)
        live = merged >= 0
        ids, counts = merged[live].tolist(), live.sum(1).tolist()
        at = 0
        for (word, _), n in zip(entries, counts, strict=True):
            self.known[word] = (n, ",".join(map(str, ids[at : at + n])))
            at += n

    def pieces(self, text: str) -> list[str]:
        """The text's words; special tokens stand alone."""
        special = self.vocabulary.special_pattern
        if special is None or not any(s in text for s in self.vocabulary.special):
            return PATTERN.findall(text)
        out: list[str] = []
        for part in special.split(text):
            if part in self.vocabulary.special:
                out.append(part)
            elif part:
                out += PATTERN.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[int, str]]:
        """(number of ids, ids in decimal joined by commas) of every whole text; (0, "") for null and empty texts."""
        parted = [self.pieces(t) if t else [] for t in texts]
        fresh = set().union(*parted) - self.known.keys() if parted else set()
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
            fresh = set().union(*parted)
        for token, i in self.vocabulary.special.items():
            self.known[token] = (1, str(i))
            fresh.discard(token)
        self._learn(fresh)
        known = self.known
        out = []
        for words in parted:
            found = [known[w] for w in words]
            out.append((sum(n for n, _ in found), ",".join([s for _, s in found])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file, kept between batches and tasks."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(df: DataFrame, vocabulary: str | None = None, text: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Replace ``text`` by n_tokens, ids (array of int), decoded (string); ``with_...`` leaves out the last two.

    ``vocabulary`` is a path that every executor can read; without one, each finds the public file in its own installation. Null and empty texts have no tokens and decode to an
    empty text. Words of any length are merged whole. Repeated rows give repeated results; extra columns
    pass through; those that bear a new name are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "n_tokens", "ids", "decoded")]
    added = [("n_tokens", "long")] + [("ids", "array<int>")] * with_ids + [("decoded", "string")] * with_decoded
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary or default_vocabulary())
        for b in slices(batches, text):
            found = c.encode(b.column(text).to_pylist())
            ids = [list(map(int, s.split(","))) if s else [] for _, s in found]
            columns = [pa.array([n for n, _ in found], pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            columns += [pa.array([c.decode(x) for x in ids], pa.string())] * with_decoded
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *(n for n, _ in added)])

    return df.mapInArrow(run, schema)


_REPORT = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_report(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for every row. Decodes from the ids, word by word.

    Null and empty texts have no tokens and the digests of nothing. Texts and words of any length are encoded whole; equal
    texts, repeated rows among them, give equal rows. An empty table gives none.
    """
    narrow = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary or default_vocabulary())
        table = {str(i): b for i, b in c.vocabulary.bytes_of.items()}
        for b in slices(batches, "text"):
            rows = []
            for n, ids in c.encode(b.column("text").to_pylist()):
                decoded = b"".join(map(table.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = batch_of(_REPORT, **{name: [r[i] for r in rows] for i, name in enumerate(_REPORT.names)})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.columns], names=["doc_id", *_REPORT.names])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_corpus(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every row, and whether the ids decode to its text (null: to an empty one).

    Repeated rows, rows without doc_id and texts of any length are encoded each by itself; other columns are left out. An empty
    table gives no rows.
    """
    narrow = documents.select("doc_id", "lang", "source", "text")
    names = ["doc_id", "lang", "source", "n_tokens", "ids", "decodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary or default_vocabulary())
        for b in slices(batches, "text", 1 << 21):
            texts = b.column("text").to_pylist()
            found = c.encode(texts)
            ids = [np.fromstring(s, np.int32, sep=",") if s else np.empty(0, np.int32) for _, s in found]
            same = [c.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
            added = [pa.array([n for n, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:3]), *added], names=names)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, lang string, source string, n_tokens long, ids array<int>, decodes boolean")
