"""Words of a text: maximal runs of characters other than ASCII white space, natively and in Python."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Odd multiplier of the rolling polynomial over word hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    total = hashes[:n].copy()
    for i in range(1, width):
        total *= _STEP
        total += hashes[i : i + n]
    return mix(total)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_EIGHT = np.uint64(0xA24BAED4963EE407)
#: Bytes beyond which a token's hash is not made side by side with others.
_SIDE_BYTES = 256


class Tokens(NamedTuple):
    """Words of many texts side by side: bytes of all texts, where each text begins, and each word's text, place and length in bytes."""

    data: np.ndarray
    texts: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Tokens:
        """Words of a column of strings; null texts have none."""
        column = column.cast(pa.large_string()).fill_null("")
        texts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[texts[0] : texts[-1]] if body is not None else np.empty(0, np.uint8)
        texts = texts - texts[0]
        inner = texts[(texts > 0) & (texts < len(data))]
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # whether a text begins here
        edge[inner] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        start = np.flatnonzero(word & ~(before & ~edge[:-1]))
        end = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
        return Tokens(data, texts, np.searchsorted(texts, start, "right") - 1, start, end - start)

    def lower(self) -> Tokens:
        """The same words with A-Z lower-cased."""
        return self._replace(data=np.where((self.data >= 65) & (self.data <= 90), self.data | np.uint8(32), self.data))

    def bounds(self) -> np.ndarray:
        """Where each text's words begin among all words, and their number."""
        return np.searchsorted(self.owner, np.arange(len(self.texts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a step."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        out = mix(self.length.astype(np.uint64) * _EIGHT)
        live, done = np.arange(len(out)), 0
        while len(live):
            left = self.length[live] - done
            out[live] = mix(out[live] * _STEP ^ (eight[self.start[live] + done] & _LOW[np.minimum(left, 8)]))
            live, done = live[left > 8], done + 8
            if done >= _SIDE_BYTES:
                for i in live.tolist():
                    at = int(self.start[i])
                    out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.data[at + done : at + int(self.length[i])].tobytes()))
                break
        return out
