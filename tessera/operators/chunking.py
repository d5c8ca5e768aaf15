"""Chunks of marked text with the page each begins on.

Splitting is a fold over one string, so it runs in Python a batch of documents at a time; what surrounds it
(markers, page lookup, fixed-width slices, fences) also exists as DataFrame operations.

Pieces know where they come from: every piece carries the offset of its characters in the text without markers, through
packing and overlap, so page lookup is exact. ``page_mode="compat"`` counts emitted characters instead, overlaps included, as
some older indexes did.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import FENCE, PAGE_MARKER

#: Separators from the strongest to none, and the fence.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
TICKS = "```"

_MARKER, _FENCE = re.compile(PAGE_MARKER), re.compile(FENCE)


class Piece(NamedTuple):
    """Characters and where the first of them stands."""

    at: int
    text: str


class Chunk(NamedTuple):
    index: int
    text: str
    page_number: int | None
    is_code: bool


def fenced(text: str) -> bool:
    bare = text.strip()
    return bare.startswith(TICKS) and bare.endswith(TICKS)


def without_markers(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without page markers, and (offset in it, page) of each marker."""
    kept, spots, length, at = [], [], 0, 0
    for found in _MARKER.finditer(text):
        kept.append(text[at : found.start()])
        length += found.start() - at
        spots.append((length, int(found[1])))
        at = found.end()
    return "".join([*kept, text[at:]]), spots


class Splitter:
    def __init__(self, size: int = 512, overlap: int = 50, least: int = 0):
        if overlap >= size:
            raise ValueError("the overlap must be smaller than the chunk size")
        self.size, self.overlap, self.least = size, overlap, least

    def _plain(self, piece: Piece, level: int = 0) -> Iterator[Piece]:
        """Pack parts cut after a separator as far as they fit; a part that does not fit alone is cut at the next level."""
        if len(piece.text) <= self.size:
            yield piece
            return
        if SEPARATORS[level] == "":
            yield from (Piece(piece.at + i, piece.text[i : i + self.size]) for i in range(0, len(piece.text), self.size))
            return
        begin = end = 0
        for stop in self._cuts(piece.text, SEPARATORS[level]):
            if stop - begin > self.size:
                if end > begin:
                    yield Piece(piece.at + begin, piece.text[begin:end])
                begin = end
                if stop - begin > self.size:
                    yield from self._plain(Piece(piece.at + begin, piece.text[begin:stop]), level + 1)
                    begin = stop
            end = stop
        if end > begin:
            yield Piece(piece.at + begin, piece.text[begin:end])

    @staticmethod
    def _cuts(text: str, separator: str) -> Iterator[int]:
        at = 0
        while (found := text.find(separator, at)) >= 0:
            at = found + len(separator)
            yield at
        if at < len(text):
            yield len(text)

    def _long_fence(self, piece: Piece) -> Iterator[Piece]:
        """Whole lines in fences of their own; one line that is too long stays whole."""
        head, lines = TICKS + "\n", piece.text.strip("`\n").split("\n")
        at = piece.at + len(piece.text) - len(piece.text.lstrip("`\n"))
        held: list[str] = []
        used, begin = len(head), at
        for line in lines:
            if held and used + len(line) + 1 + 4 > self.size:
                yield Piece(begin, head + "".join(held) + TICKS)
                held, used, begin = [], len(head), at
            held.append(line + "\n")
            used += len(line) + 1
            at += len(line) + 1
        if held:
            yield Piece(begin, head + "".join(held) + TICKS)

    def pieces(self, text: str) -> Iterator[Piece]:
        """Fences and plain pieces in order; pieces of white space only are left out."""
        at = 0
        for found in [*_FENCE.finditer(text), None]:
            between = Piece(at, text[at : found.start() if found else len(text)])
            if between.text.strip():
                yield from (p for p in self._plain(between) if p.text.strip())
            if found:
                whole = Piece(found.start(), found[0])
                yield from [whole] if len(whole.text) <= self.size else self._long_fence(whole)
                at = found.end()

    def merged(self, pieces: Iterator[Piece]) -> Iterator[list[Piece]]:
        """Runs of pieces that make a chunk; a plain run after a full one starts with its overlap, a fence stands alone."""
        run: list[Piece] = []
        for piece in pieces:
            if fenced(piece.text):
                if run:
                    yield run
                yield [piece]
                run = []
                continue
            if run and _length(run) + len(piece.text) > self.size:
                yield run
                run = _tail(run, self.overlap)
                run.append(piece)
                if _length(run) > 1.5 * self.size:
                    yield _head(run, self.size)
                    run = _tail(run, _length(run) - self.size + self.overlap)
            else:
                run.append(piece)
        if run:
            yield run

    def split(self, text: str | None, page_mode: str = "exact") -> Iterator[Chunk]:
        bare, spots = without_markers((text or "").strip())
        offsets = [at for at, _ in spots]
        emitted = index = 0
        for run in self.merged(self.pieces(bare)):
            joined = "".join(p.text for p in run)
            blank = len(joined) - len(joined.lstrip())
            start = emitted + blank if page_mode == "compat" else _tail(run, len(joined) - blank)[0].at
            emitted += len(joined)
            shown = joined.strip()
            if len(shown) >= self.least:
                place = bisect_right(offsets, start)
                yield Chunk(index, shown, spots[place - 1][1] if place else None, fenced(joined))
                index += 1


def _length(run: list[Piece]) -> int:
    return sum(len(p.text) for p in run)


def _tail(run: list[Piece], n: int) -> list[Piece]:
    """The last ``n`` characters of a run, as pieces."""
    out: list[Piece] = []
    for piece in reversed(run):
        if n <= 0:
            break
        taken = min(n, len(piece.text))
        out.append(Piece(piece.at + len(piece.text) - taken, piece.text[len(piece.text) - taken :]))
        n -= taken
    return out[::-1]


def _head(run: list[Piece], n: int) -> list[Piece]:
    out: list[Piece] = []
    for piece in run:
        if n <= 0:
            break
        out.append(Piece(piece.at, piece.text[:n]))
        n -= len(piece.text)
    return out


def chunk_documents(documents: DataFrame, size: int = 512, overlap: int = 50, least: int = 0, page_mode: str = "exact") -> DataFrame:
    """(doc_id, chunk_index, text, page_number, is_code) of every document's text; indexes are dense after short chunks are dropped."""
    splitter = Splitter(size, overlap, least)
    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("chunk_index", pa.int32()), ("text", pa.string()), ("page_number", pa.int32()), ("is_code", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *c) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for c in splitter.split(t, page_mode)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, chunk_index int, text string, page_number int, is_code boolean")


def fixed_width(documents: DataFrame, size: int = 512) -> DataFrame:
    """(doc_id, chunk_index, text): slices of a fixed number of characters."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    cut = documents.filter(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("chunk_index"))
    return cut.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * size + 1, F.lit(size)).alias("text"))


def page_markers(documents: DataFrame) -> DataFrame:
    """(doc_id, marker_no, marker_offset, page): where each marker stands in the text without markers."""
    pages = F.regexp_extract_all("text", F.lit(PAGE_MARKER), F.lit(1))
    rows = documents.select("doc_id", F.posexplode(F.split("text", PAGE_MARKER)).alias("marker_no", "part"), pages.alias("pages"))
    before = Window.partitionBy("doc_id").orderBy("marker_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("marker_offset", F.sum(F.length("part")).over(before))
    kept = placed.filter(F.col("marker_no") < F.size("pages"))
    return kept.select("doc_id", "marker_no", "marker_offset", F.element_at("pages", F.col("marker_no") + 1).cast("int").alias("page"))


def page_asof(positions: DataFrame, markers: DataFrame) -> DataFrame:
    """Add the page of the last marker at or before each (doc_id, position); of markers at one place the later one counts.

    An as-of join in one pass: both sides in one order per document, the last page carried along; no pair is formed.
    """
    left = positions.select("doc_id", "position", F.lit(1).alias("side"), F.lit(0).alias("marker_no"), F.lit(None).cast("int").alias("page"))
    right = markers.select("doc_id", F.col("marker_offset").alias("position"), F.lit(0).alias("side"), F.col("marker_no").cast("int"), "page")
    order = Window.partitionBy("doc_id").orderBy("position", "side", "marker_no").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.union(right).withColumn("page", F.last("page", ignorenulls=True).over(order))
    return merged.filter("side = 1").select("doc_id", "position", "page")


def fence_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, segment_no, is_fence, text): fences and what lies between them, in order, without blank gaps."""
    gaps, fences = F.split("text", FENCE), F.regexp_extract_all("text", F.lit(FENCE), F.lit(0))
    pair = F.transform(gaps, lambda g, i: F.array(F.struct(F.lit(False).alias("is_fence"), g.alias("text")), F.struct(F.lit(True).alias("is_fence"), F.get(fences, i).alias("text"))))
    rows = documents.select("doc_id", F.posexplode(F.flatten(pair)).alias("at", "x")).filter(F.col("x.text").isNotNull() & F.col("x.text").rlike(r"\S"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return rows.select("doc_id", number.alias("segment_no"), "x.is_fence", "x.text")
