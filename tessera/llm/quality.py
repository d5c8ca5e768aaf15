"""Quality rules with thresholds learned from the data.

Each document gets counts of its whole text. Rates made from these counts feed mergeable quantile sketches per
language and source: a value's bucket keeps its leading bits (exact below 128, within 1/64 above), and a sketch
is the count in each bucket, so sketches of any groups merge by adding counts. Thresholds are fences around the
quartiles of a document's group, FENCE spreads beyond them. A group's quartiles are drawn toward its language's, and those toward
everything's, by weight: n documents against WEIGHT, so no size switches from one fence to another.
A spread is the distance of the quartiles. Where most documents have the same rate, zero say, that tells nothing; the spread is
then what a single event (a symbol, a repeated line or run of words, a word of unusual length) adds to a rate, and shrinks with the
root of a document's size, as chance counts do: at the median size it is one event of the median document, in longer documents less.
Joining the quartiles to documents gives each its fences and its verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import batch_of, slices
from tessera.llm.words import SPACE, Tokens, windows
from tessera.runtime import materialize

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: A language's quartiles weigh as so many documents beside a group's own, everything's as many beside a language's.
WEIGHT = 100
#: From so many median sizes on, spreads shrink no more, so that a few events in a very long text are no outlier.
LARGEST_SIZE = 16
#: The fence lies so many spreads above the upper quartile (or below the lower one).
FENCE = 5
#: Where quartiles coincide, so many events: of what happens once in ten documents, four in one are chance in 1 of 250,000.
EVENTS = 4
#: Rates in thousandths (letters a word in hundredths): the size that they are rates of, what one event adds to them in a
#: document of size 1 (an expression over the quartiles), and the side that is bad.
RATES = {
    "symbol_rate": ("n_words", "1000", "high"),
    "dup_line_rate": ("n_lines", "1000", "high"),
    "repeat_rate": ("n_words", f"1000 * 2 * {REPEAT_WINDOW}", "high"),
    "word_length": ("n_words", "10 * q2", "both"),
}
#: What sketches are made of.
SKETCHED = (*RATES, "n_words", "n_lines")

_BASE = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64())])
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur at least twice."""
    if len(hashes) <= width:
        return 0
    runs = windows(hashes, width)
    ordered = np.sort(runs)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[: len(runs)] += again
    edge[width : width + len(runs)] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(texts: pa.Array) -> dict[str, list[int] | np.ndarray]:
    """Of each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word); zeros for null."""
    tokens = Tokens.of(texts)
    hashes, bounds, cuts = tokens.hashes(), tokens.bounds().tolist(), tokens.texts
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])[cuts]
    in_words = (tokens.data & 0xC0) != 0x80
    in_words &= ~SPACE[tokens.data]
    dup_lines, n_lines = [], []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        lines = [x for x in tokens.data[a:b].tobytes().split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines))), n_lines.append(len(lines))
    return {
        "n_words": np.diff(bounds), "word_chars": np.diff(upto(in_words)), "n_symbols": np.diff(upto(_IS_SYMBOL[tokens.data])), "n_dup_lines": dup_lines,
        "n_repeat_words": [repeated_words(hashes[a:b]) for a, b in zip(bounds, bounds[1:])], "n_lines": n_lines,
    }


def measured(df: DataFrame, text: str, keep_text: bool) -> DataFrame:
    """Add the counts of ``text``, and drop it unless ``keep_text``."""
    kept = [f for f in df.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            counts = batch_of(_BASE, **measure(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *counts.columns], names=[*(f.name for f in kept), *_BASE.names])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in _BASE.names)]))


def document_counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text, with the rates and base_failed; a row for every row.

    A null text counts as empty: all counts and rates are 0 and base_failed is true. Rows of any doc_id, null ones too, are
    counted each by itself.
    """
    return with_rates(measured(documents.select("doc_id", "lang", "source", "text"), "text", keep_text=False))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the rates and base_failed to counts."""
    return counts.select(
        "*",
        F.expr("1000 * n_symbols div greatest(n_words, 1)").alias("symbol_rate"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_line_rate"),
        F.expr("1000 * n_repeat_words div greatest(n_words, 1)").alias("repeat_rate"),
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_length"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def bucket(value: Column) -> Column:
    """The value with all but its seven leading bits cleared; integers only, so that any engine agrees."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, level, rate, bucket, n): sketches of each group (level 0), language (1) and everything (2).

    One sketch row per bucket; the levels above are merged from the groups' rows, not from documents. Documents that fail
    the base rule are no example of their group.
    """
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in SKETCHED)))
    groups = counts.filter(~F.col("base_failed")).select("lang", "source", rates.alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))
    upper = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    ))
    return groups.select(upper.alias("of"), "rate", "bucket", "n").groupBy("of.level", "of.lang", "of.source", "rate", "bucket").agg(F.sum("n").alias("n"))


def _fence(rate: str, size: str, at: Callable[[str, str], str]) -> tuple[str, str]:
    """The fences of a rate in a document of ``size``; ``at`` names a quartile of what is sketched."""
    of, event, _ = RATES[rate]
    median = f"greatest({at(of, 'q2')}, 1)"
    scale = f"greatest(cast(floor(sqrt(cast({median} * least(greatest({size}, 1), {LARGEST_SIZE} * {median}) as double))) as bigint), 1)"
    spread = f"greatest({FENCE} * ({at(rate, 'q3')} - {at(rate, 'q1')}), ({EVENTS} * {event.replace('q2', at(rate, 'q2'))}) div {scale})"
    return f"{at(rate, 'q1')} - {spread}", f"{at(rate, 'q3')} + {spread}"


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, size, <what is sketched>_q1, _q2, _q3) of each sketch by itself."""
    key = ["level", "lang", "source", "rate"]
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(whole)})
    at = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("size") * share, F.col("bucket")))
    found = ranked.groupBy(*key).agg(F.max("size").alias("size"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    of = lambda name, q: F.max(F.when(F.col("rate") == name, F.col(q))).alias(f"{name}_{q}")
    return found.groupBy("level", "lang", "source").agg(F.max("size").alias("size"), *(of(name, q) for name in SKETCHED for q in ("q1", "q2", "q3")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, size, quartiles drawn toward the level above, <rate>_low, <rate>_high at the median size)."""
    found = materialize(quartiles(sketch), "quartiles")
    names = [f"{name}_{q}" for name in SKETCHED for q in ("q1", "q2", "q3")]

    def drawn(level: int, above: DataFrame, same: Column) -> DataFrame:
        mixed = [F.expr(f"(own.size * own.{n} + {WEIGHT} * above.{n}) div (own.size + {WEIGHT})").alias(n) for n in names]
        own = found.filter(F.col("level") == level)
        return own.alias("own").join(above.alias("above"), same).select("own.level", "own.lang", "own.source", "own.size", *mixed)

    overall = found.filter("level = 2")
    by_lang = drawn(1, overall, F.expr("above.level = 2"))  # one row above
    by_group = drawn(0, by_lang, F.expr("own.lang <=> above.lang"))
    at = lambda name, q: f"{name}_{q}"
    fences = []
    for rate, (size, _, _) in RATES.items():
        low, high = _fence(rate, at(size, "q2"), at)
        fences += [F.expr(low).alias(f"{rate}_low"), F.expr(high).alias(f"{rate}_high")]
    return by_group.unionByName(by_lang).unionByName(overall).select("level", "lang", "source", "size", *names, *fences)


def judged(counts: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """Add ``kept`` to document counts, by the fences of ``learned_from``, else their own.

    The thresholds table holds a row per group, language and everything. A group is joined by a key that is
    never null, so documents without language or source form groups of their own; a group none of whose documents passes the base
    rule takes its language's, then everything's. Rows that fail the base rule
    are not kept; empty texts fail it. Repeated rows are judged alike; an empty table gives no rows.
    """
    fences = materialize(thresholds(sketches(counts if learned_from is None else learned_from)), "fences")
    value = F.struct(*(f"{name}_{q}" for name in SKETCHED for q in ("q1", "q2", "q3")))
    key = lambda *c: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c))
    by_group = fences.filter("level = 0").select(key("lang", "source").alias("__g"), value.alias("__v0"))
    by_lang = fences.filter("level = 1").select(key("lang").alias("__l"), value.alias("__v1"))
    overall = fences.filter("level = 2").select(F.lit(1).alias("__a"), value.alias("__v2"))
    joined = counts.withColumns({"__g": key("lang", "source"), "__l": key("lang"), "__a": F.lit(1)})
    joined = joined.join(by_group, "__g", "left").join(by_lang, "__l", "left").join(F.broadcast(overall), "__a", "left")  # one row
    joined = joined.withColumn("__v", F.coalesce("__v0", "__v1", "__v2"))
    bad = F.lit(False)
    for rate, (size, _, side) in RATES.items():
        low, high = _fence(rate, size, lambda name, q: f"__v.{name}_{q}")
        bad = bad | (F.col(rate) > F.expr(high))
        if side == "both":
            bad = bad | (F.col(rate) < F.expr(low))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~F.coalesce(bad, F.lit(False)))
    return joined.select(*counts.columns, kept.alias("kept"))


def quality_report(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, lang, source of every row of ``documents``; see judged and document_counts."""
    counts = materialize(document_counts(documents), "counts")
    return judged(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns.

    A verdict follows a row's own text, language and source: of two rows with one doc_id, or none, either may go. Empty texts
    and null ones go. Repeated rows stay or go together; an empty table gives no rows. Texts are measured a second time where they
    are judged, so that none of them moves; only the fences, a row for each group, are joined.
    """
    counts = materialize(document_counts(documents), "counts")
    names = {c: f"__{i}" for i, c in enumerate(documents.columns)}  # whatever columns there are, none clashes with the counts
    rows = with_rates(measured(documents.withColumnsRenamed(names), names["text"], keep_text=True))
    rows = rows.withColumns({"lang": F.col(names["lang"]), "source": F.col(names["source"])})
    return judged(rows, counts).filter("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
