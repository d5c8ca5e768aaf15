"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key; rows are ordered by that key within their source, and a prefix sum of
sizes tells where the source's budget ends. The prefix sum is distributed: keys fall into equal ranges, 4,096 or
more, sizes are summed per (source, range) with map-side combination, the range totals are summed up within each
source, and only rows of one range are sorted together. A source with a third of all rows is thus spread over
thousands of groups; ranges grow in number with the rows, and the mix does not depend on how many there are. Budgets above a source's size repeat it in further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import n_words
from tessera.runtime import materialize

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all sizes ...
SHARE = 1.5
#: ... and no source more often than this.
MAX_EPOCHS = 2
SEED = "mix-1"
#: The key is a hexadecimal digest; its first digits, so many at least, name a range.
RANGE_DIGITS = 3
#: A range holds no more rows than this on average.
RANGE_ROWS = 1 << 16


def range_digits(rows: int) -> int:
    """How many digits name a range for a table of so many rows."""
    digits = RANGE_DIGITS
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also (rank, weight, target); one row per source.

    Water-filling in closed form: with sources in order of the level at which they fill up
    (max_epochs * size / weight), a source is full if the level that the rest would share without it is no lower.
    The table holds a row per source, never per document.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("level", (F.col("wanted") - F.col("spent")) / F.col("open_weight"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    open_level = F.max(F.when(~F.col("full"), F.struct(-F.col("spent"), F.col("level")))).over(everything)["level"]
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def mix_sources(
    df: DataFrame,
    size: Column,
    key: Column,
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    tie: Column | None = None,
    digits: int = RANGE_DIGITS,
) -> DataFrame:
    """Add source_size, target, weight, first_epochs, taken to rows with ``size`` (long) and a ``key``.

    ``taken`` is what the mix takes of the row, repeats counted: the source's whole epochs times the size, and in
    the last epoch what lies before the cut, so that each source gives exactly floor(target). Rows with equal keys
    follow in order of size, then of ``tie``. A null key is a key of its own, unlike an empty one; a null source is a source of
    its own, ranked last. ``digits`` changes the plan only (see range_digits). Empty input gives no rows. The result has the columns of ``df``; those that bear a name added
    here are replaced; working columns begin with two underscores.
    """
    digest = F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), key.cast("string")), F.lit(f"{seed}")))
    # never null, so that the window and the join hash alike and rows move once
    group = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.withColumns({"__size": size.cast("long"), "__key": digest, "__group": group, "__tie": F.lit(0) if tie is None else tie})
    rows = rows.withColumn("__range", F.substring("__key", 1, digits))
    ranges = rows.groupBy("__group", "__range").agg(F.sum("__size").alias("range_size"))
    totals = ranges.groupBy("__group").agg(F.sum("range_size").alias("source_size"))
    named = F.when(F.col("__group") != "", F.substring("__group", 2, 2**31 - 1))
    targets = source_targets(totals.select(named.alias("source"), "source_size"), weights, share, max_epochs)
    targets = targets.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    before_range = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__offset", F.coalesce(F.sum("range_size").over(before_range), F.lit(0))).join(targets.drop("source"), "__group")
    offsets = offsets.select("__group", "__range", "__offset", *(F.col(x).alias(f"__{x}") for x in ("source_size", "weight", "target")))
    within = Window.partitionBy("__group", "__range").orderBy("__key", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("__target") - F.col("__epochs") * F.col("__source_size")).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__offset") - F.col("__before"))).cast("long")
    added = {"size": "__size", "source_size": "__source_size", "weight": "__weight", "target": "__target", "epochs": "__epochs", "last_epoch": "__last"}
    return (
        rows.join(offsets, ["__group", "__range"])
        .withColumn("__epochs", whole)
        .withColumn("__last", last)
        .select(*(c for c in df.columns if c not in {*added, "taken"}), *(F.col(v).alias(k) for k, v in added.items()), (F.col("__epochs") * F.col("__size") + F.col("__last")).alias("taken"))
    )


def document_key() -> Column:
    """The doc_id, or a digest of the text where there is none, so that such rows have keys of their own."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; see mix_sources. Null texts have size 0."""
    narrow = documents.select("doc_id", "source", document_key().alias("key"), n_words(F.col("text")).alias("words"))
    narrow = materialize(narrow, "sizes")  # texts are read once; what moves is narrow
    return mix_sources(narrow, F.col("words"), F.col("key"), digits=range_digits(narrow.count())).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its source's epochs take it, the one at the cut shortened to its share.

    Columns are those of ``documents``. Documents without words, null texts among them, have no share in a budget of words; they
    are clean input all the same and stay once. Rows of one doc_id, or of none, are taken each by itself, in an order that does not
    change from run to run; an empty table gives no rows.
    """
    columns = documents.columns
    held = documents.select(F.struct(*columns).alias("row"), "doc_id", "source", document_key().alias("key"), F.xxhash64("text").alias("tie"), n_words(F.col("text")).alias("words"))
    digits = range_digits(documents.count())
    mixed = mix_sources(held, F.col("words"), F.col("key"), tie=F.col("tie"), digits=digits).withColumn("text", F.col("row")["text"])
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("last_epoch") > 0).cast("long")).cast("int")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("last_epoch").cast("int")), "")
    partial = (F.col("copy") == F.col("epochs")) & (F.col("last_epoch") > 0) & (F.col("last_epoch") < F.col("size"))
    out = mixed.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.select(F.col("row").withField("text", F.when(partial, cut).otherwise(F.col("text"))).alias("row")).select("row.*")
