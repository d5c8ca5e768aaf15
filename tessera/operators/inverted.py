"""BM25 over a stored inverted index whose blocks know their highest impact, so that a search leaves out blocks that cannot matter.

A posting's impact is what it adds to a score, but for the weight of its term. Postings of a term (of a tenant) are a block,
those of a frequent term are cut by impact, in bands, and within a band by a digest of the doc_id, so that no block grows with the data. Blocks lie in
folders by tenant and by a digest of their term: a search reads the folders of the asked terms only, and of these first no more than
each block's size, lowest and highest impact.

The index is made from lists: where texts are read, the postings of many documents are put in order of their terms, so a list moves once, to
the task that makes its term's blocks, and with it all that a block needs. Terms of very many documents are dealt over slots.

What can be left out follows from these: if k documents of one term reach some score by that term alone, the k best of the question
reach it too. Terms that together cannot reach it, the weakest, are not essential: none of the k best has these only. So all blocks of
the essential terms are read, and of the others those that can hold a document found there. What was read goes to shards of documents, each
posting once however many questions ask for it, and a shard's scores are summed there and only its best go on.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import search_tokens
from tessera.operators import bm25
from tessera.runtime import materialize

#: Postings of a block, about; bands of a unit of impact; folders of a tenant; and postings of a file, about.
BLOCK, BANDS, BUCKETS, FILE = 1024, 8, 16, 1 << 20
#: Documents from which a term is dealt over slots; postings of a shard of documents, about.
HOT, SHARD = 1 << 20, 1 << 20
#: Postings that a worker holds before it hands them on, those that leave it at once, and pairs of a posting and a question at once.
_HELD, _SENT, _PAIRS = 1 << 20, 1 << 17, 1 << 20
#: Parts of a term are looked up for the candidates of a question only where these are fewer than so many times the parts.
_SPARSE = 8
#: Scores that differ by less are equal, as they are rounded.
_SLACK = 1e-5


def number(text: Column, modulus: Column | int) -> Column:
    """A digest of the text below ``modulus``."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), modulus if isinstance(modulus, Column) else F.lit(modulus))


def parts(df: Column) -> Column:
    """Over how many parts the postings of a term are dealt, in each band."""
    return F.ceil(F.greatest(df, F.lit(1)) / BLOCK)


def part_of(doc_id: Column, n: Column) -> Column:
    return number(doc_id.cast("string"), n).cast("long")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal columns, nulls among them: rows without a tenant are a tenant of their own."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in any column."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers of the values, in no order; equal values have equal ones, and null has one too."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _places(column: pa.Array) -> np.ndarray:
    """Numbers in the values' order, null first."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return pc.rank(column, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _digests(docs: pa.Array) -> np.ndarray:
    """``number`` of the doc_ids, before the remainder; made where it is asked for, as it would be the larger half of what moves."""
    known = pc.dictionary_encode(docs, null_encoding="encode")
    values = [0 if v is None else int.from_bytes(hashlib.md5(v.encode()).digest()[:4], "big") for v in known.dictionary.cast(pa.string()).to_pylist()]
    return np.array(values, np.int64)[known.indices.to_numpy(zero_copy_only=False)]


def _cut(batch: pa.RecordBatch, sizes: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``least`` postings."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(at, at[begin] + least, "right")) - 1, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def runs(documents: DataFrame, tenant: str | None = None) -> DataFrame:
    """(scope, term, n, occurrences, docs, counts, lengths): lists of postings of some documents, by term, with each document's number of
    tokens. In rows without term, n counts documents and occurrences their tokens."""
    kept = documents.select("doc_id", (F.col(tenant) if tenant else F.lit(0)).alias("scope"), "text")
    fields = [kept.schema["scope"], *T.StructType.fromDDL("term string, n long, occurrences long").fields, T.StructField("docs", T.ArrayType(kept.schema["doc_id"].dataType))]
    schema = T.StructType([*fields, *T.StructType.fromDDL("counts array<int>, lengths array<int>").fields])
    # what a worker holds is given here, as constants of a module stand for their first values in workers
    held = _HELD

    def lists(parts: list[tuple], texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        scope, total = pa.concat_arrays([x[0] for x in texts]), np.concatenate([x[1] for x in texts])
        of = _codes(scope)
        order = np.argsort(of, kind="stable")
        begins = _changes(of[order])
        n = np.diff(np.append(begins, len(order)))
        none = _list(pa.array([], pa.int32()), np.zeros(len(n), np.int64))
        docs = _list(pa.array([], kind), np.zeros(len(n), np.int64))
        tokens = np.add.reduceat(total[order], begins) if len(order) else n
        yield pa.RecordBatch.from_arrays([scope.take(pa.array(order[begins])), pa.nulls(len(n), pa.string()), pa.array(n), pa.array(tokens), docs, none, none], names=schema.names)
        if not parts:
            return
        scope, docs, terms = (pa.concat_arrays([x[i] for x in parts]) for i in (0, 1, 2))
        counts, lengths = (np.concatenate([x[i] for x in parts]) for i in (3, 4))
        known = pc.dictionary_encode(terms)
        code, of = known.indices.to_numpy(), _codes(scope)
        order = np.argsort(of * len(known.dictionary) + code, kind="stable")
        begins = _changes(of[order], code[order])
        n = np.diff(np.append(begins, len(order)))
        first, order = pa.array(order[begins]), pa.array(order)
        columns = [_list(c.take(order), n) for c in (docs, pa.array(counts), pa.array(lengths))]
        made = [scope.take(first), known.dictionary.take(pa.array(code).take(first)), pa.array(n), pa.array(np.add.reduceat(counts[order.to_numpy()].astype(np.int64), begins))]
        yield from _cut(pa.RecordBatch.from_arrays([*made, *columns], names=schema.names), n, _SENT)

    kind = to_arrow_type(kept.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, size = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            found = [Counter(bm25._TOKEN.findall(t.lower())) if t else Counter() for t in b.column("text").to_pylist()]
            total, n = np.array([c.total() for c in found], np.int64), np.array([len(c) for c in found])
            texts.append((b.column("scope"), total))
            if n.sum():
                owner = np.repeat(np.arange(b.num_rows), n)
                terms, counts = pa.array([t for c in found for t in c], pa.string()), np.array([k for c in found for k in c.values()], np.int32)
                at = pa.array(owner)
                parts.append((b.column("scope").take(at), b.column("doc_id").take(at), terms, counts, total[owner].astype(np.int32)))
                size += len(owner)
            if size >= held:
                yield from lists(parts, texts)
                parts, texts, size = [], [], 0
        if texts:
            yield from lists(parts, texts)

    return kept.mapInArrow(run, schema)


def build(documents: DataFrame, tenant: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(scope, bucket, term, band, part, df, idf, n, low, high, docs, impacts): a row for each block; docs are in order.

    ``documents`` has doc_id (an integer, a string, a date or a decimal), text. Statistics are each tenant's own; documents without a tenant form one. Null and empty texts count
    in them and have no postings. An empty table gives no blocks. Rows come together by tenant, bucket and file, as ``store`` writes them.
    """
    made = materialize(runs(documents, tenant), "runs")
    of_documents = made.filter("term is null").groupBy("scope").agg(F.sum("n").alias("n_docs"), (F.sum("occurrences").cast("double") / F.sum("n").cast("double")).alias("avgdl"))
    lists = made.filter("term is not null")
    counts = lists.groupBy("scope", "term").agg(F.sum("n").alias("df"))
    stats = materialize(of_documents, "stats")
    counted = counts.join(stats.select(F.col("scope").alias("__s"), "n_docs"), F.col("scope").eqNullSafe(F.col("__s"))).drop("__s")
    # a row per tenant; a term among its frequent ones stands for HOT postings at least
    frequent = F.collect_list(F.when(F.col("df") > HOT, F.struct("term", "df"))).alias("hot")
    facts = materialize(counted.groupBy("scope").agg(F.avg(bm25.idf(F.col("n_docs"), F.col("df"))).alias("mean"), F.sum("df").alias("postings"), frequent), "facts")
    hot = facts.select(F.col("scope").alias("__s"), F.explode("hot").alias("x")).select("__s", F.col("x.term").alias("__t"), F.col("x.df").alias("df"), F.ceil(F.col("x.df") / HOT).alias("slots"))
    same = F.col("scope").eqNullSafe(F.col("__s"))
    of_hot = same & (F.col("term") == F.col("__t"))
    names = ["scope", "term", "docs", "counts", "lengths"]
    dealt = _slots(lists.join(hot, of_hot).select(*names, "df", "slots"), BLOCK)
    rest = lists.join(hot.select("__s", "__t"), of_hot, "left_anti").select(*names, F.lit(None).cast("long").alias("df"), F.lit(0).cast("long").alias("slot"))
    both = facts.join(stats.withColumnRenamed("scope", "__s"), same).select(F.col("scope").alias("__s"), "n_docs", "avgdl", "mean", (F.floor(F.col("postings") / (buckets * FILE)) + 1).alias("files"))
    bucket = number(F.col("term"), buckets).cast("int")
    placed = rest.unionByName(dealt).join(both, same).withColumn("bucket", bucket).withColumn("file", F.pmod(F.xxhash64("term", "slot"), F.col("files"))).drop("__s", "files")
    moved = placed.repartition("scope", "bucket", "file").sortWithinPartitions("scope", "bucket", "term", "slot")
    kind, block, bands, held = placed.schema, BLOCK, BANDS, _HELD // 2
    docs = kind["docs"].dataType
    schema = T.StructType([kind["scope"], *T.StructType.fromDDL("bucket int, term string, band int, part long, df long, idf double, n long, low double, high double").fields, T.StructField("docs", docs), T.StructField("impacts", T.ArrayType(T.DoubleType()))])
    return moved.mapInArrow(lambda batches: _made(batches, schema.names, block, bands, held), schema)


def _slots(lists: DataFrame, block: int) -> DataFrame:
    """Lists of frequent terms, each dealt over the slots of its term by the part that a posting is in."""
    names = ["scope", "term", "docs", "counts", "lengths", "df", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column("docs")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), size)
            df, slots = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[owner] for c in ("df", "slots"))
            part = _digests(b.column("docs").flatten()) % -(-df // block)
            slot = part % slots
            order = np.lexsort((slot, owner))
            begins = _changes(owner[order], slot[order])
            n = np.diff(np.append(begins, len(order)))
            of, at = pa.array(owner[order][begins]), pa.array(order)
            columns = [b.column("scope").take(of), b.column("term").take(of), *(_list(b.column(c).flatten().take(at), n) for c in names[2:5]), b.column("df").take(of), pa.array(slot[order][begins])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*lists.schema.fields[:5], *T.StructType.fromDDL("df long, slot long").fields])
    return lists.mapInArrow(run, schema)


def _made(batches: Iterator[pa.RecordBatch], names: list[str], block: int, bands: int, held: int) -> Iterator[pa.RecordBatch]:
    """Blocks of lists that come in order of scope, term and slot; whole terms (or slots) are made at once."""
    waiting: list[pa.RecordBatch] = []
    size, enough = 0, held
    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        size += len(b.column("docs").flatten())
        if size < enough:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        last = int(_changes(*_keys(table))[-1])
        if last:
            yield from _blocks_of(table.slice(0, last), names, block, bands)
        waiting = table.slice(last).to_batches()
        size = sum(len(x.column("docs").flatten()) for x in waiting)
        enough = max(held, 2 * size)
    if waiting:
        yield from _blocks_of(pa.Table.from_batches(waiting).combine_chunks(), names, block, bands)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _keys(table: pa.Table) -> list[np.ndarray]:
    return [_codes(_column(table, "scope")), _codes(_column(table, "term")), _column(table, "slot").to_numpy(zero_copy_only=False)]


def _blocks_of(table: pa.Table, names: list[str], block: int, bands: int) -> Iterator[pa.RecordBatch]:
    begins = _changes(*_keys(table))
    size = pc.list_value_length(_column(table, "docs")).to_numpy(zero_copy_only=False)
    group = np.repeat(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows))), size)
    heads = table.take(pa.array(begins))
    n_docs, avgdl, mean = (_column(heads, c).to_numpy(zero_copy_only=False) for c in ("n_docs", "avgdl", "mean"))
    df = pc.coalesce(_column(heads, "df"), pa.array(np.bincount(group, minlength=len(begins)))).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.log(n_docs - df + 0.5) - np.log(df + 0.5)
    idf = np.where(raw < 0, bm25.EPSILON * mean, raw)
    docs, f, dl = (_column(table, c).flatten() for c in ("docs", "counts", "lengths"))
    f, dl = f.to_numpy(zero_copy_only=False).astype(np.float64), dl.to_numpy(zero_copy_only=False).astype(np.float64)
    impact = f * (bm25.K1 + 1) / (f + bm25.K1 * ((1 - bm25.B) + bm25.B * dl / avgdl[group]))
    often = (df > block)[group]
    part = np.zeros(len(group), np.int64)
    part[often] = _digests(docs.filter(pa.array(often))) % -(-df // block)[group[often]]
    band = np.where(often, np.floor(impact * bands), 0).astype(np.int32)
    order = np.lexsort((impact, _places(docs), part, band, group))
    impact, part, band, group = impact[order], part[order], band[order], group[order]
    at = _changes(group, band, part)
    n, of = np.diff(np.append(at, len(order))), group[at]
    scope, term, bucket = (_column(heads, c).take(pa.array(of)) for c in ("scope", "term", "bucket"))
    columns = [scope, bucket, term, pa.array(band[at]), pa.array(part[at]), pa.array(df[of]), pa.array(idf[of]), pa.array(n), pa.array(np.minimum.reduceat(impact, at)), pa.array(np.maximum.reduceat(impact, at))]
    yield from _cut(pa.RecordBatch.from_arrays([*columns, _list(docs.take(pa.array(order)), n), _list(pa.array(impact), n)], names=names), n, _SENT)


def store(blocks: DataFrame, path: str) -> None:
    """Write blocks by tenant and bucket; tenants that are there already are replaced folder by folder, others stay.

    Blocks stay in the tasks in which ``build`` made them, those of one file together; others give more files.
    """
    ordered = blocks.sortWithinPartitions("scope", "bucket", "term", F.desc("high"))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "bucket").parquet(path)


def stored(spark: SparkSession, path: str, scope_type: str = "string", doc_type: str = "bigint") -> DataFrame:
    """The blocks under ``path``."""
    schema = f"term string, band int, part long, df long, idf double, n long, low double, high double, docs array<{doc_type}>, impacts array<double>, scope {scope_type}, bucket int"
    return spark.read.schema(schema).parquet(path)


def asked_terms(questions: DataFrame) -> DataFrame:
    """(item_id, term, times) of questions (item_id, text)."""
    return questions.select("item_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def question_terms(blocks: DataFrame, questions: DataFrame, top_k: int, buckets: int = BUCKETS) -> DataFrame:
    """(item_id, scope, term, weight, df, parts, essential) of the asked terms that a tenant has; no posting is read.

    A question's terms are essential but for those, the weakest, that together cannot reach the score that ``top_k`` documents have by one of
    its terms alone. Where a weight is negative, or no term holds as many documents, all are.
    """
    asked = materialize(asked_terms(questions), "asked")
    folders = [r["b"] for r in asked.select(number(F.col("term"), buckets).cast("int").alias("b")).distinct().collect()]  # as many as buckets at most
    heads = blocks.filter(F.col("bucket").isin(folders)).select("scope", "term", "band", "df", "idf", "n", "low", "high").join(asked.select("term").distinct(), "term", "left_semi")
    bands = heads.groupBy("scope", "term", "df", "idf", "band").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    downward = Window.partitionBy("scope", "term").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
    # the lowest impact of the highest bands that hold k documents together
    reach = F.when(F.sum("n").over(downward) >= top_k, F.col("low"))
    of_term = bands.withColumn("reach", reach).groupBy("scope", "term", "df", "idf").agg(F.max("reach").alias("reach"), F.max("high").alias("high"))
    found = of_term.join(asked, "term").withColumn("weight", F.col("idf") * F.col("times")).withColumn("most", F.col("weight") * F.col("high"))
    whole = Window.partitionBy("item_id", "scope")
    weakest = whole.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.when(F.min("weight").over(whole) >= 0, F.max(F.col("weight") * F.col("reach")).over(whole))
    judged = found.withColumn("essential", F.coalesce(F.sum("most").over(weakest) >= bound - _SLACK, F.lit(True)))
    return judged.select("item_id", "scope", "term", "weight", "df", parts(F.col("df")).alias("parts"), "essential")


def _opened(blocks: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The blocks of ``wanted`` (scope, term, and part where it is named), from no other folders."""
    on = [c for c in ("scope", "term", "part") if c in wanted.columns]
    folders = [r["b"] for r in wanted.select(number(F.col("term"), buckets).cast("int").alias("b")).distinct().collect()]
    keys = wanted.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct()
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return blocks.filter(F.col("bucket").isin(folders)).join(keys, same, "left_semi")


def _contributions(opened: DataFrame, asked: DataFrame, per_document: bool) -> DataFrame:
    """(item_id, scope, doc_id, part_score) of the postings of blocks for the questions that ask (of each document, if so)."""
    each = opened.select("scope", "term", F.explode(F.arrays_zip("docs", "impacts")).alias("x")).select("scope", "term", F.col("x.docs").alias("doc_id"), F.col("x.impacts").alias("impact"))
    names = ("scope", "term", "doc_id") if per_document else ("scope", "term")
    side = asked.select("item_id", "weight", *(F.col(c).alias(f"__{c}") for c in names))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return each.join(side, same).select("item_id", "scope", "doc_id", (F.col("weight") * F.col("impact")).alias("part_score"))


def opened_blocks(blocks: DataFrame, questions: DataFrame, top_k: int, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a search reads: the essential terms and their blocks; and the other terms, and those of their blocks that can hold a document found there."""
    terms = materialize(question_terms(blocks, questions, top_k, buckets), "question-terms")
    first, rest = terms.filter("essential"), terms.filter("not essential")
    first_blocks = _opened(blocks, first, buckets)
    # where a question finds many documents they are in every part of its other terms; few are looked up
    found = first.groupBy(F.col("item_id").alias("__i"), F.col("scope").alias("__s")).agg(F.sum("df").alias("found"))
    of_question = (F.col("item_id") == F.col("__i")) & F.col("scope").eqNullSafe(F.col("__s"))
    others = rest.join(found, of_question).select("item_id", "scope", "term", "df", "parts", (F.col("found") < _SPARSE * F.col("parts")).alias("few"))
    whole = others.filter("not few").select("scope", "term").union(first.select("scope", "term")).distinct()
    whole = materialize(whole, "whole-terms")
    few = materialize(others.filter("few").join(whole, _same(others, whole, "scope", "term"), "left_anti"), "few")
    looking = few.select(F.col("item_id").alias("__i"), F.col("scope").alias("__s")).distinct()
    asking = first.join(looking, of_question, "left_semi")
    candidates = _contributions(_opened(blocks, asking, buckets), asking, False).select("item_id", "scope", "doc_id").distinct()
    sought = few.select(F.col("item_id").alias("__i"), F.col("scope").alias("__s"), "term", "parts")
    parts_ = candidates.join(sought, of_question).select("scope", "term", part_of(F.col("doc_id"), F.col("parts")).alias("part")).distinct()
    parts_ = materialize(parts_, "sought")
    only = whole.join(first.select("scope", "term").distinct(), _same(whole, first, "scope", "term"), "left_anti")
    return first, first_blocks, rest, _opened(blocks, materialize(only, "others"), buckets).union(_opened(blocks, parts_, buckets))


def _sharded(opened: DataFrame) -> DataFrame:
    """(tenant, shard, numbers, docs, impacts): the postings of blocks, in lists by shard of documents."""
    held, names = _HELD // 2, ["tenant", "shard", "numbers", "docs", "impacts"]

    def shards_of(docs: pa.Array) -> np.ndarray:
        if pa.types.is_integer(docs.type):
            x = docs.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        else:
            known = pc.dictionary_encode(docs, null_encoding="encode")
            values = np.array([int.from_bytes(hashlib.blake2b(repr(v).encode(), digest_size=8).digest(), "little") for v in known.dictionary.to_pylist()], np.uint64)
            x = values[known.indices.to_numpy(zero_copy_only=False)]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(33))) >> np.uint64(1)

    def lists(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        size = pc.list_value_length(_column(table, "docs")).to_numpy(zero_copy_only=False)
        tenant, shards, numbers = (np.repeat(_column(table, c).to_numpy(zero_copy_only=False).astype(np.int64), size) for c in ("tenant", "shards", "number"))
        docs, impacts = _column(table, "docs").flatten(), _column(table, "impacts").flatten()
        shard = (shards_of(docs) % shards.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((numbers, shard, tenant))
        begins = _changes(tenant[order], shard[order])
        n, at = np.diff(np.append(begins, len(order))), pa.array(order)
        columns = [pa.array(tenant[order][begins]), pa.array(shard[order][begins]), _list(pa.array(numbers[order]), n), _list(docs.take(at), n), _list(impacts.take(at), n)]
        yield from _cut(pa.RecordBatch.from_arrays(columns, names=names), n, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                size += len(b.column("docs").flatten())
            if size >= held:
                yield from lists(waiting)
                waiting, size = [], 0
        if size:
            yield from lists(waiting)

    schema = T.StructType([*T.StructType.fromDDL("tenant long, shard long, numbers array<long>").fields, opened.schema["docs"], opened.schema["impacts"]])
    return opened.select("tenant", "shards", "number", "docs", "impacts").mapInArrow(run, schema)


def _best_of_shard(postings: pa.Table, asks: pa.Table, top_k: int, digits: int, names: list[str]) -> pa.Table:
    """The ``top_k`` best documents of a shard for each question that asks in it."""
    items = pc.dictionary_encode(_column(asks, "item_id"))
    number, item, weight = _column(asks, "number").to_numpy(), items.indices.to_numpy(), _column(asks, "weight").to_numpy()
    order = np.argsort(number, kind="stable")
    number, item, weight = number[order], item[order], weight[order]
    docs = _column(postings, "docs").flatten()
    known = pc.dictionary_encode(docs)
    code, term = known.indices.to_numpy(), _column(postings, "numbers").flatten().to_numpy()
    order = np.argsort(code, kind="stable")
    code, impact = code[order], _column(postings, "impacts").flatten().to_numpy()[order]
    low, high = (np.searchsorted(number, term[order], side) for side in ("left", "right"))
    pairs = np.concatenate([[0], np.cumsum(high - low)])
    starts = np.append(_changes(code), len(code))  # of documents
    at, places, n_items = 0, _places(known.dictionary), len(items.dictionary)
    most = max(_PAIRS // n_items, 1)
    held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]

    def best() -> list[np.ndarray]:
        keep = bm25._best(np.zeros(len(held[0]), np.int64), held[0], held[1], places[held[2]], top_k)
        return [x[keep] for x in held]

    while at < len(starts) - 1:  # whole documents, so that a score is summed at once
        to = int(np.searchsorted(pairs[starts], pairs[starts[at]] + _PAIRS, "right")) - 1
        to = min(max(to, at + 1), at + most, len(starts) - 1)
        begin, end = starts[at], starts[to]
        n = high[begin:end] - low[begin:end]
        asker = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(code[begin:end] - code[begin], n) * np.int64(n_items) + item[asker]
        total = np.round(np.bincount(key, np.repeat(impact[begin:end], n) * weight[asker], minlength=(to - at) * n_items), digits).reshape(-1, n_items)
        good = total > 0
        if len(total) > top_k:
            good &= total >= np.partition(total, len(total) - top_k, axis=0)[len(total) - top_k]
        row, column = np.nonzero(good)
        held = [np.concatenate([x, y]) for x, y in zip(held, (column, total[row, column], row + code[begin]), strict=True)]
        if len(held[0]) > _PAIRS // 4 + n_items * top_k:
            held = best()
        at = to
    column, score, doc = best()
    return pa.Table.from_arrays([items.dictionary.take(pa.array(column)), known.dictionary.take(pa.array(doc)), pa.array(score)], names=names)


def search(blocks: DataFrame, questions: DataFrame, top_k: int = 20, tenant: str | None = None, digits: int = 6, buckets: int = BUCKETS) -> DataFrame:
    """(item_id, [tenant], doc_id, score, rank), the rows of ``bm25.search``, from blocks that ``build`` made or ``stored`` reads.

    Questions with a null or empty text find nothing. Ties go to the smaller doc_id.
    """
    first, first_blocks, rest, more_blocks = opened_blocks(blocks, questions, top_k, buckets)
    asked = first.union(rest)
    # postings of a tenant's asked terms tell over how many shards its documents are dealt
    terms = asked.groupBy("scope", "term").agg(F.max("parts").alias("parts"))
    tenants = terms.groupBy("scope").agg((F.floor(F.sum("parts") * BLOCK / SHARD) + 1).alias("shards"))
    tenants = materialize(tenants.withColumn("tenant", F.monotonically_increasing_id()), "tenants")
    numbers = terms.join(tenants, _same(terms, tenants, "scope")).select(terms["scope"], "term", "tenant", "shards")
    numbers = materialize(numbers.withColumn("number", F.monotonically_increasing_id()), "numbers")
    named = numbers.select(F.col("scope").alias("__s"), F.col("term").alias("__t"), "tenant", "shards", "number")
    of_term = F.col("scope").eqNullSafe(F.col("__s")) & (F.col("term") == F.col("__t"))
    postings = _sharded(first_blocks.unionByName(more_blocks).join(named, of_term))
    weights = asked.join(named, of_term).select("tenant", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "number", "item_id", "weight")
    schema = T.StructType([asked.schema["item_id"], T.StructField("doc_id", blocks.schema["docs"].dataType.elementType), T.StructField("score", T.DoubleType()), T.StructField("tenant", T.LongType())])
    empty = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        found = _best_of_shard(left, right, top_k, digits, schema.names[:3])
        return found.append_column("tenant", pa.array([key[0].as_py()] * found.num_rows, pa.int64())).cast(empty)

    best = postings.groupBy("tenant", "shard").cogroup(weights.groupBy("tenant", "shard")).applyInArrow(scored, schema)
    order = Window.partitionBy("item_id", "tenant").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top_k)
    best = best.join(tenants.select("tenant", "scope").withColumnRenamed("tenant", "__n"), F.col("tenant") == F.col("__n")).drop("tenant", "__n")
    return best.select("item_id", *([F.col("scope").alias(tenant)] if tenant else []), "doc_id", "score", "rank")
