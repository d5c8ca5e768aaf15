"""URL filters as a sort-merge range join.

A host's labels in reverse order, each closed by a dot (``www.example.com`` -> ``com.example.www.``), make a host
and all its subdomains one interval of keys: those that begin with the rule's own key. Keys of urls and rules
are cut into ranges at sampled bounds, so each rule goes to the ranges its interval meets; every task sorts its
rows by key and sweeps them once, keeping the stack of rules whose intervals are open. Open intervals are
nested, so the stack is ordered by length of host. Path prefixes are intervals too: a host's are sorted, each
with the one that encloses it, so the last one not above a path, or one that encloses that, is its longest prefix.

A key that fills whole ranges by itself shows up as equal bounds; its urls are dealt over all these ranges by a
hash of the row, and its rules go to each of them.
"""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import batch_of
from tessera.runtime import shuffle_partitions

#: About so many keys are looked at to place the bounds of the ranges; they steer the balance, never the result.
BOUND_SAMPLE = 4096

_AFTER_SCHEME = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a url without ``://``."""
    found = _AFTER_SCHEME.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def host_key(host: str) -> str:
    """Reversed labels, each closed by a dot; the empty host has the empty key, which no rule's key begins."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


def _key_bytes(host: str) -> bytes:
    return host_key(host).encode("utf-8", "surrogatepass")


def _end(key: bytes) -> bytes:
    return key + b"\xff"  # no UTF-8 text holds this byte


class PathRules:
    """A host's rules by path prefix; of equal ones that differ in verdict, block wins."""

    def __init__(self) -> None:
        self.by_path: dict[str, Rule] = {}
        self.starts: list[str] | None = None
        self.outer: list[int] = []

    def add(self, rule: Rule) -> None:
        if self.by_path.setdefault(rule.path, rule).verdict != "block":
            self.by_path[rule.path] = rule
        self.starts = None

    def longest(self, path: str) -> Rule | None:
        """The rule with the longest prefix of ``path``."""
        if self.starts is None:
            self.starts, self.outer, stack = sorted(self.by_path), [], []
            for i, start in enumerate(self.starts):
                while stack and not start.startswith(self.starts[stack[-1]]):
                    stack.pop()
                self.outer.append(stack[-1] if stack else -1)
                stack.append(i)
        at = bisect.bisect_right(self.starts, path) - 1
        while at >= 0 and not path.startswith(self.starts[at]):
            at = self.outer[at]
        return self.by_path[self.starts[at]] if at >= 0 else None


class Sweep:
    """A pass over keys in sorted order. The stack holds the open intervals, outer ones first; each one's key begins the next one's."""

    def __init__(self) -> None:
        self.stack: list[tuple[bytes, PathRules]] = []

    def _close(self, key: bytes) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: bytes, rule: Rule) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, PathRules()))
        self.stack[-1][1].add(rule)

    def judge(self, key: bytes, path: str) -> Rule | None:
        self._close(key)
        return next((found for _, rules in reversed(self.stack) if (found := rules.longest(path))), None)


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and key, as ``canonical`` and ``host_key`` give them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    key = F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), key.cast("binary")


def key_bounds(df: DataFrame, url: str, ranges: int) -> list[bytes]:
    """Cuts between ranges, from the keys of a random sample of BOUND_SAMPLE rows or so; a key that fills ranges by itself occurs repeatedly."""
    rows = df.count()
    sample = df.select(parts_of(F.col(url))[2]).sample(min(1.0, BOUND_SAMPLE / rows), seed=1).collect() if rows else []
    keys = sorted(bytes(r[0]) for r in sample)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def judge_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Add host, path, rule, verdict to every row of ``df``; input columns of these names are replaced.

    ``rules`` has host, path and verdict; as a DataFrame it may be of any size. The rule with the longest host wins,
    among these the one with the longest path; of equal rules that differ in verdict, block wins. Urls that no
    rule fits, null and empty urls among them, get ``default`` and a null rule. Repeated rows are judged each by
    itself; an empty table gives none; working columns begin with two underscores.
    """
    spark = df.sparkSession
    df = df.drop("host", "path", "rule", "verdict")
    ranges = ranges or shuffle_partitions(spark)
    bounds = key_bounds(df, url, ranges)
    host, path, key = parts_of(F.col(url))
    keyed = df.select("*", host.alias("host"), path.alias("path"), key.alias("__key"), F.pmod(F.xxhash64(*df.columns), F.lit(2**62)).alias("__salt"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, salt in zip(b.column("__key").to_pylist(), b.column("__salt").to_pylist(), strict=True):
                low, high = bisect.bisect_left(bounds, key), bisect.bisect_right(bounds, key)
                out.append(low + salt % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "__range"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, path, verdict in zip(*(b.column(x).to_pylist() for x in ("host", "path", "verdict")), strict=True):
                key = _key_bytes(host)
                rows += [(r, key, host, path, verdict) for r in range(bisect.bisect_left(bounds, key), bisect.bisect_left(bounds, _end(key)) + 1)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield batch_of(_RULE_ROWS, **dict(zip(_RULE_ROWS.names, map(list, columns), strict=True)))

    placed = keyed.mapInArrow(place_urls, T.StructType([*keyed.schema.fields, T.StructField("__range", T.IntegerType())]))
    placed_rules = rules.select("host", "path", "verdict").mapInArrow(place_rules, "__range int, __key binary, __rule_host string, __rule_path string, __rule_verdict string")
    both = placed.withColumn("__is_url", F.lit(True)).unionByName(placed_rules.withColumn("__is_url", F.lit(False)), allowMissingColumns=True)
    names = [*df.columns, "host", "path"]
    result = T.StructType([*(placed.schema[c] for c in names), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pass_ = None, Sweep()
        for b in batches:
            chosen: list[Rule | None] = []
            work = ("__range", "__key", "__is_url", "path", "__rule_host", "__rule_path", "__rule_verdict")
            for spot, key, is_url, path, *rule in zip(*(b.column(x).to_pylist() for x in work), strict=True):
                if spot != now:
                    now, pass_ = spot, Sweep()
                if is_url:
                    chosen.append(pass_.judge(key, path))
                else:
                    pass_.open(key, Rule(*rule))
            kept = b.filter(b.column("__is_url"))
            said = [pa.array([r and str(r) for r in chosen], pa.string()), pa.array([r.verdict if r else default for r in chosen], pa.string())]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), *said], names=result.names)

    return both.repartitionById(len(bounds) + 1, "__range").sortWithinPartitions("__range", "__key", "__is_url").mapInArrow(merge, result)


_RULE_ROWS = pa.schema([("__range", pa.int32()), ("__key", pa.binary()), ("__rule_host", pa.string()), ("__rule_path", pa.string()), ("__rule_verdict", pa.string())])

#: The rules that the registered query applies.
PAGE_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` under PAGE_RULES; see judge_urls."""
    return judge_urls(pages.select("page_id", "url"), PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")
