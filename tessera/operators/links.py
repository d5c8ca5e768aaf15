"""Links of crawled pages, file names for them, and the crawl's frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import discard, materialize, numbered, scratch_path

#: What holds no elements: comments, scripts, styles; and an anchor's start tag with its attributes, whose values may hold ">".
NO_MARKUP = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"
ANCHOR = r"""(?is)<a(\s(?:[^>"']|"[^"]*"|'[^']*')*)>"""
#: An attribute with its value, and the first href after any others: in double quotes, in single ones, or bare.
_ATTRIBUTE = r"""(?:\s+[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)"""
HREF = rf"""(?is)^{_ATTRIBUTE}*?\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
#: Named references that are decoded, the ampersand's last.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def decoded(text: Column) -> Column:
    """Character references decoded: decimal and hexadecimal ones, and those of REFERENCES."""
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    for pattern, base in ((r"&#([0-9]{1,7});", 10), (r"&#[xX]([0-9a-fA-F]{1,6});", 16)):
        whole = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        number = lambda m, p=pattern, b=base: F.conv(F.regexp_extract(m, p, 1), b, 10).cast("long")
        real = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        text = F.aggregate(whole, text, lambda acc, m: F.when(real(number(m)), F.replace(acc, m, point(number(m)))).otherwise(acc))  # noqa: B023
    for name, value in REFERENCES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    return text


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, closed).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """The absolute link without its fragment and trailing slashes; null where the base is no hierarchical url or the host is malformed."""
    href = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    bare = F.regexp_replace(href, r"(?s)#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)[^/]*$", 1)
    own = F.regexp_extract(bare, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)^[^?]*(\?.*)$", 1)
    joined = F.concat(root, without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))), query)
    link = (
        F.when(bare == "", F.regexp_replace(base, r"(?s)#.*$", ""))
        .when(bare.rlike(_SCHEME), bare)
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare.startswith("?"), F.concat(root, path_of(base), bare))
        .otherwise(joined)
    )
    return F.when((scheme != "") & ~host_of(link).rlike(r"^[^\]]*\[[^\]]*$"), F.regexp_replace(link, "/+$", ""))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def extract_links(pages: DataFrame, prefix: str = "", whole_segments: bool = False) -> DataFrame:
    """(page_id, url, at, link): links of each page on its own host whose path begins with ``prefix``, repeats kept; ``at`` counts the page's links.

    Anchors are read as an HTML parser reads them: attributes in any order and quoting, references decoded, nothing out of comments
    and scripts. Pages without html or with a url that is none have no links.
    With ``whole_segments`` the prefix ``/docs`` does not admit ``/docs-old``.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", NO_MARKUP, ""), F.lit(ANCHOR), F.lit(1))
    href = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)))
    hrefs = F.transform(F.filter(tags, lambda t: t.rlike(HREF)), href)
    found = pages.select("page_id", "url", F.posexplode(hrefs).alias("at", "href"))
    links = found.withColumn("link", resolve(F.col("url"), decoded(F.col("href")))).filter(host_of(F.col("link")) == host_of(F.col("url")))
    if prefix:
        path = path_of(F.col("link"))
        fits = path.startswith(prefix)
        if whole_segments and not prefix.endswith("/"):
            fits = (path == prefix) | path.startswith(prefix + "/")
        links = links.filter(fits)
    return links.select("page_id", "url", "at", "link")


def file_name(url: Column) -> Column:
    """The url's path as a flat name ending in .pdf; ``index`` for the root. Queries are not part of it."""
    path = F.regexp_replace(path_of(url), r"^/+|/+$", "")
    named = F.when(path == "", "index").otherwise(path)
    return F.concat(F.replace(F.regexp_replace(named, r"[^a-zA-Z0-9\-_/]", "_"), F.lit("/"), F.lit("__")), F.lit(".pdf"))


def name_collisions(pages: DataFrame) -> DataFrame:
    """(filename, n_pages) of names that more than one url would be written to."""
    named = pages.select("url", file_name(F.col("url")).alias("filename")).distinct()
    return named.groupBy("filename").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


def crawl_levels(starts: DataFrame, links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(url, depth): breadth-first levels over (url, link) from ``starts`` (url); each url at its least depth, however deep.

    Each level is what the last one links to and no earlier one holds; levels are appended to one table as they are made. With ``max_pages``
    the crawl ends after the level that reaches so many, and the first ones by (depth, url) are given.
    """
    spark = starts.sparkSession
    edges = materialize(links.select("url", "link").distinct(), "edges")
    path, depth = scratch_path(spark, "levels"), 0
    front = starts.select("url").filter(F.col("url").isNotNull()).distinct()
    front.select("url", F.lit(0).alias("depth")).write.parquet(path)
    while True:
        seen = spark.read.schema("url string, depth int").parquet(path)
        last = seen.filter(F.col("depth") == depth)
        if last.isEmpty() or (max_pages is not None and seen.count() >= max_pages):
            break
        depth += 1
        reached = last.join(edges, "url").select(F.col("link").alias("url")).filter(F.col("url").isNotNull()).distinct().join(seen.select("url"), "url", "left_anti")
        # written aside first: the table is read while the level is made
        level = materialize(reached.select("url", F.lit(depth).alias("depth")), "level")
        level.write.mode("append").parquet(path)
        discard(level)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def crawl_order(starts: DataFrame, links: DataFrame, fetched: DataFrame, max_pages: int | None = None, batch: int = 1) -> DataFrame:
    """(url, position, depth, found_by, saved): pages in the order in which a first-in-first-out crawl takes them.

    ``starts`` (url) are taken by url; then pages as they are found, by the place of the page that names them first (``found_by``) and the
    link's place in it: ``links`` (url, at, link). Pages not in ``fetched`` (url) fail: they are taken, name nothing and are not ``saved``.
    Pages are taken in batches, shorter where fewer are known. With ``max_pages`` the batch that saves so many is the last, and is whole,
    so more may be saved. Null urls and links are left out; repeated rows count once.
    """
    spark = starts.sparkSession
    known = fetched.select("url").filter(F.col("url").isNotNull()).distinct()
    edges = materialize(links.select("url", "at", "link").filter("url IS NOT NULL AND link IS NOT NULL").join(known, "url", "left_semi").groupBy("url", "link").agg(F.min("at").alias("at")), "edges")
    path = scratch_path(spark, "order")

    def add(pages: DataFrame, order: list[str], depth: int, first: int) -> int:
        """Number one level and append it; how many pages there are then."""
        level = materialize(numbered(pages, order, "position", first), "level")
        level.select("url", "position", F.lit(depth).alias("depth"), "found_by").write.mode("append").parquet(path)
        discard(level)
        return spark.read.schema(schema).parquet(path).count()

    schema = "url string, position long, depth int, found_by long"
    total, depth, enough = add(starts.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("found_by", F.lit(None).cast("long")), ["url"], 0, 0), 0, False
    grown = total > 0
    while grown and not enough:
        seen = spark.read.schema(schema).parquet(path)
        # a batch may reach into the level after the one that saves enough, so that one is made as well
        enough = max_pages is not None and seen.join(known, "url", "left_semi").count() >= max_pages
        last = seen.filter(F.col("depth") == depth)
        named = last.join(edges, "url").groupBy(F.col("link").alias("url")).agg(F.min(F.struct("position", "at")).alias("by"))
        reached = named.join(seen.select("url"), "url", "left_anti").select("url", F.col("by.position").alias("found_by"), F.col("by.at").alias("at"))
        depth += 1
        now = add(reached, ["found_by", "at", "url"], depth, total)
        grown, total = now > total, now
    pages = spark.read.schema(schema).parquet(path).join(known.withColumn("saved", F.lit(True)), "url", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    if not enough:
        return pages
    place = numbered(pages.filter("saved").select("position"), ["position"], "n", 1).filter(F.col("n") == max(max_pages, 1)).head()["position"] if max_pages > 0 else -1
    return pages.filter(F.col("position") < _end_of_batch(pages, place, batch, total))


def _end_of_batch(pages: DataFrame, place: int, batch: int, total: int) -> int:
    """Where the batch that takes the page at ``place`` ends; a job for each batch that is shorter than ``batch``."""
    at = 0
    while at <= place:
        # batches from here on are full up to the first whose last page is found too late to be in it
        ends = pages.filter((F.col("position") >= at + batch - 1) & ((F.col("position") - at - batch + 1) % batch == 0) & (F.col("found_by") > F.col("position") - batch))
        late = ends.agg(F.min("position").alias("p")).head()["p"]
        short = late - batch + 1 if late is not None else at + (total - at) // batch * batch
        if place < short:
            return at + ((place - at) // batch + 1) * batch
        at = pages.filter(F.col("found_by").isNull() | (F.col("found_by") < short)).count()
    return at
