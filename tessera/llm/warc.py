"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact bytes of every record's headers are kept
apart, with that digest. Joining the two on the digest gives the original records back; payloads are hashed again when
they are read, and a mismatch raises an error. All of it is DataFrame work: digests are taken where
pages are scanned, only narrow rows are grouped, and a payload moves once.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import batch_of
from tessera.runtime import materialize, released_shuffles, scratch_path

#: Payloads of at least so many bytes are stored as revisits when they come again.
LEAST_REVISIT_BYTES = 0
#: The date of the records, which pages do not carry.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the profile of revisit records.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """A 40-digit hexadecimal digest in bare upper-case base 32."""

    def letter(i: Column) -> Column:
        five = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        value = F.call_function("shiftright", five, (15 - 5 * (i % 4)).cast("int")).bitwiseAND(F.lit(31))
        return F.substring(F.lit(BASE32), value + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def record_headers(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, address (SHA-256), payload_bytes, record_type, and header: the exact bytes before the payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", "url", F.sha2(payload, 256).alias("address"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = narrow.groupBy("address").agg(F.min("page_id").alias("first_page"))
    first = materialize(first, "first")  # read back, both sides of the join are plain exchanges, and a hot payload's can be split
    rows = narrow.join(first, "address")
    is_first = F.col("page_id").eqNullSafe(F.col("first_page")) | (F.col("payload_bytes") < least_bytes)
    kind = F.when(is_first, "response").otherwise("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(is_first, F.col("payload_bytes")).otherwise(0) + F.lit(len(HTTP_HEAD))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(is_first, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _urn(F.col("first_page"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    )
    return rows.select("page_id", "address", "payload_bytes", kind.alias("record_type"), "first_page", header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Write ``path``/headers (a row per page) and ``path``/payloads (a row per distinct payload).

    Null html is an empty payload; a null url leaves its header line out. Rows that repeat a page are records of their
    own. A null page_id counts as larger than any. Columns other than page_id, url, html are not stored.
    """
    spark = pages.sparkSession
    with released_shuffles(spark):
        record_headers(pages, least_bytes).drop("payload_bytes").write.parquet(f"{path}/headers")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("owner")
    owners = spark.read.parquet(f"{path}/headers").filter(F.col("page_id").eqNullSafe(F.col("first_page"))).select(key, "address").distinct()
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(key, F.sha2(payload, 256).alias("address"), payload.alias("payload"))
    once = Window.partitionBy("owner", "address").orderBy(F.lit(1))  # a repeated page's payload, once; hashed as the join is
    stored = rows.join(owners, ["owner", "address"]).withColumn("copy", F.row_number().over(once)).filter("copy = 1")
    with released_shuffles(spark):
        stored.select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, payload of every stored payload; raises where bytes and address disagree."""
    stored = spark.read.parquet(f"{path}/payloads")
    whole = F.sha2("payload", 256) == F.col("address")
    return stored.select("address", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary")).alias("payload"))


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload, record: every page's record as it was written, payload and all for revisits too."""
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(payloads(spark, path), "address")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def header_field(header: Column, name: str) -> Column:
    """The value of a header line; null where it is missing."""
    found = F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write the archive, rebuild every record from it, and tell what the record's own bytes say.

    page_id, record_type, refers_to come from the record's header, the payload's size and digest from its bytes, of a revisit those of
    the payload that it refers to. ``digest_agrees``: the declared digest and length are those of the bytes. A row for every row of
    ``pages``, repeated ones and such without page_id too; null html counts as empty, an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(pages.select("page_id", "url", "html"), path)
    kind = pages.schema["page_id"].dataType
    page = lambda name: F.nullif(F.regexp_extract(header_field(F.col("head"), name), r"<urn:page:(.*)>", 1), F.lit("null")).cast(kind)
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    records = original_records(spark, path).select("record", "payload", head.alias("head"))
    records = records.withColumn("block_at", F.octet_length("head") + 5).withColumn("length", F.octet_length("record") - F.col("block_at") - 3)
    type_ = header_field(F.col("head"), "WARC-Type")
    own = F.expr(f"substring(record, block_at + {len(HTTP_HEAD)}, length - {len(HTTP_HEAD)})")
    records = records.select("head", "length", type_.alias("record_type"), F.when(type_ == "response", own).otherwise(F.col("payload")).alias("body"))
    digest = base32_of_hex(F.sha1("body"))
    agrees = (header_field(F.col("head"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (header_field(F.col("head"), "Content-Length") == F.col("length").cast("string"))
    told = records.select("head", "length", "record_type", F.octet_length("body").cast("long").alias("payload_bytes"), digest.alias("payload_digest"))
    return told.select(page("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("WARC-Refers-To").alias("refers_to"), agrees.alias("digest_agrees"))


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Write records (page_id, record) as .warc.gz files below ``path``, one for each partition; (file, n_records, n_bytes) of each.

    ``path`` is a folder that all executors reach, as a path or a uri. A file is written under the name of its attempt and then
    renamed, so that of several attempts at a partition one counts. A partition without records has no file. Without a scheme the path
    is one of each executor's own disk, and is refused outside local mode.
    """
    master = records.sparkSession.sparkContext.master
    if "://" not in path and not path.startswith("file:") and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"{path}: name a folder that all executors share, with its scheme")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, size = TaskContext.get(), 0, 0
        system, folder = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path))
        name = f"part-{context.partitionId():05d}.warc.gz"
        aside = f"{folder}/_{name}-{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(aside, compression=None) as out:
            for b in batches:
                for record in b.column("record").to_pylist():
                    size += out.write(gzip.compress(record, mtime=0))
                    n += 1
        if n:
            system.move(aside, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [size]})
        else:
            system.delete_file(aside)

    return materialize(records.select("record").mapInArrow(run, "file string, n_records long, n_bytes long"), "files")


def compressed(records: DataFrame) -> DataFrame:
    """page_id, member: each record as a gzip member; members one after another make a .warc.gz file."""
    kind = records.schema["page_id"].dataType.simpleString()
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = batch_of(schema, member=[gzip.compress(r, mtime=0) for r in b.column("record").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *members.columns], names=["page_id", "member"])

    return records.select("page_id", "record").mapInArrow(run, f"page_id {kind}, member binary")


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def _inflated(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of a file, and what is wrong with its compression; what stands before a damaged place is kept."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out = bytearray()
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        try:
            while piece := members.read1(1 << 16):
                out += piece
        except (EOFError, OSError, zlib.error) as error:
            return bytes(out), f"damaged compression: {error}"
    return bytes(out), None


def checked_records(content: bytes) -> Iterator[tuple[bytes | None, bytes, str | None]]:
    """(header, block, None) of each record; where a file is damaged, at last (None, the bytes that make no record, what is wrong)."""
    content, error = _inflated(content)
    at = 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        header = content[at : end + 4]
        found = _LENGTH.search(header)
        if not found or end + 4 + int(found[1]) > len(content):
            error = error or ("a record is cut short" if found else "a record has no length")
            break
        stop = end + 4 + int(found[1])
        yield header, content[end + 4 : stop], None
        at = stop + 4 if content[stop : stop + 4] == b"\r\n\r\n" else stop
    if error or at < len(content):
        yield None, content[at:], error or "a header is cut short"


def split_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each whole record in the bytes of a WARC file, compressed or not."""
    return ((header, block) for header, block, error in checked_records(content) if error is None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, at, header, block, error of every record of the WARC files under ``path``.

    A file that is damaged gives its whole records and then a row without header, whose error tells what is wrong and whose block holds the
    bytes from there on. An empty file gives no rows. A file is held whole by a task, so none may pass 2 GB.
    """
    schema = pa.schema([("path", pa.string()), ("at", pa.int32()), ("header", pa.binary()), ("block", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for i, (header, block, error) in enumerate(checked_records(content)):
                    yield batch_of(schema, path=[name], at=[i], header=[header], block=[block], error=[error])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, at int, header binary, block binary, error string")
