"""Both jobs as registered queries: each runs twice into one new folder and returns the output as it then stands; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_index, ingest_documents
from tessera.plans import catalogue
from tessera.runtime import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of the tenants' indexes, built twice into one folder."""
    config = build_index.KNOWN | {"documents": f"{sf_dir}/documents.parquet", "index": _folder(spark, "index")}
    for _ in range(2):
        build_index.run(spark, config)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    blocks = build_index.read(spark, config["index"])
    return blocks.select(F.col("scope").alias("source"), "bucket", "term", "band", "part", "df", F.round("idf", 6).alias("idf"), "n", "low", "high", listed("docs").alias("docs"))


def job2_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks after two runs of the stream over the documents; the second finds nothing new."""
    folder = _folder(spark, "chunks")
    config = ingest_documents.KNOWN | {"documents": f"{sf_dir}/documents*.parquet", "chunks": f"{folder}/chunks", "checkpoint": f"{folder}/checkpoint"}
    for _ in range(2):
        ingest_documents.run(spark, config)
    return ingest_documents.read(spark, config)


_CHUNKS = r"""WITH last AS (SELECT doc_id, text, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY md5(coalesce(text, '')) DESC) = 1),
cut AS (SELECT doc_id, source, text AS whole, i::INT AS chunk_index, substr(text, i * 512 + 1, 512) AS text FROM last, unnest(range(0, (length(text) + 511) // 512)) AS u(i)),
filled AS (SELECT doc_id, chunk_index, sha256(whole) || ':' || chunk_index AS id, 'ok' AS status, source, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_terms FROM cut),
chunks AS (
  SELECT doc_id, chunk_index, id, status, starts_with(bare, '```') AND ends_with(bare, '```') AS is_code, n_terms, text, source FROM filled
  UNION ALL SELECT doc_id, NULL, NULL, 'empty', NULL, NULL, NULL, source FROM last WHERE coalesce(text, '') = '')
SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 16)::INT AS bucket FROM chunks"""


_INDEX = f"""WITH {catalogue.bm25_tables('source')},
digits AS (SELECT tf.scope, tf.term, doc_id, df, idf, f::DOUBLE * 2.5e0 / (f::DOUBLE + 1.5e0 * (0.25e0 + 0.75e0 * tf.dl / avgdl)) AS impact,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS of_doc, ('0x' || substr(md5(tf.term), 1, 8))::BIGINT AS of_term
  FROM tf JOIN df ON df.term = tf.term AND df.scope IS NOT DISTINCT FROM tf.scope JOIN w ON w.term = tf.term AND w.scope IS NOT DISTINCT FROM tf.scope
    JOIN st ON st.scope IS NOT DISTINCT FROM tf.scope)
SELECT scope AS source, (of_term % 16)::INT AS bucket, term, CASE WHEN df > 1024 THEN floor(impact * 8) ELSE 0 END::INT AS band, CASE WHEN df > 1024 THEN of_doc % ((df + 1023) // 1024) ELSE 0 END AS part, df, round(any_value(idf), 6) AS idf,
  count(*) AS n, min(impact) AS low, max(impact) AS high, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs
FROM digits GROUP BY ALL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_build_index, job2_ingest_documents)}


def oracle_sql() -> dict[str, str]:
    return {"job1_build_index": _INDEX, "job2_ingest_documents": _CHUNKS}
