"""The registered queries over the driver's tables, each with SQL that gives the same rows.

Documents stand for indexed chunks (``source`` is the tenant), ``benchmark`` for questions, ``embeddings`` for vectors of both
(by id), ``conversations`` for messages, ``events`` for the logs of chats, requests and ingestion.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import bm25, cache, chunking, conversation, dense, fusion, history, inverted, ivf, links, manifest, pages, prompt
from tessera.operators.substrings import SubstringIndex
from tessera.plans.retrieval import HybridRetriever, QAPipeline
from tessera.runtime import load, materialize, scratch_path
from tessera.sources import vector_store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs -------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks with a source path and, for some, a page."""
    path = F.concat(F.lit("raw_pdfs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    page = F.nullif((F.length("text") % 5).cast("int"), F.lit(0))
    return _documents(spark, sf).select("doc_id", "text", "lang", "source", path.alias("source_path"), page.alias("page_number"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return load(spark, sf, "benchmark").join(vectors, "item_id", "left")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _retriever(spark: SparkSession, sf: str, **kw) -> HybridRetriever:
    return HybridRetriever(_indexed(spark, sf), _vectors(spark, sf), **kw)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    company = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return load(spark, sf, "events").select(
        F.col("event_id").alias("id"), company.alias("company_id"), F.col("event_type").alias("question"), F.col("props").alias("answer"),
        F.when(F.col("value") > 20, 1).otherwise(0).alias("starred"), F.col("ts").alias("created_at"),
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """An ingestion log: a line an event; views tell of files that are there, clicks of changed ones, purchases of missing ones."""
    kind = F.col("event_type")
    digest = F.sha2(F.concat(F.lit("body-"), F.col("user_id").cast("string")), 256)
    name = F.when(kind == "purchase", "gone-").otherwise("file-")
    return load(spark, sf, "events").select(
        F.concat(name, F.col("user_id").cast("string")).alias("source_path"),
        F.concat(F.lit("c"), F.substring("event_type", 1, 1)).alias("company_id"),
        F.when(kind == "error", "error").when(kind == "signup", "skipped_scanned").otherwise("ok").alias("status"),
        F.when(kind == "click", "stale").otherwise(digest).alias("file_sha256"),
        F.when(kind == "view", F.concat(F.lit("clean-"), F.floor("value").cast("string"))).alias("clean_path"),
        F.when(kind.isin("view", "click"), F.floor("value").cast("int")).alias("chunk_count"),
        F.col("event_id").alias("seq"),
    )


def _files(spark: SparkSession, sf: str) -> DataFrame:
    users = load(spark, sf, "events").select("user_id").distinct()
    digest = F.sha2(F.concat(F.lit("body-"), F.col("user_id").cast("string")), 256)
    return users.select(F.concat(F.lit("file-"), F.col("user_id").cast("string")).alias("source_path"), digest.alias("current_sha256"))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(F.concat(F.lit("clean-"), (F.col("n_chars") % 40).cast("string")).alias("clean_path")).distinct()


_SQL_INDEXED = "indexed AS (SELECT doc_id, text, source, 'raw_pdfs/' || source || '/' || doc_id || '.pdf' AS source_path, nullif((length(text) % 5)::INT, 0) AS page_number FROM documents)"
_SQL_LOG = """log AS (SELECT CASE WHEN event_type = 'purchase' THEN 'gone-' ELSE 'file-' END || user_id AS source_path, 'c' || substr(event_type, 1, 1) AS company_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped_scanned' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'click' THEN 'stale' ELSE sha256('body-' || user_id) END AS file_sha256,
  CASE WHEN event_type = 'view' THEN 'clean-' || floor(value)::BIGINT END AS clean_path,
  CASE WHEN event_type IN ('view', 'click') THEN floor(value)::INT END AS chunk_count, event_id AS seq FROM events),
entries AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY seq DESC) = 1),
files AS (SELECT DISTINCT 'file-' || user_id AS source_path, sha256('body-' || user_id) AS current_sha256 FROM events),
clean AS (SELECT DISTINCT 'clean-' || (n_chars % 40) AS clean_path FROM documents)"""
_SQL_HISTORY = "history AS (SELECT event_id AS id, 'u' || user_id AS company_id, event_type AS question, props AS answer, CASE WHEN value > 20 THEN 1 ELSE 0 END AS starred, ts AS created_at FROM events)"


def bm25_tables(scope: str) -> str:
    """The statistics: tok, tf, df, st, raw, mean, w (a row per tenant and term, with idf)."""
    return f"""
tok AS (SELECT doc_id, {scope} AS scope, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
tf AS (SELECT doc_id, scope, term, any_value(dl) AS dl, count(*) AS f FROM (SELECT doc_id, scope, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY doc_id, scope, term),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT scope, count(*) AS n, sum(len(t))::DOUBLE / count(*)::DOUBLE AS avgdl FROM tok GROUP BY ALL),
raw AS (SELECT df.scope, term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS r FROM df JOIN st ON df.scope IS NOT DISTINCT FROM st.scope),
mean AS (SELECT scope, avg(r) AS m FROM raw GROUP BY scope),
w AS (SELECT raw.scope, term, CASE WHEN r < 0 THEN 0.25e0 * m ELSE r END AS idf FROM raw JOIN mean ON raw.scope IS NOT DISTINCT FROM mean.scope)"""


def _sql_bm25(scope: str, k: int) -> str:
    return f"""{bm25_tables(scope)},
qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, tf.scope, doc_id, round(sum(idf * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) * qf), 6) AS score
  FROM qt JOIN tf USING (term) JOIN w ON w.term = tf.term AND w.scope IS NOT DISTINCT FROM tf.scope JOIN st ON st.scope IS NOT DISTINCT FROM tf.scope GROUP BY ALL),
bm25 AS (SELECT item_id, scope, doc_id, score, row_number() OVER (PARTITION BY item_id, scope ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k} AND score > 0)"""


def _sql_dense(k: int, where: str = "true") -> str:
    return f"""
qv AS (SELECT item_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
dscored AS (SELECT item_id, vec_id AS doc_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings WHERE {where}),
dense AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dscored QUALIFY rank <= {k})"""


_SQL_FUSED = """
fused AS (SELECT item_id, doc_id, d.rank AS dense_rank, b.rank AS bm25_rank, coalesce(1e0 / (60e0 + d.rank), 0e0) + coalesce(1e0 / (60e0 + b.rank), 0e0) AS rrf_score
  FROM dense d FULL JOIN bm25 b USING (item_id, doc_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM fused QUALIFY rank <= 5)"""
_SQL_HYBRID = f"{_sql_bm25('0', 20)}, {_sql_dense(20)}, {_SQL_FUSED}"
_SQL_RERANKED = f"""{_SQL_HYBRID}, {_SQL_INDEXED},
asked AS (SELECT h.*, i.text, i.source_path, i.page_number, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')) AS dt
  FROM hits h JOIN indexed i USING (doc_id) JOIN benchmark b USING (item_id)),
rescored AS (SELECT *, round(len(list_intersect(qt, dt))::DOUBLE / greatest(len(qt), 1)::DOUBLE, 6) AS rerank_score FROM asked),
reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rescored)"""

# --- text and index -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.term_statistics(bm25.postings(_documents(spark, sf))).select("term", "df", "cf")


@query("""SELECT source, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(sum(n)::DOUBLE / count(*)::DOUBLE, 6) AS avgdl
FROM (SELECT source, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents) GROUP BY source""")
def corpus_stats_per_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.corpus_statistics(bm25.postings(_documents(spark, sf), "source")).select(F.col("scope").alias("source"), "n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_sql_bm25('0', 20)} SELECT item_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_documents(spark, sf), load(spark, sf, "benchmark"), 20)


@query(f"WITH {_sql_bm25('source', 5)} SELECT item_id, scope AS source, doc_id, score, rank FROM bm25")
def bm25_per_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_documents(spark, sf), load(spark, sf, "benchmark"), 5, tenant="source")


@query(f"WITH {_sql_bm25('0', 20)} SELECT item_id, doc_id, score, rank FROM bm25")
def bm25_block_max(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of bm25_topk from an inverted index, by the blocks that can matter only."""
    return inverted.search(materialize(inverted.build(_documents(spark, sf)), "blocks"), load(spark, sf, "benchmark"), 20)


@query(f"WITH {_sql_bm25('source', 5)} SELECT item_id, scope AS source, doc_id, score, rank FROM bm25")
def bm25_block_max_per_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of bm25_per_tenant from inverted indexes of the tenants."""
    return inverted.search(materialize(inverted.build(_documents(spark, sf), "source"), "blocks"), load(spark, sf, "benchmark"), 5, tenant="source")


@query(f"WITH {_sql_dense(10)} SELECT * FROM dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(_vectors(spark, sf), _questions(spark, sf), 10)


@query(f"WITH {_sql_dense(10)} SELECT * FROM dense")
def dense_ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of dense_topk from an inverted file: eight cells for each question, and those beyond that its bound does not rule out."""
    return ivf.Cells.build(_vectors(spark, sf), scratch_path(spark, "cells")).search(_questions(spark, sf), 10, exact=True)


@query(f"WITH {_sql_dense(10, 'label >= 3 AND label <> 5')} SELECT * FROM dense")
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(_vectors(spark, sf), _questions(spark, sf), 10, {"$and": [{"label": {"$gte": 3}}, {"label": {"$ne": 5}}]})


@query(f"WITH {_SQL_HYBRID} SELECT item_id, doc_id, dense_rank, bm25_rank, round(rrf_score, 9) AS rrf_score, rank FROM hits")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _retriever(spark, sf).search(_questions(spark, sf))
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"WITH {_sql_dense(20)} SELECT item_id, doc_id, rank AS dense_rank, round(1e0 / (60e0 + rank), 9) AS rrf_score, rank FROM dense WHERE rank <= 5")
def hybrid_dense_only(spark: SparkSession, sf: str) -> DataFrame:
    found = _retriever(spark, sf, use_bm25=False).search(_questions(spark, sf))
    return found.select("item_id", "doc_id", "dense_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def _reranked(spark: SparkSession, sf: str, gap: float | None = None) -> DataFrame:
    return QAPipeline(_retriever(spark, sf), max_score_gap=gap).hits(_questions(spark, sf))


@query(f"WITH {_SQL_RERANKED} SELECT item_id, doc_id, rerank_score, rerank_rank FROM reranked")
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("item_id", "doc_id", "rerank_score", "rerank_rank")


@query(f"WITH {_SQL_RERANKED} SELECT item_id, doc_id, rerank_score FROM reranked QUALIFY rerank_score >= max(rerank_score) OVER (PARTITION BY item_id) - 0.1e0")
def score_gap_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf, 0.1).select("item_id", "doc_id", "rerank_score")


@query(f"WITH {_SQL_RERANKED} SELECT item_id, rerank_rank::INT AS marker, source_path, page_number, sha256(text) AS chunk_sha256, rerank_score AS score FROM reranked")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    cited = prompt.citations(_reranked(spark, sf), "place")
    return cited.select("item_id", "marker", "source_path", "page_number", F.sha2("chunk_text", 256).alias("chunk_sha256"), "score")


@query(f"WITH {_SQL_RERANKED} SELECT item_id, rerank_rank::INT AS marker, string_split(source_path, '/')[-1] AS source_path, page_number, substr(text, 1, 300) AS chunk_text, rerank_score AS score FROM reranked")
def citation_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return prompt.citations(_reranked(spark, sf), "place", prompt.SNIPPET)


@query(f"""WITH {_SQL_RERANKED},
blocks AS (SELECT item_id, string_agg('[' || rerank_rank || '] (source: ' || source_path || coalesce(', page ' || page_number, '') || ')' || chr(10) || text, chr(10) ORDER BY rerank_rank) AS context FROM reranked GROUP BY item_id)
SELECT item_id, 'Context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || '{prompt.CLOSING}' AS prompt FROM blocks JOIN benchmark USING (item_id)""")
def context_prompt(spark: SparkSession, sf: str) -> DataFrame:
    asked = _questions(spark, sf)
    context = prompt.contexts(prompt.citations(_reranked(spark, sf), "place")).join(asked.select("item_id", "text"), "item_id")
    return context.select("item_id", prompt.prompt(F.col("context"), F.col("text")).alias("prompt"))


_NO_HIT = prompt.NO_HIT_ANSWER.replace("'", "''")


@query(f"WITH {_sql_bm25('0', 1)} SELECT item_id, coalesce('doc ' || doc_id, '{_NO_HIT}') AS answer FROM benchmark LEFT JOIN (SELECT * FROM bm25 WHERE score > 25) USING (item_id)")
def no_hit_answer(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "benchmark")
    best = bm25.search(_documents(spark, sf), asked, 1).filter("score > 25")
    return prompt.answers(asked, best.select("item_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("answer")))


_SQL_PAIRS = """said AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, question, text AS answer FROM said WHERE role = 'assistant' AND before = 'user')"""
_SQL_BLOCKS = """blocks AS (SELECT item_id, string_agg('[' || rerank_rank || '] (source: ' || source_path || coalesce(', page ' || page_number, '') || ')' || chr(10) || text, chr(10) ORDER BY rerank_rank) AS context, count(*)::INT AS n
  FROM reranked WHERE rerank_rank <= 5 GROUP BY item_id)"""
_SQL_ASK = f"'Context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || '{prompt.CLOSING}'"


@query(f"""WITH {_SQL_RERANKED}, {_SQL_BLOCKS}
SELECT item_id, CASE WHEN n IS NULL THEN '{_NO_HIT}' ELSE 'echo:' || sha256({_SQL_ASK}) END AS answer, n AS n_citations FROM benchmark LEFT JOIN blocks USING (item_id)""")
def qa_answers(spark: SparkSession, sf: str) -> DataFrame:
    return QAPipeline(_retriever(spark, sf)).answer(_questions(spark, sf)).select("item_id", "answer", F.size("citations").alias("n_citations"))


def _follow_ups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions that follow conversations: item i is asked at the end of the i-th one, where there is one; and all messages."""
    messages = load(spark, sf, "conversations")
    ends = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return _questions(spark, sf).join(ends, F.col("item_id") == F.col("conv_id"), "left").withColumn("conv_id", F.col("item_id")), messages


_SQL_TOLD = """told AS (SELECT conv_id AS item_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY turn) FILTER (place <= 3) AS three,
  max('Previous Q: ' || question || chr(10) || 'Previous A: ' || answer) FILTER (place = 1) AS one FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM pairs) GROUP BY conv_id)"""
_SQL_REWRITTEN = """rewritten AS (SELECT item_id, b.text AS asked, one, CASE WHEN three IS NULL THEN b.text ELSE
  substr(sha256('Conversation history:' || chr(10) || three || chr(10) || chr(10) || 'Follow-up question: ' || b.text || chr(10) || chr(10) || 'Standalone question:'), 1, 8) || ' ' || b.text END AS text FROM benchmark b LEFT JOIN told USING (item_id))"""


def _sql_follow_ups() -> str:
    """The reranked hits of rewritten questions, searched by words alone."""
    words = _sql_bm25("0", 20).replace("FROM benchmark)", "FROM rewritten)")
    return f"""{_SQL_PAIRS}, {_SQL_TOLD}, {_SQL_REWRITTEN}, {words}, {_SQL_INDEXED},
asked AS (SELECT h.item_id, h.rank, i.text, i.source_path, i.page_number, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')) AS dt
  FROM bm25 h JOIN indexed i USING (doc_id) JOIN rewritten b USING (item_id) WHERE h.rank <= 5),
rescored AS (SELECT *, round(len(list_intersect(qt, dt))::DOUBLE / greatest(len(qt), 1)::DOUBLE, 6) AS rerank_score FROM asked),
reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rescored), {_SQL_BLOCKS}"""


@query(f"""WITH {_sql_follow_ups()}
SELECT item_id, CASE WHEN n IS NULL THEN '{_NO_HIT}' ELSE 'echo:' || sha256(coalesce('{prompt.RECENT_HEAD}' || chr(10) || one || chr(10) || chr(10) || chr(10), '') || {_SQL_ASK.replace("|| text ||", "|| asked ||")}) END AS answer,
  n AS n_citations, nullif(text, asked) AS standalone FROM rewritten LEFT JOIN blocks USING (item_id)""")
def qa_follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to questions at the end of conversations; a digest of the condensing prompt stands for the model that rewrites them."""
    asked, messages = _follow_ups(spark, sf)
    rewrite = lambda p: F.concat(F.substring(F.sha2(p, 256), 1, 8), F.lit(" "), F.regexp_extract(p, r"(?s)Follow-up question: (.*)\n\nStandalone question:$", 1))
    nowhere = _vectors(spark, sf).filter(F.lit(False))
    pipeline = QAPipeline(HybridRetriever(_indexed(spark, sf), nowhere), condense=rewrite, embed=lambda text: F.lit(None))
    found = pipeline.answer(asked, messages=messages)
    return found.select("item_id", "answer", F.size("citations").alias("n_citations"), "standalone")


@query(f"""WITH {_sql_bm25('source', 1)}
SELECT item_id, source, doc_id AS best_doc, score FROM (SELECT item_id, source FROM benchmark, (SELECT DISTINCT source FROM documents)) LEFT JOIN (SELECT item_id, scope AS source, doc_id, score FROM bm25) USING (item_id, source)""")
def compare_tenants(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's best document in every tenant; the grid is a row per question and tenant."""
    best = bm25.search(_documents(spark, sf), load(spark, sf, "benchmark"), 1, tenant="source")
    tenants = _documents(spark, sf).groupBy().agg(F.collect_set("source").alias("all"))  # a name per tenant
    grid = load(spark, sf, "benchmark").select("item_id").withColumn("source", F.explode(F.lit(tenants.first()["all"])))
    return grid.join(best, ["item_id", "source"], "left").select("item_id", "source", F.col("doc_id").alias("best_doc"), "score")


# --- pages and chunks ---------------------------------------------------------------------------------------

_SQL_PAGES = """pages_ AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS page FROM documents),
flags AS (SELECT doc_id, page, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INT AS char_count FROM pages_)"""


@query(f"WITH {_SQL_PAGES} SELECT doc_id, page, char_count, char_count < 20 AS is_likely_scanned FROM flags")
def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_flags(pages.lines_as_pages(_documents(spark, sf))).drop("text")


@query(f"WITH {_SQL_PAGES} SELECT doc_id, count(*) AS page_count, count_if(char_count < 20)::BIGINT AS scanned_page_count, avg((char_count < 20)::INT) > 0.5 AS is_scanned FROM flags GROUP BY doc_id")
def scanned_docs(spark: SparkSession, sf: str) -> DataFrame:
    return pages.scanned_documents(pages.page_flags(pages.lines_as_pages(_documents(spark, sf))))


@query(f"""WITH {_SQL_PAGES}, parts AS (SELECT doc_id, page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM pages_)
SELECT doc_id, string_agg('<!-- page:' || page || ' -->' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END, chr(10) || chr(10) ORDER BY page) AS markdown FROM parts GROUP BY doc_id""")
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return pages.marked_document(pages.lines_as_pages(_documents(spark, sf)))


@query("SELECT doc_id, i::INT AS chunk_index, substr(text, i * 512 + 1, 512) AS text FROM documents, unnest(range(0, (length(text) + 511) // 512)) AS u(i)")
def chunk_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed_width(_documents(spark, sf))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_documents(spark, sf), 512, 50, 100)


@query(f"""WITH {_SQL_PAGES}, m AS (SELECT doc_id, page, coalesce(sum(CASE WHEN t <> '' THEN length(t) + 2 ELSE 0 END + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM (SELECT doc_id, page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM pages_)),
p AS (SELECT doc_id, i * 512 AS position FROM documents, unnest(range(0, (length(text) + 511) // 512)) AS u(i))
SELECT p.doc_id, position::BIGINT AS position, page FROM p ASOF JOIN m ON p.doc_id = m.doc_id AND p.position >= m.at""")
def chunk_page_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The page on which every 512th character of the marked document stands."""
    marked = page_markdown(spark, sf).withColumnRenamed("markdown", "text")
    positions = chunking.fixed_width(_documents(spark, sf)).select("doc_id", (F.col("chunk_index") * 512).alias("position"))
    return chunking.page_asof(positions, chunking.page_markers(marked))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(text, chr(10))) AS t, len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT doc_id, k, k % 2 = 0 AS is_fence, CASE WHEN k % 2 = 0 THEN '```' || t || '```' ELSE CASE WHEN k > 1 THEN chr(10) ELSE '' END || t || CASE WHEN k < n THEN chr(10) ELSE '' END END AS text FROM l)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS segment_no, is_fence, text FROM s WHERE regexp_matches(text, '\\S')""")
def fence_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every second line of every whole text set in a fence."""
    fenced = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 2 == 1, F.concat(F.lit("```"), line, F.lit("```"))).otherwise(line))
    return chunking.fence_segments(_documents(spark, sf).select("doc_id", F.array_join(fenced, "\n").alias("text")))


@query("SELECT doc_id, sha256(text) AS file_sha256, sha256(text) || ':0' AS id FROM documents")
def sha256_ids(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return _documents(spark, sf).select("doc_id", digest.alias("file_sha256"), fx.chunk_id(digest, F.lit(0)).alias("id"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _indexed(spark, sf).select(fx.chunk_id(F.sha2("text", 256), F.lit(0)).alias("id"), "source_path", F.coalesce("page_number", F.lit(-1)).alias("page_number"), F.col("doc_id").alias("seq"))


_SQL_CHUNKS = f"{_SQL_INDEXED}, chunks AS (SELECT sha256(text) || ':0' AS id, source_path, coalesce(page_number, -1) AS page_number, doc_id AS seq FROM indexed)"


@query(f"WITH {_SQL_CHUNKS} SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Files of equal bytes share an id; the last one keeps it."""
    rows = _chunks(spark, sf)
    return vector_store.upserted(rows.filter(F.lit(False)), rows)


@query(f"WITH {_SQL_CHUNKS} SELECT * FROM chunks WHERE source_path NOT IN (SELECT 'raw_pdfs/src0/' || item_id || '.pdf' FROM benchmark)")
def delete_by_source(spark: SparkSession, sf: str) -> DataFrame:
    gone = load(spark, sf, "benchmark").select(F.concat(F.lit("raw_pdfs/src0/"), F.col("item_id").cast("string"), F.lit(".pdf")).alias("source_path"))
    return vector_store.without_sources(_chunks(spark, sf), gone)


@query(f"WITH {_SQL_CHUNKS} SELECT * FROM chunks WHERE id NOT IN (SELECT sha256(text) || ':0' FROM documents WHERE lang = 'fr')")
def delete_by_id(spark: SparkSession, sf: str) -> DataFrame:
    gone = _documents(spark, sf).filter("lang = 'fr'").select(fx.chunk_id(F.sha2("text", 256), F.lit(0)).alias("id"))
    return vector_store.without_ids(_chunks(spark, sf), gone)


@query("SELECT source AS company_id, count(*) AS n_chunks FROM documents GROUP BY source")
def vector_count(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).groupBy(F.col("source").alias("company_id")).agg(F.count("*").alias("n_chunks"))


@query("SELECT item_id, [round(('0x' || substr(sha256(text), 2 * i + 1, 2))::INT / 255e0, 9) for i in range(16)] AS embedding FROM benchmark")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    vector = F.transform(fx.hash_embedding(F.col("text")), lambda x: F.round(x, 9))
    return load(spark, sf, "benchmark").select("item_id", vector.alias("embedding"))


@query(f"SELECT item_id, sha256('{fx.QUERY_PREFIX}' || text) AS encoded_sha256 FROM benchmark")
def query_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", F.sha2(fx.query_text(F.col("text"), "bge-small"), 256).alias("encoded_sha256"))


# --- characters of pages ------------------------------------------------------------------------------------


def _chars(spark: SparkSession, sf: str) -> DataFrame:
    """Words of questions laid out as characters of a page: first words large, every third line in a typewriter face."""
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ")).alias("ord", "text"))
    line = F.floor(F.col("ord") / 5)
    return words.select(
        "doc_id", F.lit(1).alias("page"), "ord", F.concat("text", F.lit(" ")).alias("text"), F.when(line == 0, 18.0).otherwise(11.0).alias("size"),
        F.when(line % 3 == 2, "Courier").otherwise("Helvetica").alias("fontname"), (line * 12.0).alias("top"), (F.col("ord") % 5).cast("double").alias("x0"),
    )


_SQL_CHARS = """chars AS (SELECT item_id AS doc_id, i - 1 AS ord, string_split(text, ' ')[i] || ' ' AS text, (i - 1) // 5 AS line, CASE WHEN (i - 1) // 5 = 0 THEN 18e0 ELSE 11e0 END AS size
  FROM benchmark, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i)),
lines AS (SELECT doc_id, line, string_agg(text, '' ORDER BY ord) AS text, avg(size) AS mean_size, line % 3 = 2 AS mono FROM chars GROUP BY doc_id, line),
body AS (SELECT doc_id, quantile_cont(size, 0.5) AS body_size FROM chars GROUP BY doc_id)"""


@query(f"WITH {_SQL_CHARS} SELECT * FROM body")
def font_body_median(spark: SparkSession, sf: str) -> DataFrame:
    return pages.body_sizes(_chars(spark, sf))


@query(f"WITH {_SQL_CHARS} SELECT doc_id, 1 AS page, line * 12e0 AS line_top, text, mean_size, CASE WHEN mono THEN 1e0 ELSE 0e0 END AS code_share FROM lines")
def line_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return pages.lines(_chars(spark, sf))


@query(f"""WITH {_SQL_CHARS}, marked AS (SELECT doc_id, line, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, text, mean_size >= 1.15e0 * body_size AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 120 AS heading, mono FROM lines JOIN body USING (doc_id)),
c AS (SELECT *, NOT heading AND mono AS code FROM marked WHERE t <> ''),
e AS (SELECT *, code AND NOT coalesce(lag(code) OVER w, false) AS opens, code AND NOT coalesce(lead(code) OVER w, false) AS closes FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, 1 AS page, string_agg(CASE WHEN opens THEN '```' || chr(10) ELSE '' END || CASE WHEN heading THEN '## ' ELSE '' END || CASE WHEN code THEN text ELSE t END || CASE WHEN closes THEN chr(10) || '```' ELSE '' END, chr(10) ORDER BY line) AS markdown FROM e GROUP BY doc_id""")
def chars_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_markdown(_chars(spark, sf))


# --- conversations ------------------------------------------------------------------------------------------



@query(f"WITH {_SQL_PAIRS} SELECT * FROM pairs")
def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.pairs(load(spark, sf, "conversations"))


def _sql_recent(n: int, q: str, a: str) -> str:
    return f"string_agg('{q}: ' || question || chr(10) || '{a}: ' || answer, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(f"WITH {_SQL_PAIRS} SELECT conv_id, turn, 'Conversation history:' || chr(10) || {_sql_recent(3, 'Q', 'A')} || chr(10) || chr(10) || 'Follow-up question: ' || question || chr(10) || chr(10) || 'Standalone question:' AS prompt FROM pairs")
def condense_window(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.condense_prompt(conversation_pairs(spark, sf))


@query(f"WITH {_SQL_PAIRS} SELECT conv_id, turn, {_sql_recent(1, 'Previous Q', 'Previous A')} AS recent FROM pairs")
def generation_window(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.generation_window(conversation_pairs(spark, sf)).select("conv_id", "turn", "recent")


@query(f"""WITH {_SQL_PAIRS}, r AS (SELECT conv_id, turn, question, CASE WHEN turn > 2 THEN '" ' || question || ' "' WHEN turn = 2 THEN '  ' END AS rewritten FROM pairs),
c AS (SELECT conv_id, turn, question, coalesce(nullif(trim(regexp_replace(rewritten, '^\\s+|\\s+$', '', 'g'), '"'), ''), question) AS condensed FROM r)
SELECT conv_id, turn, condensed, nullif(condensed, question) AS standalone FROM c""")
def standalone_question(spark: SparkSession, sf: str) -> DataFrame:
    rewritten = F.when(F.col("turn") > 2, F.concat(F.lit('" '), F.col("question"), F.lit(' "'))).when(F.col("turn") == 2, "  ")
    rows = conversation_pairs(spark, sf).withColumn("condensed", conversation.condensed(F.col("question"), rewritten))
    return rows.select("conv_id", "turn", "condensed", conversation.standalone(F.col("question"), F.col("condensed")).alias("standalone"))


# --- history ------------------------------------------------------------------------------------------------


@query(f"WITH {_SQL_HISTORY} SELECT id, company_id, question, answer, starred, created_at FROM history WHERE company_id = 'u1' ORDER BY created_at DESC, id DESC LIMIT 50")
def history_list(spark: SparkSession, sf: str) -> DataFrame:
    return history.entries(_history(spark, sf), "u1")


@query(f"WITH {_SQL_HISTORY} SELECT id, company_id, question, answer, starred, created_at FROM history WHERE question ILIKE '%C_ICK%' OR answer ILIKE '%C_ICK%'")
def history_search(spark: SparkSession, sf: str) -> DataFrame:
    return history.matching(_history(spark, sf), "C_ICK")


_SEARCHES = ("einheit", "TION%ouch", "er_der", "nowhere to be found", "de")


@query(f"""WITH said AS (SELECT (conv_id * 1000 + turn)::BIGINT AS id, CASE WHEN role = 'user' THEN text END AS question, CASE WHEN role <> 'user' THEN text END AS answer FROM conversations),
searches AS (SELECT unnest({list(_SEARCHES)}) AS search)
SELECT search, id FROM searches, said WHERE question ILIKE '%' || search || '%' OR answer ILIKE '%' || search || '%'""")
def history_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of the turns of all conversations, through an index of trigrams that is made anew."""
    said = load(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.when(F.col("role") == "user", F.col("text")).alias("question"), F.when(F.col("role") != "user", F.col("text")).alias("answer")
    )
    index = SubstringIndex(spark, scratch_path(spark, "substrings"), 8, 8)
    index.refresh(said)
    found = [index.matching(said, s).select(F.lit(s).alias("search"), "id") for s in _SEARCHES]
    return functools.reduce(DataFrame.union, found)


@query(f"WITH {_SQL_HISTORY} SELECT id, CASE WHEN question = 'view' THEN 1 - starred ELSE starred END AS starred FROM history")
def history_toggle_star(spark: SparkSession, sf: str) -> DataFrame:
    return history.toggle_star(_history(spark, sf), F.col("question") == "view").select("id", "starred")


@query(f"WITH {_SQL_HISTORY} SELECT id, company_id FROM history WHERE question <> 'error'")
def history_delete(spark: SparkSession, sf: str) -> DataFrame:
    return history.delete(_history(spark, sf), F.col("question") == "error").select("id", "company_id")


@query(f"WITH {_SQL_HISTORY} SELECT id, CASE WHEN question = 'view' THEN 1 ELSE 0 END AS n_sources, starred = 1 AS starred FROM history")
def history_decode(spark: SparkSession, sf: str) -> DataFrame:
    one = F.concat(F.lit('[{"marker":1,"source":"'), F.col("question"), F.lit('","page":2,"snippet":"s","score":0.5}]'))
    rows = _history(spark, sf).withColumn("citations_json", F.when(F.col("question") == "view", one).when(F.col("question") != "error", "[]"))
    return history.decoded(rows).select("id", "n_sources", "starred")


@query(f"WITH {_SQL_HISTORY}, old AS (SELECT max(id) AS top FROM history), n AS (SELECT 'new' AS company_id, text AS question, item_id FROM benchmark) SELECT (row_number() OVER (ORDER BY item_id) + top)::BIGINT AS id, question FROM n, old")
def history_insert(spark: SparkSession, sf: str) -> DataFrame:
    citation = F.array(F.struct(F.lit(1).alias("marker"), F.lit("a.pdf").alias("source")))
    new = load(spark, sf, "benchmark").select(
        F.lit("new").alias("company_id"), F.col("text").alias("question"), F.lit("a").alias("answer"), citation.alias("citations"),
        F.timestamp_seconds(F.lit(1_900_000_000) + F.col("item_id")).alias("created_at"),
    )
    old = _history(spark, sf).withColumn("citations_json", F.lit("[]"))
    return history.append(old, new).filter("company_id = 'new'").select("id", "question")


# --- bookkeeping --------------------------------------------------------------------------------------------


@query(f"WITH {_SQL_LOG} SELECT source_path, company_id, status, file_sha256, clean_path, chunk_count, seq FROM entries")
def manifest_replay(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.latest(_log(spark, sf))


_SQL_AUDIT = f"""{_SQL_LOG}, audited AS (SELECT e.source_path, CASE WHEN status = 'error' THEN 'ERROR_ENTRY' WHEN status = 'skipped_scanned' THEN 'SCANNED' WHEN current_sha256 IS NULL THEN 'MISSING_SOURCE'
  WHEN current_sha256 <> file_sha256 THEN 'HASH_MISMATCH' WHEN e.clean_path IS NOT NULL AND c.clean_path IS NULL THEN 'MISSING_CLEAN_FILE' ELSE 'OK' END AS outcome
  FROM entries e LEFT JOIN files USING (source_path) LEFT JOIN clean c ON c.clean_path = e.clean_path)"""


@query(f"WITH {_SQL_AUDIT} SELECT * FROM audited")
def manifest_audit(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.audit(manifest_replay(spark, sf), _files(spark, sf), _clean(spark, sf))


@query(f"""WITH {_SQL_AUDIT}, known(outcome, is_failure) AS (VALUES ('ERROR_ENTRY', true), ('SCANNED', false), ('MISSING_SOURCE', true), ('HASH_MISMATCH', true), ('MISSING_CLEAN_FILE', true), ('OK', false))
SELECT outcome, count(source_path) AS n, is_failure FROM known LEFT JOIN audited USING (outcome) GROUP BY outcome, is_failure""")
def manifest_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.audit_counts(manifest_audit(spark, sf))


@query(f"WITH {_SQL_LOG} SELECT source_path, current_sha256 FROM files f WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.source_path = f.source_path AND status = 'ok' AND file_sha256 = current_sha256 AND (clean_path IS NULL OR clean_path IN (SELECT clean_path FROM clean)))")
def needs_processing(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.needs_processing(_files(spark, sf), manifest_replay(spark, sf), _clean(spark, sf))


@query(f"WITH {_SQL_LOG} SELECT source_path, file_sha256, seq FROM log l WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.source_path = l.source_path AND current_sha256 = file_sha256)")
def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.stale_chunks(_log(spark, sf), _files(spark, sf)).select("source_path", "file_sha256", "seq")


@query(f"WITH {_SQL_LOG} SELECT company_id, count_if(status = 'ok')::BIGINT AS n_ok, count_if(status = 'error')::BIGINT AS n_error, count_if(status = 'skipped_scanned')::BIGINT AS n_skipped_scanned FROM entries GROUP BY company_id")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.status_counts(manifest_replay(spark, sf), "company_id")


@query(f"WITH {_SQL_LOG} SELECT company_id, count(*) AS total_pdfs, sum(coalesce(chunk_count, 0))::BIGINT AS total_chunks FROM entries GROUP BY company_id")
def tenant_stats(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.tenant_stats(manifest_replay(spark, sf))


@query(f"WITH {_SQL_LOG} SELECT status, count(*) AS n, sum(coalesce(chunk_count, 0))::BIGINT AS chunks, (SELECT count_if(status = 'error') > 0 AND count_if(status = 'ok') = 0 FROM log) AS failed FROM log GROUP BY status")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.ingest_summary(_log(spark, sf))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return manifest_replay(spark, sf).select(F.col("source_path").alias("path"), manifest.last_state(F.col("status")).alias("state"))


_SQL_STATE = f"{_SQL_LOG}, state AS (SELECT source_path AS path, CASE status WHEN 'ok' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'skipped_scanned' END AS state FROM entries)"


@query(f"WITH {_SQL_STATE} SELECT DISTINCT 'file-' || doc_id AS path FROM documents WHERE 'file-' || doc_id NOT IN (SELECT path FROM state WHERE state <> 'failed')")
def checkpoint_seed(spark: SparkSession, sf: str) -> DataFrame:
    paths = _documents(spark, sf).select(F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("path"))
    return manifest.seed(paths, _state(spark, sf))


@query(f"WITH {_SQL_STATE}, u AS (SELECT 'file-' || item_id AS path, 'completed' AS state FROM benchmark) SELECT path, coalesce(u.state, s.state) AS state FROM state s FULL JOIN u USING (path)")
def checkpoint_mark(spark: SparkSession, sf: str) -> DataFrame:
    done = load(spark, sf, "benchmark").select(F.concat(F.lit("file-"), F.col("item_id").cast("string")).alias("path"), F.lit("completed").alias("state"))
    return manifest.mark(_state(spark, sf), done)


@query(f"WITH {_SQL_STATE} SELECT count_if(state = 'pending') = 0 AS complete FROM state")
def checkpoint_complete(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.is_complete(_state(spark, sf))


@query(f"""WITH {_SQL_LOG}, {_SQL_HISTORY}, r AS (SELECT company_id, count(*) AS p, sum(coalesce(chunk_count, 0)) AS c FROM entries GROUP BY company_id), h AS (SELECT least(count(*), 100000) AS n FROM history GROUP BY company_id)
SELECT count(*) AS companies, sum(p)::BIGINT AS pdfs, sum(c)::BIGINT AS chunks, (SELECT sum(n)::BIGINT FROM h) AS questions FROM r""")
def query_volume(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.totals(tenant_stats(spark, sf), _history(spark, sf))


@query(f"WITH {_SQL_LOG} SELECT company_id, upper(company_id) AS name, count(*) AS total_pdfs, sum(coalesce(chunk_count, 0))::BIGINT AS total_chunks, CASE WHEN company_id = 'cv' THEN '2024-02-01' ELSE 'never' END AS last_ingestion FROM entries GROUP BY company_id")
def registry_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = tenant_stats(spark, sf).withColumn("name", F.upper("company_id")).withColumn("last_ingestion", F.when(F.col("company_id") == "cv", "2024-02-01"))
    return manifest.registry_list(rows)


@query("SELECT event_id, substr(sha256(concat_ws('||', 'u' || user_id, event_type, '5')), 1, 24) AS key FROM events")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    company = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return load(spark, sf, "events").select("event_id", fx.cache_key(company, F.col("event_type"), F.lit(5)).alias("key"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
miss AS (SELECT user_id, event_type, min(us) AS us FROM e GROUP BY user_id, event_type
  UNION ALL SELECT m.user_id, m.event_type, (SELECT min(e.us) FROM e WHERE e.user_id = m.user_id AND e.event_type = m.event_type AND e.us >= m.us + 86400000000) AS us FROM miss m WHERE m.us IS NOT NULL),
firsts AS (SELECT user_id, event_type, us, min(event_id) AS event_id FROM e GROUP BY ALL)
SELECT e.event_id, m.us IS NULL AS hit FROM e LEFT JOIN (SELECT f.event_id, f.us FROM miss JOIN firsts f USING (user_id, event_type, us)) m ON m.event_id = e.event_id""")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return cache.cache_hits(load(spark, sf, "events"), 86_400, ["user_id", "event_type"]).select("event_id", "hit")


# --- links --------------------------------------------------------------------------------------------------

_SQL_LINKS = """h AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages),
l AS (SELECT page_id, url, (unnest(range(0, len(hrefs))))::INT AS at, regexp_replace(regexp_replace(root || unnest(hrefs), '#.*$', ''), '/+$', '') AS link FROM h)"""


@query(f"WITH {_SQL_LINKS} SELECT * FROM l")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.extract_links(load(spark, sf, "pages"))


def _sql_name() -> str:
    path = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"
    return f"replace(regexp_replace(CASE WHEN {path} = '' THEN 'index' ELSE {path} END, '[^a-zA-Z0-9_/-]', '_', 'g'), '/', '__') || '.pdf'"


@query(f"SELECT page_id, {_sql_name()} AS filename FROM pages")
def sanitize_filename(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", links.file_name(F.col("url")).alias("filename"))


@query(f"SELECT filename, count(*) AS n_pages FROM (SELECT DISTINCT url, {_sql_name()} AS filename FROM pages) GROUP BY filename HAVING count(*) > 1")
def filename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return links.name_collisions(load(spark, sf, "pages"))


@query(f"""WITH RECURSIVE {_SQL_LINKS}, edges AS (SELECT DISTINCT url, link FROM l),
c AS (SELECT DISTINCT url, 0 AS depth FROM pages UNION SELECT link, depth + 1 FROM c JOIN edges USING (url) WHERE depth < 1000)
SELECT url, min(depth)::INT AS depth FROM c GROUP BY url""")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    found = links.extract_links(load(spark, sf, "pages"))
    return links.crawl_levels(load(spark, sf, "pages").select("url"), found.select("url", "link"))


# --- tenants ------------------------------------------------------------------------------------------------


def _tenant(column: Column) -> Column:
    """Tenant names of which some have characters that ids may not have."""
    return F.when(F.length("text") % 3 == 0, F.concat(column, F.lit(" X"))).otherwise(column)


_SQL_TENANT = "CASE WHEN length(text) % 3 = 0 THEN source || ' X' ELSE source END"


@query(f"SELECT doc_id, regexp_full_match({_SQL_TENANT}, '[a-z0-9_-]+') AS valid FROM documents")
def tenant_id_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", fx.valid_tenant_id(_tenant(F.col("source"))).alias("valid"))


@query(f"SELECT doc_id, (list_sum([ord(x) for x in string_split({_SQL_TENANT}, '')]) % 4)::INT AS bucket FROM documents")
def avatar_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", fx.avatar_bucket(_tenant(F.col("source"))).alias("bucket"))


@query(f"SELECT doc_id, upper(array_to_string([substr(w, 1, 1) for w in string_split({_SQL_TENANT}, ' ')], '')) AS initials FROM documents")
def tenant_initials(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", fx.initials(_tenant(F.col("source"))).alias("initials"))
