"""A tenant's life in one folder: register, ingest, ask, audit, reset. Each step is one plan over all its files."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id, hash_embedding, query_text
from tessera.operators import bm25, chunking, history, manifest, pages
from tessera.operators.cache import AnswerCache
from tessera.operators.segments import SegmentedIndex
from tessera.plans.retrieval import HybridRetriever, QAPipeline
from tessera.runtime import materialize, tenant_log
from tessera.sources import pdf, stores
from tessera.sources.config import TenantConfig
from tessera.sources.vector_store import VectorStore, check_tenant

log = logging.getLogger(__name__)


class Workspace:
    """``embed`` makes a vector Column of a text Column; ``parse`` makes page texts of a file's bytes, ``parse_chars`` the characters of
    its pages, of which each page's better text is taken (None: plain texts only)."""

    def __init__(
        self, spark: SparkSession, root: str, parse: Callable[[bytes], list[str]] = pdf.pypdf_pages, embed: Callable[[Column], Column] = hash_embedding,
        parse_chars: Callable[[bytes], list[list[dict]]] | None = pdf.pdfplumber_chars,
    ):
        self.spark, self.root, self.parse, self.embed, self.parse_chars = spark, root.rstrip("/"), parse, embed, parse_chars

    def _path(self, company_id: str, name: str) -> str:
        return f"{self.root}/companies/{check_tenant(company_id)}/{name}"

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        system, where = self._files(path)
        return system.exists(where)

    def _remove(self, path: str) -> None:
        system, where = self._files(path)
        system.delete(where, True)

    # --- tenants

    def registry(self) -> DataFrame:
        return stores.load_registry(self.spark, f"{self.root}/registry")

    def _save(self, registry: DataFrame) -> None:
        stores.save_registry(materialize(registry, "registry"), f"{self.root}/registry")

    def add(self, company_id: str, name: str) -> None:
        self._save(stores.add_company(self.registry(), company_id, name, f"{self.root}/companies"))
        system, where = self._files(self._path(company_id, "raw_pdfs"))
        system.mkdirs(where)

    def upload(self, company_id: str, name: str, content: bytes) -> str:
        """Put a file among the tenant's raw files, under the last segment of its name; one of that name is replaced. Returns its path."""
        stores.get_company(self.registry(), company_id)
        bare = name.replace("\\", "/").rsplit("/", 1)[-1]
        if bare in ("", ".", ".."):
            raise ValueError(f"not a file name: {name!r}")
        path = f"{self._path(company_id, 'raw_pdfs')}/{bare}"
        system, where = self._files(path)
        out = system.create(where, True)
        out.write(bytearray(content))
        out.close()
        return path

    def remove(self, company_id: str, delete_data: bool = False) -> None:
        self._save(stores.remove_company(self.registry(), company_id))
        if delete_data:
            self._remove(f"{self.root}/companies/{check_tenant(company_id)}")
            self.store(company_id).wipe()

    def info(self, company_id: str) -> DataFrame:
        """The registry row with counts of the manifest's states."""
        stores.get_company(self.registry(), company_id)
        counts = manifest.status_counts(self.manifest(company_id), "company_id")
        return manifest.registry_list(self.registry().filter(F.col("company_id") == company_id)).join(counts, "company_id", "left").fillna(0, [f"n_{s}" for s in manifest.STATUSES])

    def store(self, company_id: str) -> VectorStore:
        return VectorStore(self.spark, f"{self.root}/vectors", company_id)

    def manifest(self, company_id: str) -> DataFrame:
        path = self._path(company_id, "manifest")
        return stores.load_manifest(self.spark, path) if self._exists(path) else self.spark.createDataFrame([], stores.MANIFEST)

    def clean(self, company_id: str) -> DataFrame:
        """(clean_path, file_sha256, markdown) of what was extracted."""
        path = self._path(company_id, "clean")
        if not self._exists(path):
            return self.spark.createDataFrame([], "clean_path string, file_sha256 string, markdown string")
        rows = self.spark.read.schema("file_sha256 string, markdown string, prefix string").parquet(path)
        return rows.select(F.concat(F.lit("clean/"), "file_sha256", F.lit(".md")).alias("clean_path"), "file_sha256", "markdown")

    # --- ingestion

    def _chunks(self, company_id: str) -> DataFrame:
        return self.store(company_id).rows().select(F.col("id").alias("doc_id"), F.col("document").alias("text"))

    def index(self, company_id: str) -> bm25.Index:
        """The tenant's stored BM25 index; chunks that came or went since it was last asked for make a segment of it."""
        kept = SegmentedIndex(self.spark, f"{self.root}/bm25/company_id={check_tenant(company_id)}")
        now = self.store(company_id).versions.current() or "none"
        if kept.last() != now:
            log.info("index segment %s written", kept.sync(self._chunks(company_id), now), extra={"chunks": now})
        return kept.index()

    def ingest(self, config: TenantConfig) -> DataFrame:
        """Extract, chunk, embed and index every file that is new or changed; drop chunks of files that changed or went. Returns the run's summary."""
        with tenant_log(self.spark, config.company_id, "ingest"):
            return self._ingest(config)

    def _ingest(self, config: TenantConfig) -> DataFrame:
        tenant, spark = config.company_id, self.spark
        stores.get_company(self.registry(), tenant)
        files = stores.discover(spark, [(s.path, s.pattern) for s in config.sources if s.type == "pdf"])
        known = materialize(self.manifest(tenant), "manifest")
        listed = materialize(stores.file_digests(files).distinct(), "files")
        todo = materialize(manifest.needs_processing(listed, known, self.clean(tenant)), "todo")
        wanted = files.join(todo.select(F.col("source_path").alias("path")), "path", "left_semi").dropDuplicates(["path"])
        read = pdf.extract_best(wanted, self.parse, self.parse_chars)
        read = materialize(read.select(F.col("path").alias("doc_id"), "page", "text", "error", "extractor"), "pages")
        flagged = pages.page_flags(read.filter("error IS NULL"))
        scanned = pages.scanned_documents(flagged)
        good = scanned.filter(~F.col("is_scanned")).select("doc_id")
        named = pages.marked_document(flagged.join(good, "doc_id", "left_semi")).join(todo.select(F.col("source_path").alias("doc_id"), F.col("current_sha256").alias("file_sha256")), "doc_id")
        documents = materialize(named.withColumnRenamed("markdown", "text"), "documents")
        stores.write_clean(documents.select("file_sha256", F.col("text").alias("markdown")).dropDuplicates(["file_sha256"]), self._path(tenant, "clean"))
        c = config.chunking
        chunks = chunking.chunk_documents(documents, c.chunk_size, c.chunk_overlap, c.min_chunk_length).join(documents.select("doc_id", "file_sha256"), "doc_id")
        top = known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = chunks.select(
            chunk_id(F.col("file_sha256"), F.col("chunk_index")).alias("id"), F.transform(self.embed(F.col("text")), lambda x: x.cast("float")).alias("embedding"), F.col("text").alias("document"),
            F.col("doc_id").alias("source_path"), "page_number", "chunk_index", "is_code", "file_sha256", F.lit(top + 1).cast("long").alias("seq"),
        )
        made = materialize(rows, "chunks")
        store = self.store(tenant)
        old = store.rows()
        current = listed.select("source_path", F.col("current_sha256").alias("file_sha256"))
        store.replace(old.join(current, ["source_path", "file_sha256"], "left_semi").select(*old.columns))
        store.upsert(made)
        entries = self._entries(tenant, todo, read, scanned, made)
        stores.append_manifest(stores.next_seq(known, entries), self._path(tenant, "manifest"))
        self.index(tenant)
        self._save(stores.update_stats(self.registry(), manifest.tenant_stats(self.manifest(tenant)), datetime.now(UTC).isoformat()))
        return manifest.ingest_summary(entries)

    def _entries(self, tenant: str, todo: DataFrame, read: DataFrame, scanned: DataFrame, chunks: DataFrame) -> DataFrame:
        errors = read.filter("error IS NOT NULL").groupBy(F.col("doc_id").alias("source_path")).agg(F.first("error").alias("error"))
        used = read.groupBy(F.col("doc_id").alias("source_path")).agg(F.max("extractor").alias("extractor_used"))
        counts = chunks.groupBy("source_path").agg(F.count("*").cast("int").alias("chunk_count"))
        joined = todo.join(errors, "source_path", "left").join(scanned.withColumnRenamed("doc_id", "source_path"), "source_path", "left").join(counts, "source_path", "left").join(used, "source_path", "left")
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("is_scanned"), "skipped_scanned").otherwise("ok")
        clean = F.when(status == "ok", F.concat(F.lit("clean/"), "current_sha256", F.lit(".md")))
        return materialize(joined.select(
            "source_path", F.col("current_sha256").alias("file_sha256"), clean.alias("clean_path"), F.lit(tenant).alias("company_id"), status.alias("status"), "error",
            F.col("page_count").cast("int").alias("page_count"), F.when(status == "ok", F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"), "extractor_used",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("processed_at"),
        ), "entries")

    # --- questions and checks

    def pipeline(self, config: TenantConfig, **kw) -> QAPipeline:
        rows = self.store(config.company_id).rows()
        documents = rows.select(F.col("id").alias("doc_id"), F.col("document").alias("text"), "source_path", "page_number", "is_code")
        r = config.retrieval
        retriever = HybridRetriever(documents, rows.select(F.col("id").alias("doc_id"), "embedding", "source_path", "page_number", "is_code"), r.top_k, r.top_k, r.rerank_top_k, r.rrf_k, r.use_bm25, self.index(config.company_id) if r.use_bm25 else None)
        return QAPipeline(retriever, **({} if r.use_reranker else {"score": None}), rerank_top_k=r.rerank_top_k, max_score_gap=r.max_score_gap, **{"embed": self.embed, **kw})

    def questions(self, config: TenantConfig, asked: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
        return rows.withColumn("embedding", self.embed(query_text(F.col("text"), config.embedding.model)))

    def ask(self, config: TenantConfig, questions: DataFrame, messages: DataFrame | None = None, cache: AnswerCache | None = None, **kw) -> DataFrame:
        """Answers to questions (item_id, text, embedding); with ``messages`` (see QAPipeline.answer) follow-ups are understood.

        ``cache`` serves and keeps answers to questions without history; those with one depend on their conversation and pass it by.
        """
        plan = self.pipeline(config, **kw)
        with tenant_log(self.spark, config.company_id, "ask"):
            if cache is None:
                return plan.answer(questions, messages=messages)
            return cache.answered(config.company_id, questions, messages, lambda asked, told: plan.answer(asked, messages=told))

    def compare(self, configs: list[TenantConfig], asked: list[str], log_to: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(company_id, item_id, answer, citations) of each tenant's own retrieval; and ``log_to``, a history, with the answers added.

        A plan for each named tenant; there are tens of them.
        """
        found = None
        for config in configs:
            one = self.ask(config, self.questions(config, asked)).select(F.lit(config.company_id).alias("company_id"), "item_id", "answer", "citations")
            found = one if found is None else found.unionByName(one)
        found = materialize(found, "compared")
        if log_to is None:
            return found, None
        texts = self.spark.createDataFrame(list(enumerate(asked)), "item_id long, question string")
        said = found.join(texts, "item_id").select("company_id", "question", "answer", F.transform("citations", lambda c: F.struct(c["marker"].alias("marker"), c["source_path"].alias("source"))).alias("citations"), F.current_timestamp().alias("created_at"))
        return found, history.append(log_to, said)

    def audit(self, config: TenantConfig) -> DataFrame:
        files = stores.discover(self.spark, [(s.path, s.pattern) for s in config.sources])
        return manifest.audit(self.manifest(config.company_id), stores.file_digests(files).distinct(), self.clean(config.company_id))

    def reset(self, company_id: str) -> None:
        """Forget everything but the raw files."""
        for name in ("clean", "manifest"):
            self._remove(self._path(company_id, name))
        self._remove(f"{self.root}/bm25/company_id={check_tenant(company_id)}")
        self.store(company_id).wipe()
