"""Command line: python -m tessera --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera import runtime
from tessera.operators import links, manifest
from tessera.plans.workspace import Workspace
from tessera.sources.config import tenant_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default="data")
    top.add_argument("--configs", default="configs")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "audit", "info"):
        commands.add_parser(name).add_argument("--company", required=True)
    ask = commands.add_parser("query")
    ask.add_argument("--company", required=True)
    ask.add_argument("--query", required=True, action="append")
    ask.add_argument("--top-k", type=int, default=5)
    ask.add_argument("--no-llm", action="store_true")
    commands.add_parser("list")
    add = commands.add_parser("add")
    add.add_argument("company")
    add.add_argument("--name", required=True)
    remove = commands.add_parser("remove")
    remove.add_argument("company")
    remove.add_argument("--delete-data", action="store_true")
    reset = commands.add_parser("reset")
    reset.add_argument("--company", required=True)
    reset.add_argument("--yes", action="store_true")
    crawl = commands.add_parser("crawl")
    crawl.add_argument("--pages", required=True, help="Parquet of fetched pages (page_id, url, html)")
    crawl.add_argument("--url", required=True)
    crawl.add_argument("--prefix", default="")
    crawl.add_argument("--max-pages", type=int, default=100)
    crawl.add_argument("--concurrency", type=int, default=3)
    return top


def main(argv: list[str] | None = None, workspace: Workspace | None = None) -> int:
    args = parser().parse_args(argv)
    spark = workspace.spark if workspace else runtime.session("local[*]")
    runtime.ship(spark)
    w = workspace or Workspace(spark, args.root)
    company = getattr(args, "company", None)
    config = lambda: tenant_config(f"{args.configs}/{company}.yaml", company, f"{args.configs}/template.yaml", f"{args.root}/companies")
    if args.command == "ingest":
        rows = w.ingest(config()).collect()
        for r in rows:
            print(f"{r['status']}: {r['n']} files, {r['chunks']} chunks")
        return int(any(r["failed"] for r in rows))
    if args.command == "query":
        settings = config()
        settings.retrieval.rerank_top_k = args.top_k
        if not w.store(company).count():
            print("nothing is indexed", file=sys.stderr)
            return 1
        asked, plan = w.questions(settings, args.query), w.pipeline(settings)
        if args.no_llm:
            for r in plan.retriever.search(asked).join(plan.retriever.documents, "doc_id").orderBy("item_id", "rank").collect():
                print(f"[{r['rank']}] {r['source_path']} page {r['page_number'] or '-'} ({r['rrf_score']:.4f}) {r['text'][:200]}")
        else:
            for r in plan.answer(asked).orderBy("item_id").collect():
                print(r["answer"], *(f"[{c['marker']}] {c['source_path']} page {c['page_number'] or '-'}" for c in r["citations"] or []), sep="\n")
        return 0
    if args.command == "audit":
        audited = w.audit(config())
        for r in audited.filter("outcome <> 'OK'").orderBy("outcome", "source_path").toLocalIterator():
            print(f"[{r['outcome']}] {r['source_path']}")
        counts = manifest.audit_counts(audited).collect()
        for r in counts:
            print(f"{r['outcome']:20s} {r['n']}")
        return int(any(r["is_failure"] and r["n"] for r in counts))
    if args.command in ("list", "info"):
        (manifest.registry_list(w.registry()).orderBy("company_id") if args.command == "list" else w.info(company)).show(truncate=False)
    elif args.command == "add":
        w.add(company, args.name)
    elif args.command == "remove":
        w.remove(company, args.delete_data)
    elif args.command == "reset":
        if not args.yes and input(f"forget what was made of {company}'s files? [y/N] ").lower() != "y":
            return 1
        w.reset(company)
    elif args.command == "crawl":
        pages = spark.read.parquet(args.pages)
        page = F.regexp_replace("url", "/+$", "").alias("url")
        found = links.extract_links(pages, args.prefix).select(page, "at", "link")
        start = spark.createDataFrame([(args.url.rstrip("/"),)], "url string")
        for r in links.crawl_order(start, found, pages.select(page), args.max_pages, args.concurrency).filter("saved").orderBy("position").toLocalIterator():
            print(r["depth"], r["url"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
