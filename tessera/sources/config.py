"""Tenant configuration: YAML laid over a template, then checked."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from tessera.sources.vector_store import check_tenant


class ConfigError(ValueError):
    pass


@dataclass
class Chunking:
    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chunk_length: int = 100


@dataclass
class Embedding:
    model: str = "hash"
    device: str = "cpu"
    batch_size: int = 32


@dataclass
class Store:
    collection_name: str = ""


@dataclass
class Retrieval:
    top_k: int = 10
    rerank_top_k: int = 5
    use_bm25: bool = True
    use_reranker: bool = True
    rrf_k: int = 60
    max_score_gap: float | None = 6.0


@dataclass
class Source:
    path: str
    type: str = "pdf"
    pattern: str = "*.pdf"


@dataclass
class TenantConfig:
    company_id: str
    name: str
    sources: list[Source] = field(default_factory=list)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    vector_store: Store = field(default_factory=Store)
    retrieval: Retrieval = field(default_factory=Retrieval)


def load_yaml(path: str | Path) -> dict[str, Any]:
    try:
        found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: not a mapping")
    return found


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Mappings merge key by key; anything else of ``over`` replaces."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def _section(kind: type, given: Any, name: str) -> Any:
    if not isinstance(given, dict):
        raise ConfigError(f"{name}: not a mapping")
    known = {f.name for f in fields(kind)}
    try:
        return kind(**{k: v for k, v in given.items() if k in known})
    except TypeError as error:
        raise ConfigError(f"{name}: {error}") from error


def tenant_config(path: str | Path, company_id: str, template: str | Path | None = None, data_root: str = "data/companies") -> TenantConfig:
    """The configuration of ``company_id``: its file over the template, sources in its own folder where none are named."""
    check_tenant(company_id)
    own = load_yaml(path)
    merged = deep_merge(load_yaml(template), own) if template else own
    if "vector_store" not in merged:
        raise ConfigError(f"{path}: vector_store is missing")
    company = merged.get("company", {})
    if company.get("id") != company_id:
        raise ConfigError(f"{path}: is for {company.get('id')!r}, not {company_id!r}")
    named = own.get("sources") or [{"path": f"{data_root}/{company_id}/raw_pdfs"}]
    out = TenantConfig(company_id, company.get("name", company_id), [_section(Source, s, "sources") for s in named])
    for name, kind in (("chunking", Chunking), ("embedding", Embedding), ("vector_store", Store), ("retrieval", Retrieval)):
        setattr(out, name, _section(kind, merged.get(name, {}), name))
    if out.chunking.chunk_overlap >= out.chunking.chunk_size:
        raise ConfigError("chunking: the overlap must be smaller than the chunk size")
    return out
