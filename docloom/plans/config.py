"""Settings of the pipelines: nested dataclasses, read from dicts or YAML; unknown keys raise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Ingestion:
    max_file_mb: int = 200
    max_archive_mb: int = 4096
    max_archive_files: int = 5000
    include_hidden: bool = False


@dataclass
class Chunking:
    text_chunk_chars: int = 1800
    table_inline_max_chars: int = 6000
    table_preview_rows: int = 5
    table_preview_columns: int = 5
    visual_max_chars: int = 6000


@dataclass
class Retrieval:
    dense_model: str = "hashing-128"
    dense_query_instruction: str = ""
    dense_batch_size: int = 64
    dense_top_k: int = 30
    sparse_top_k: int = 30
    fused_top_k: int = 24
    rerank_top_k: int = 7
    rrf_k: int = 60
    reranker_enabled: bool = True
    entity_boost: bool = True
    max_variants: int = 2
    expand_relationships: bool = True
    max_related_blocks: int = 6
    neighbor_chunks: int = 1
    max_table_chars_in_context: int = 12000


@dataclass
class Generation:
    max_context_chars: int = 28000
    compute: bool = True


@dataclass
class Guardrails:
    enabled: bool = True
    min_rerank_score: float = 0.05
    min_rrf_score: float = 0.0
    mask_pii: bool = True


@dataclass
class PipelineConfig:
    work_dir: str = "work"
    buckets: int = 16
    ingestion: Ingestion = field(default_factory=Ingestion)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    guardrails: Guardrails = field(default_factory=Guardrails)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> PipelineConfig:
        return _merge(cls(), values)

    @classmethod
    def from_yaml(cls, path: str) -> PipelineConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _merge(target, values: dict[str, Any]):
    known = {f.name for f in fields(target)}
    for key, value in values.items():
        if key not in known:
            raise KeyError(f"unknown setting {key}")
        current = getattr(target, key)
        setattr(target, key, _merge(current, value) if is_dataclass(current) else type(current)(value))
    return target
