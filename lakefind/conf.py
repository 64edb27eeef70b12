"""Every tunable of the engine, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 2
    candidate_pool: int = 200
    rerank_candidates: int = 50
    text_limit: int = 2000
    line_search_back: int = 300
    fold_window: int = 4
    high: float = 0.75
    warn: float = 0.30
    drop: float = 0.0
    cap_per_file: int = 3
    backfill_chars: int = 300
    chunk_chars: int = 600
    tiny_chars: int = 60
    soft: float = 1.25
    tbd_ratio: float = 0.1
    semantic_threshold: float = 0.62
    semantic_per_node: int = 4
    hubs: int = 5
    page_gap: int = 2


CONF = EngineConf()
