"""Constants of the retrieval pipeline; each one is a parameter with this default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    # fixed values the results depend on
    dense_weight: float = 4.0
    lexical_weight: float = 1.0
    rrf_k: int = 60
    candidates: int = 50
    top_k: int = 10
    docs_kept: int = 2
    code_kept: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    max_words: int = 500
    max_code_chars: int = 1500
    min_code_chars: int = 300
    dims: int = 64
