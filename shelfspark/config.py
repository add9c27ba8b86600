"""Tunable parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 200
    overlap: int = 50
    stride: int = 100
    min_size: int = 30

    def __post_init__(self) -> None:
        if not (self.size > 0 and 0 <= self.overlap < self.size and 0 < self.stride <= self.size):
            raise ValueError(f"inconsistent chunk parameters: {self}")


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    n_rerank: int = 7
    rrf_k: int = 60
    candidate_mult: int = 3
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    rerank_chars: int = 192
    block_below: float = 0.003
    warn_below: float = 0.006
    pool_max: int = 1000
    pool_rerank: int = 60
    context_chars: int = 800


@dataclass(frozen=True)
class MemoryConfig:
    window: int = 5
    message_chars: int = 5000
    token_limit: int = 20_000
    trigger_ratio: float = 0.75
    chars_per_token: float = 3.0
    min_turns: int = 1
    top_k: int = 5
    context_chars: int = 800


EVAL_KS = (1, 3, 5, 10)
