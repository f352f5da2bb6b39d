"""Settings of retrieval and tiers, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values of ranking, fusion and tiers.
    dense_k: int = 20
    lexical_k: int = 20
    fused_k: int = 3
    rrf_k: int = 60
    dense_weight: float = 1.0
    dense_weight_bare: float = 0.25
    lexical_weight: float = 1.0
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    min_score: float = 1.0
    expected_score: float = 3.5
    out_below: float = 0.35
    sure_from: float = 0.40
    sure_dense: float = 0.38
    gap: float = 0.03
    context_messages: int = 6
    context_chars: int = 6300
    recent_messages: int = 4
    retention_days: int = 30
    session_days: int = 30
    #: Rows of small columns that may be broadcast after a count.
    broadcast_rows: int = 200_000
    #: Bytes of texts in such columns.
    broadcast_bytes: int = 32_000_000
    #: Query vectors that are broadcast at a time: of 768 dimensions, 120 MB.
    broadcast_queries: int = 20_000


SETTINGS = Settings()
