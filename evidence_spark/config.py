"""Thresholds and weights. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualityWeights:
    parse: float = 0.25
    schema: float = 0.25
    evidence: float = 0.30
    novelty: float = 0.10
    penalty: float = 0.10


@dataclass(frozen=True)
class Config:
    weights: QualityWeights = field(default_factory=QualityWeights)
    grade_scores: tuple[tuple[str, float], ...] = (("A", 1.0), ("B", 0.8), ("C", 0.4))
    conflict_penalty: float = 0.3
    mechanism_penalty: float = 0.3
    chart_penalty: float = 0.2
    low_quality: float = 0.5
    relative_tolerance: float = 0.05
    absolute_tolerance: float = 1e-9
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    coarse_top_k: int = 20
    fine_top_k: int = 10
    first_depth: int = 50
    deepest: int = 102_400
    min_support: float = 0.3
    excerpt: int = 240


DEFAULT = Config()

#: Wire values, weakest first.
CONFIDENCE = ("hypothesis", "medium", "high", "verified")
NUMERIC_TYPES = ("number", "range")
TEXT_TYPES = ("enum", "text")
VALUE_TYPES = ("number", "range", "enum", "text", "formula")
CLAIM_TYPES = ("measurement", "relation", "method", "rule", "mechanism")
ORIGINS = ("primary", "secondary")
GRADES = ("A", "B", "C", "D", "E")
EVIDENCE_TYPES = ("literature", "graph", "simulation", "experiment")
HIDDEN_STATES = ("retracted", "archived", "superseded")
