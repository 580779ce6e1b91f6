"""Tunable parameters with their fixed default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkParams:
    size: int = 1200
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", ", ", " ", "")
    sentences: int = 5
    overlap_sentences: int = 1
    qa_coverage: float = 0.6
    qa_min_pairs: int = 3
    qa_min_answer: int = 20
    qa_max_answer: int = 8000
    qa_min_leftover: int = 200


@dataclass(frozen=True)
class SearchParams:
    target: int = 12
    target_total: int = 20
    low_alpha: float = 0.55
    overfetch_low: int = 4
    overfetch_high: int = 3
    alpha_cap: float = 0.35
    ambiguous_words: int = 2
    literal_words: int = 4
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    # bytes of query-side data that are broadcast at once; more queries take more passes
    broadcast_bytes: int = 128 * 1024 * 1024


@dataclass(frozen=True)
class RankParams:
    cut_top_n: int = 30
    cut_delta: float = 0.08
    mmr_lambda: float = 0.6
    mmr_k: int = 15
    boost_per_match: float = 0.05
    boost_max: float = 0.2


@dataclass(frozen=True)
class JudgeParams:
    batch_size: int = 25
    max_batches: int | None = None
    excerpt_chars: int = 600
    keep: int = 8
    min_relevance: int = 7
    min_coverage: float = 0.6
    trust_score: float = 0.8
    safety_net: int = 3
    adjacency: int = 2


@dataclass(frozen=True)
class ExpandParams:
    budget_chars: int = 4000
    max_steps: int = 2
    score_threshold: float = 0.5
    max_per_step: int = 4
    score: float = 0.1
    ordered_steps: int = 4
    local_window: int = 2
    lane_window: int = 3
    list_top: int = 15


@dataclass(frozen=True)
class ContextParams:
    max_chars: int = 5000
    max_chunks: int = 8
    max_per_source: int = 3
    max_chunk_chars: int = 1000


@dataclass(frozen=True)
class CiteParams:
    min_words: int = 4
    max_words: int = 15
    span_min: int = 6
    span_max: int = 12


CHUNK = ChunkParams()
SEARCH = SearchParams()
RANK = RankParams()
JUDGE = JudgeParams()
EXPAND = ExpandParams()
CONTEXT = ContextParams()
CITE = CiteParams()
