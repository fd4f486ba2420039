"""All tunables; every operator takes one EngineConfig, whose values become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from mnemos.functions import vocabulary as V


@dataclass(frozen=True)
class EngineConfig:
    # memory
    decay_lambda: float = 0.05
    promotion_threshold: float = 0.6
    recall_top_k: int = 8
    pinned_cap: int = 20
    min_score: float = 0.25
    min_score_no_lexical: float = 0.38
    pinned_boost: float = 0.05
    l1_max_items: int = 200
    extract_on_remember: bool = True
    auto_importance: bool = True
    vector_weight: float = 0.7
    decay_delete_threshold: float = 0.05
    # graph
    max_hops: int = 2
    extract_confidence: float = 0.5
    # feedback
    reflection_threshold: float = 0.7
    upvote_delta: float = 0.05
    downvote_delta: float = -0.1
    correct_creates_pinned: bool = True
    downvote_writes_negative: bool = True
    feedback_async: bool = False
    # embeddings
    embedding_dim: int = 256
    embedding_model: str = "hashing"
    # proactive
    alerts_enabled: bool = True
    recommend_enabled: bool = True
    alert_similarity: float = 0.35
    neighbor_k: int = 8
    scan_limit: int = 40
    alert_max_items: int = 3
    recommend_top_k: int = 3
    recommend_min_score: float = 0.2
    # consolidation
    scheduler_enabled: bool = False
    scheduler_hour: int = 3
    scheduler_minute: int = 0
    forget_threshold: float = 0.12
    cluster_min_size: int = 3
    cluster_similarity: float = 0.45
    cluster_overlap: float = 0.12
    max_clusters: int = 20
    # migration
    reembed_batch: int = 32
    # vocabularies
    stacks: dict[str, tuple[str, ...]] = field(default_factory=lambda: V.STACKS)
    topics: dict[str, tuple[str, ...]] = field(default_factory=lambda: V.TOPICS)
    databases: dict[str, tuple[str, ...]] = field(default_factory=lambda: {d: (d,) for d in V.DATABASES} | {"postgresql": ("postgres",)})
    languages: dict[str, tuple[str, ...]] = field(default_factory=lambda: V.LANGUAGES)
    conflict_negation: str = V.CONFLICT_NEGATION
    fact_patterns: tuple[str, ...] = V.FACT_PATTERNS
    chitchat_patterns: tuple[str, ...] = V.CHITCHAT_PATTERNS


DEFAULT = EngineConfig()
