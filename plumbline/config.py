"""All tunables in one place; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # The published parameter sheet.
    k_exact: int = 50
    k_lexical: int = 200
    k_dense: int = 200
    n_fuse: int = 50
    rrf_k: int = 60
    weights: dict[str, float] = field(default_factory=lambda: {"exact": 1.0, "intent_exact": 3.0, "lexical": 0.6, "dense": 0.8})
    agreement: float = 0.10
    floors: dict[str, float] = field(default_factory=dict)
    leaf_boost: float = 0.75
    sparse_below: int = 2
    decay: float = 0.95
    superseded: float = 0.4
    margin_high: float = 0.35
    other_asks: int = 2
    stop_pool: int = 3
    least_gain: float = 0.15
    rerank_k: int = 50
    max_turns: int = 10
    top_k: int = 10
    miss_turn: int = 11
    score_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    ask_plan: tuple[str, ...] = ("other", "other", "material", "color", "budget", "style", "feature", "use_case", "size")
    ask_attributes: tuple[str, ...] = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")
    ngram_max: int = 8
    least_category: int = 3
    semantic_fallback_threshold: int = 2
    semantic_cosine_floor: float = 0.45
    semantic_k: int = 8
    force_semantic: bool = False
    oov_token_ratio: float = 0.45
    bm25_k1: float = 1.5
    bm25_b: float = 0.75

    def weight(self, route: str) -> float:
        return self.weights.get(route, 1.0)


DEFAULT = Config()
