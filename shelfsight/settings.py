"""Parameters of retrieval, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """All knobs of a search; an invalid combination raises ValueError."""

    weights: dict[str, float] = field(default_factory=lambda: {"siglip": 0.35, "dino": 0.65})
    local_weight: float = 0.5
    global_weight: float = 0.0
    object_index_weight: float = 0.8
    patch_weight: float = 0.0
    tip_weight: float = 0.0
    secondary_weight: float = 0.0
    description_weight: float = 0.0
    proportion_weight: float = 0.0
    top_k: int = 5
    candidates: int = 50
    candidates_per_sku: int = 3
    rank_bias: int = 60
    ambiguity_margin: float = 0.05
    high: float = 0.85
    high_gap: float = 0.08
    medium: float = 0.70
    threshold: float | None = None
    patch_aggregation: str = "top_k"
    patch_top_k: int = 16
    patch_trim: float = 0.1

    def __post_init__(self) -> None:
        shares = {n: getattr(self, n) for n in ("local_weight", "global_weight", "object_index_weight", "patch_weight", "tip_weight", "description_weight")}
        bad = [n for n, v in shares.items() if not (math.isfinite(v) and 0 <= v <= 1)]
        bad += [n for n in ("secondary_weight", "proportion_weight") if not 0 <= getattr(self, n) < 0.5]
        if not self.weights or any(not math.isfinite(w) or w < 0 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 1e-6:
            bad.append("weights")
        if not 50 <= self.candidates <= 500:
            bad.append("candidates")
        if not 1 <= self.candidates_per_sku <= 50:
            bad.append("candidates_per_sku")
        if not 1 <= self.top_k <= 50:
            bad.append("top_k")
        if not (math.isfinite(self.rank_bias) and self.rank_bias >= 0):
            bad.append("rank_bias")
        if not 0 <= self.ambiguity_margin <= 2:
            bad.append("ambiguity_margin")
        if not (-1 <= self.medium <= self.high <= 1 and 0 <= self.high_gap <= 2):
            bad.append("high")
        if self.patch_aggregation not in ("top_k", "median", "trimmed_mean", "mean"):
            bad.append("patch_aggregation")
        if not 4 <= self.patch_top_k <= 256:
            bad.append("patch_top_k")
        if not 0 <= self.patch_trim < 0.5:
            bad.append("patch_trim")
        if bad:
            raise ValueError("invalid settings: " + ", ".join(bad))
