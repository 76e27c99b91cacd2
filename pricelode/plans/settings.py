"""Job settings with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.lifecycle import RecheckTiers


@dataclass(frozen=True)
class Settings:
    window_days: int = 90
    half_life_days: float = 21
    minimum_observations: int = 5
    estimator: str = "weighted_median"
    minimum_discount_percent: float = 10.0
    confidence_threshold: float = 0.9
    review_threshold: float = 0.9
    maximum_price: int | None = None
    overlap_pages: int = 1
    record_limit: int | None = None
    model: str = "default"
    effort: str = "medium"
    classifier_version: str = "v1"
    wide_products: bool = False
    tiers: RecheckTiers = field(default_factory=RecheckTiers)

    def estimation(self) -> dict[str, object]:
        return {"window_days": self.window_days, "half_life_days": self.half_life_days,
                "minimum_observations": self.minimum_observations,
                "estimator": self.estimator, "wide_products": self.wide_products}
