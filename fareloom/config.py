"""Method choices. Checked on the driver; they pick the shape of the plan and never ride in closures."""

from __future__ import annotations

from dataclasses import dataclass

from .constants import ALLOWED_CURRENCIES, HORIZON_BUCKETS


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is not one of {sorted(map(str, allowed))}")


@dataclass(frozen=True)
class IndexConfig:
    """How quotes become route fares and route fares become an index."""

    base_period: str
    representative_method: str = "median"
    trimmed_mean_proportion: float = 0.1
    outlier_method: str = "iqr"
    outlier_iqr_multiplier: float = 1.5
    outlier_mad_threshold: float = 3.5
    outlier_percentile_bounds: tuple[float, float] = (0.01, 0.99)
    fare_field: str = "total_fare"
    booking_horizon_filter: str | None = None
    min_observations: int = 3
    aggregation_method: str = "arithmetic"

    def __post_init__(self) -> None:
        _one_of("representative_method", self.representative_method, ("median", "mean", "trimmed_mean"))
        _one_of("outlier_method", self.outlier_method, ("iqr", "mad", "percentile", "none"))
        _one_of("aggregation_method", self.aggregation_method, ("arithmetic", "geometric"))
        if self.booking_horizon_filter is not None:
            _one_of("booking_horizon_filter", self.booking_horizon_filter, [b[0] for b in HORIZON_BUCKETS])
        if not 0 <= self.trimmed_mean_proportion < 0.5:
            raise ValueError("trimmed_mean_proportion must lie in [0, 0.5)")
        if self.min_observations < 1:
            raise ValueError("min_observations must be at least 1")


@dataclass(frozen=True)
class VolatilityConfig:
    min_observations: int = 3
    low_below: float = 0.10
    high_above: float = 0.25


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of the batch grading."""

    allowed_currencies: tuple[str, ...] = ALLOWED_CURRENCIES
    strict_completeness: bool = False
    sanity_min_group: int = 5
    sanity_mad_multiplier: float = 6.0
    near_duplicate_tolerance: float = 0.01
    unusual_horizon_days: int = 330
    stale_after_days: int = 14
    degraded_validity_below: float = 0.85
    degraded_success_below: float = 0.80
    # Shares of the score: completeness, validity, duplicates, schema, source success.
    score_weights: tuple[float, float, float, float, float] = (0.25, 0.35, 0.15, 0.10, 0.15)
    grade_bands: tuple[tuple[float, str], ...] = ((95.0, "EXCELLENT"), (90.0, "GOOD"), (75.0, "WARNING"))

    def __post_init__(self) -> None:
        if self.sanity_min_group < 2:
            raise ValueError("sanity_min_group must be at least 2")
        if not 0 < self.near_duplicate_tolerance < 1:
            raise ValueError("near_duplicate_tolerance must lie in (0, 1)")
        if not self.allowed_currencies:
            raise ValueError("allowed_currencies is empty")
        if abs(sum(self.score_weights) - 1.0) > 1e-6:
            raise ValueError("score_weights must sum to 1")


@dataclass(frozen=True)
class MatchingConfig:
    """News matching: window, shares of the score, and what is shown."""

    date_window_days: int = 10
    min_relevance: float = 0.35
    top_n: int = 5
    significance_threshold_pct: float = 5.0
    weight_date: float = 0.25
    weight_airport: float = 0.25
    weight_route: float = 0.15
    weight_airline: float = 0.15
    weight_event: float = 0.10
    weight_geography: float = 0.10

    def __post_init__(self) -> None:
        if self.date_window_days <= 0:
            raise ValueError("date_window_days must be positive")
        if not 0.0 <= self.min_relevance <= 1.0:
            raise ValueError("min_relevance must lie in [0, 1]")
        if self.top_n < 1:
            raise ValueError("top_n must be at least 1")
