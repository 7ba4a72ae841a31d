"""Price index analytics for fare quotes on Spark."""

from .config import IndexConfig, MatchingConfig, QualityConfig, VolatilityConfig
from .plans.price_index import PriceIndex
from .session import build_session, stage, tune

__all__ = [
    "IndexConfig",
    "MatchingConfig",
    "PriceIndex",
    "QualityConfig",
    "VolatilityConfig",
    "build_session",
    "stage",
    "tune",
]
