"""Registered queries, by family."""

from tidemark.plans.base import REGISTRY
from tidemark.plans import estimators, formats, geo, models, relational, spectral, trend, windows  # noqa: F401  (each registers its queries)

__all__ = ["REGISTRY"]
