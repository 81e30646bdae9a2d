"""Named queries over the driver's tables."""

from recurra.plans import audits, base, diagnostics, features, forecasts, more, outcomes, search, studies  # noqa: F401
from recurra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
