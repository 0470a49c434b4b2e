"""All registered queries."""

from . import holdings, imports, lookups, trades, upkeep, valuation  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
