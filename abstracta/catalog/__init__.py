"""Every operator as a query over the driver tables, with its SQL counterpart."""

from __future__ import annotations

from abstracta.catalog import cleaning, exporting, harvesting, indexing, searching, sourcing, statistics  # noqa: F401
from abstracta.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
