"""Registered queries over the given tables, and independent SQL for them."""

from __future__ import annotations

from . import detection, preparation, reporting
from .reporting import flagship

QUERIES = {**reporting.QUERIES, **detection.QUERIES, **preparation.QUERIES}
ORACLES = {**reporting.ORACLES, **detection.ORACLES, **preparation.ORACLES}

__all__ = ["ORACLES", "QUERIES", "flagship"]
