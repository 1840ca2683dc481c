"""Every registered query of the scan engine with the SQL that it is held against."""

from __future__ import annotations

from platen.plans import classic, edges, events, layout, masks, pixels, proposals, scale  # noqa: F401
from platen.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
