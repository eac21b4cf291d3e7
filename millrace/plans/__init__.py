"""Queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from millrace.plans import checks, masks, more, moves
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "flagship", "masks", "more", "moves"]


def flagship(spark, sf_dir: str):
    return QUERIES["flagship_masked_customers"](spark, sf_dir)
