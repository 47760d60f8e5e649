"""All registered queries with their oracle SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text_queries", "source_queries", "dedupe_queries", "store_queries", "delivery_queries", "evaluation_queries", "run_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _area in AREAS:
    _m = import_module(f"tamis.plans.{_area}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
