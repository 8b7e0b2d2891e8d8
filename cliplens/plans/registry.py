"""All registered queries and their SQL."""

from __future__ import annotations

import functools
import importlib

PARTS = ["ingest", "features", "text", "retrieval", "vectors", "models", "streams"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in PARTS:
        found.update(getattr(importlib.import_module(f"cliplens.plans.{name}"), attribute))
    return found


def _in_utc(query):
    """Timestamps without a zone are read as UTC whatever the session was started with."""

    @functools.wraps(query)
    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def queries() -> dict:
    return {name: _in_utc(query) for name, query in _collect("QUERIES").items()}


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
