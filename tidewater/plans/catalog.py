"""The queries of the engine's own operators, by name."""

from __future__ import annotations

from importlib import import_module

PARTS = ("warehouse", "inference", "marketing", "risk", "forecast", "extras", "served", "lifecycle")


def flagship(spark, sf_dir):
    """Governed channel summary over the daily mart."""
    from .warehouse import QUERIES

    return QUERIES["metric_summary"](spark, sf_dir)


def _all(name):
    found = {}
    for part in PARTS:
        found |= getattr(import_module(f"{__package__}.{part}"), name)
    return found


def queries():
    return _all("QUERIES")


def oracle_sql():
    return _all("ORACLE")
