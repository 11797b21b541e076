"""Registered queries and their oracle SQL, collected from the area modules."""

from __future__ import annotations

from importlib import import_module

AREAS = ["risk", "features", "ingest", "regimes", "strategies", "models", "given", "records", "resample"]


def _collect(what: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out |= getattr(import_module(f"{__name__}.{area}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
