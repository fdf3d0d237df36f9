"""The queries over the reference tables, by name, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: list[str] = ["dedup", "fusion", "places", "ballots", "evidence", "planning", "reports", "fillin", "streams"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"mergeloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"mergeloom.plans.{m}").SQL.items()}
