"""The queries of this package and the SQL that some of them are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["packing", "url_filters", "fingerprints", "pii", "jaccard", "toxicity", "language", "decontamination", "quality", "licenses"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"mergeloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"mergeloom.llm.{m}").SQL.items()}
