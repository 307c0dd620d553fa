"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ("text_geo", "merging", "search", "batch", "ordered", "changing", "analytics", "pages", "catalog")


def _registries():
    return [importlib.import_module(f"vicinia.plans.{m}").query for m in MODULES]


def queries() -> dict:
    return {k: v for r in _registries() for k, v in r.queries.items()}


def oracle_sql() -> dict:
    return {k: v for r in _registries() for k, v in r.oracles.items()}
