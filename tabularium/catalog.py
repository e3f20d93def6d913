"""Queries of the core and the SQL that tests them."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "knowledge", "documents", "streams")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"tabularium.plans.{m}"), name, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
