"""Queries of the package and the SQL that tests them, gathered from its modules.

The modules are imported here and not when queries are asked for, so that a missing library leaves out the package only.
"""

from __future__ import annotations

from tabularium.llm import fusing, leakage, lookalikes, near_duplicates, neighbours, packing, repetition, scans, site_lines, splitting

MODULES = (splitting, fusing, site_lines, repetition, leakage, near_duplicates, packing, neighbours, lookalikes, scans)


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, name, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
