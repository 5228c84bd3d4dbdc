"""Registered queries of the library's own operators, each with the SQL that checks it."""

from __future__ import annotations

import importlib

#: Modules of telar.plans that register queries: QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES = ["viability", "prices", "corpus", "stack", "schedule", "questions", "graphs"]


def _gather(attr: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"telar.plans.{m}"), attr).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
