"""Queries of this subpackage and their SQL, gathered from the operators' modules."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    import telar.llm as here

    return [importlib.import_module(f"telar.llm.{m.name}") for m in pkgutil.iter_modules(here.__path__) if m.name.startswith("op")]


def queries() -> dict:
    import corpus_pipeline

    return {k: v for m in _modules() for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: v for m in _modules() for k, v in m.ORACLES.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
