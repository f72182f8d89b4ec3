"""Name -> (Spark query, SQL that checks it). Modules of quern.plans register here; the entry point reads it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "q1_hybrid_search"
MODULES = ["q_retrieval", "q_analytics", "q_evaluation", "q_ingest", "q_functions", "q_streaming", "q_runs", "q_governance"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a query and, where SQL can express it, the SQL with the same result."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quern.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
