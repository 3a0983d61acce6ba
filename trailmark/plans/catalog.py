"""Every query by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in ("search", "reports", "integrity", "governance", "streaming", "stored"):
    _module = import_module(f"trailmark.plans.q_{_part}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

#: Rows of the survey that another row's query answers too.
SAME_QUERY = {"q_D2": "q_D1", "q_D3b": "q_D3", "q_D4": "q_D3", "q_L5": "q_P16_total", "q_U7": "q_C91"}
for _name, _other in SAME_QUERY.items():
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[_other], ORACLE_SQL[_other]
