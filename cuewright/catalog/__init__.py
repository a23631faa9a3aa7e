"""All registered queries."""

import importlib

from cuewright.catalog.registry import ORACLES, QUERIES, full_sql

for _module in ("q_text", "q_sequence", "q_timing", "q_translation", "q_retrieval", "q_state", "sql_folds"):
    importlib.import_module(f"cuewright.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES", "full_sql"]
