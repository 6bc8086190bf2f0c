"""Query modules. Each has QUERIES (name -> callable(spark, sf_dir)) and ORACLES (name -> DuckDB SQL)."""

from __future__ import annotations

import importlib

MODULES = ("snapshot_queries", "text_queries", "history_queries", "search_queries", "index_queries")
FLAGSHIP = "bm25_search"


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]
