"""All queries of the subpackage, gathered from its query modules."""

from __future__ import annotations

import importlib

MODULES = ("lookalike_queries", "termfreq_queries", "neighbour_queries", "chunking_queries", "packing_queries", "mixing_queries", "sentence_queries")

_loaded = [importlib.import_module(f"loomline.llm.{name}") for name in MODULES]
QUERIES = {name: query for module in _loaded for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _loaded for name, sql in module.ORACLES.items()}
