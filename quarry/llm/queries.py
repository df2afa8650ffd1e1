"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("mixing", "webp", "warc", "simhash", "pii", "token_counts", "bpe", "html", "quality", "suffix_dedup")
_LOADED = [import_module(f"quarry.llm.{m}") for m in _MODULES]
QUERIES = {name: query for m in _LOADED for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _LOADED for name, sql in m.ORACLE.items()}
