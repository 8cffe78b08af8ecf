"""The queries of this subpackage, in the order of the operators."""

from __future__ import annotations

from urnspark.llm import align, audio, chat, lines, manifest, mixing, neardup, packing, quality, scoring, search, secrets, store

MODULES = (chat, scoring, secrets, packing, quality, neardup, store, lines, mixing, audio, search, manifest, align)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
