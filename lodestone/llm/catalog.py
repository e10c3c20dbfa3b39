"""The queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import queries as q
from lodestone.llm import sql

QUERIES = {n: f for n, f in vars(q).items() if n.startswith("op")}
ORACLES: dict[str, str] = {n: s for n, s in vars(sql).items() if n.startswith("op")}
