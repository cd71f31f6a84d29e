"""The queries of this subpackage, by name."""

from __future__ import annotations

from lodestar.llm import queries as q
from lodestar.llm import sql

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
ORACLES = sql.ORACLES
