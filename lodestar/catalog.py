"""All registered queries and the SQL that computes the same rows."""

from __future__ import annotations

from lodestar.queries import control, pages, results, sources, stateful, texts  # isort: skip
from lodestar.queries import rules  # isort: skip  last, as it takes the place of queries over cases
from lodestar.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "control", "pages", "results", "rules", "sources", "stateful", "texts"]
