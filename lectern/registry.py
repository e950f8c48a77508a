"""Every registered query of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from lectern.plans import activity, business, corpus, exams, joins, keeping, lookups, reviewing, retrieval, streams

PARTS = (retrieval, business, activity, corpus, exams, joins, keeping, lookups, reviewing, streams)
QUERIES: dict[str, Callable] = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "ranked_search"
