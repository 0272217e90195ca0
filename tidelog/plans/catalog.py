"""All registered queries and their checking SQL, without those of the subpackage ``llm``."""

from __future__ import annotations

from tidelog.plans import problems, queries

QUERIES = {**queries.QUERIES, **problems.QUERIES}
ORACLES = {**queries.ORACLES, **problems.ORACLES}
