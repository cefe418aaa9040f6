"""Every query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from quire.plans import caches, judging, lookups, relational, rules, scalars, statements, summaries, texts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for part in (relational, summaries, scalars, rules, texts, judging, lookups, statements, caches):
    QUERIES |= part.REGISTRY.queries
    ORACLE |= part.REGISTRY.oracle
