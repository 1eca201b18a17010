"""Queries and oracle SQL of the engine's own operators."""

from __future__ import annotations

from larkspan.plans import evaluation, events, relational, text, vectors

_PLANS = (text, events, vectors, relational, evaluation)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in _PLANS for k, v in p.ORACLE_SQL.items()}
