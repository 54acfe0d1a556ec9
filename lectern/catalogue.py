"""All registered queries of the question-bank engine with their oracle SQL."""

from __future__ import annotations

from lectern.plans import audit, bank, derived, grouping, relational, texts

_PLANS = (audit, relational, grouping, texts, derived, bank)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
