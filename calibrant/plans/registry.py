"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

from calibrant.plans import evidence, joins, metrics, models, policies, reports, sources, states, training

MODULES = (states, evidence, metrics, joins, models, sources, policies, training, reports)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
