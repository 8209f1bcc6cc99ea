"""All catalogue entries in one place."""

from __future__ import annotations

from tilewright.plans import queries_geometry, queries_metrics, queries_models, queries_pixels, queries_tables, queries_workflows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _part in (queries_metrics, queries_tables, queries_geometry, queries_models, queries_pixels, queries_workflows):
    QUERIES.update(_part.query.queries)
    ORACLES.update(_part.query.oracles)
