"""All queries over the engine's own operators, with their SQL."""

from __future__ import annotations

from quadrat.plans import agreement, aggregates, diagnosis, projections, sampling, selection, similarity, statistics, streams, validation, windows  # noqa: F401
from quadrat.plans.panels import REGISTRY, Panels, full_sql


def _bound(f):
    return lambda spark, sf_dir: f(Panels(spark, sf_dir))


def queries() -> dict:
    return {name: _bound(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: full_sql(sql) for name, (_, sql) in REGISTRY.items() if sql}
