"""Names, plans and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: put a plan, and its SQL where it has one, under a name."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def _load() -> None:
    from canopyrank.plans import assessment_plans, baseline_plans, construction_plans, evaluation, fusion_plans, leaderboard_plans, proposal_plans, rating_plans, record_plans, region_plans, routing, scalar_plans, scheduler_plans, snapshot_plans, taxonomy_plans, tournament_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
