"""Registered queries over the event graph and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailgrain.sources.driver_tables import EDGES_SQL, event_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def edge_query(sql: str | None) -> Callable:
    """Register a function of the edge table under its name; sql goes on after the common tables `edges` and `nodes`."""
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(event_edges(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = EDGES_SQL + sql
        return f

    return register


def table_query(sql: str | None) -> Callable:
    """Register a function of (spark, sf_dir)."""
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from trailgrain.plans import alternatives, behaviours, continuations, diffusion, evaluation, expansions, features, graphs, ingests, ledgers, lineages, lookups, metrics, pages, profiles, prunings, ranking, removals, scores, selectors, verifications, windows  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
