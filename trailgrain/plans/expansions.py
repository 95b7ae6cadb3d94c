"""Queries: what explains the points of interest and what they lead to. The order of the frontier is sequential, so there is no SQL; tests hold it against a heap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import expansion as X
from trailgrain.operators.graph import cut
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import pois, rounded_rarity

#: Of the made-up table, whose rarities lie close together: hours in place of minutes, and thresholds among its values.
POLICY = X.Search(min_edge=0.2, min_path=0.25, min_frontier=0.15, window_s=6 * 3600.0, half_life_s=12 * 3600.0, batch=1024)


def context(edges: DataFrame) -> tuple[DataFrame, X.Context]:
    rated = cut(rounded_rarity(edges).withColumn("anomaly", F.col("rarity")))
    return rated, X.contexts(rated, pois(rated), POLICY, E.backward_anchor(), E.forward_anchor())


@edge_query(None)
def causal_context(edges: DataFrame) -> DataFrame:
    """The events of each point of interest's context: (alert, edge_id)."""
    return context(edges)[1].events


@edge_query(None)
def causal_cone(edges: DataFrame) -> DataFrame:
    """The same backward only, and forward from each process that the backward ways start."""
    rated = cut(rounded_rarity(edges).withColumn("anomaly", F.col("rarity")))
    return X.contexts(rated, pois(rated), POLICY, E.backward_anchor(), None, cone=True).events


@edge_query(None)
def causal_reasons(edges: DataFrame) -> DataFrame:
    """Why states ended, and how often windows grew: (alert, reason, n)."""
    return context(edges)[1].reasons


@edge_query(None)
def causal_paths(edges: DataFrame) -> DataFrame:
    """Simple paths through each point of interest: (alert, path)."""
    rated, found = context(edges)
    return X.evidence_paths(rated, found).select("alert", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@edge_query(None)
def cumulative_contexts(edges: DataFrame) -> DataFrame:
    """Forward contexts of groups of points of interest, a group a day, in time order: (group, at, new, overlap, cumulative)."""
    rated = cut(rounded_rarity(edges).withColumn("anomaly", F.col("rarity")))
    found = X.contexts(rated, pois(rated), POLICY, None, F.col("dst"))
    groups = pois(rated).select(F.col("edge_id").alias("alert"), F.col("day").cast("string").alias("group"), F.col("timestamp_ns").alias("at"))
    return X.cumulative(found, groups)
