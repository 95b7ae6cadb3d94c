"""Queries: progressive removal of atomic groups under a budget. The order is sequential, so there is no SQL; tests hold it against one removal after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import removal as R
from trailgrain.operators import sessions as S
from trailgrain.operators.graph import cut
from trailgrain.operators.paths import next_events
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, pois, rounded_rarity

KEEP = 5  # one of so many events may stay


def removal(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their group, and the audit: bursts of one dependency within an hour are atomic, and an event's group needs that of the event after it."""
    rated = rounded_rarity(edges).join(pois(edges).select("edge_id", F.lit(True).alias("poi")), "edge_id", "left")
    bursts = S.bounded_episodes(edges, ["src", "dst", "relation"], HOUR).select("edge_id", "src", "dst", "relation", "start")
    group = bursts.groupBy("src", "dst", "relation", "start").agg(F.min("edge_id").alias("group")).join(bursts, ["src", "dst", "relation", "start"]).select("edge_id", "group")
    events = rated.join(group, "edge_id").select(
        "edge_id", "group", F.col("rarity").alias("score"), F.lit(0.0).alias("consistency"), F.concat_ws("|", "src_semantic", "relation", "dst_semantic").alias("redundancy"), F.lit(False).alias("previous"), F.coalesce("poi", F.lit(False)).alias("mandatory")
    )
    events = cut(events)
    own = events.select("edge_id", "group")
    after = next_events(edges).join(pois(edges).select(F.col("edge_id").alias("next")), "next")  # what leads straight to a point of interest needs it
    needs = after.join(own, "edge_id").withColumnRenamed("group", "dependent").join(own.select(F.col("edge_id").alias("next"), F.col("group").alias("required")), "next").where("dependent <> required")
    budget = edges.count() // KEEP
    return own, R.progressive(R.as_groups(events), cut(needs.select("dependent", "required").distinct()), budget)


@edge_query(None)
def progressive_removal(edges: DataFrame) -> DataFrame:
    """The events that stay: (edge_id)."""
    own, audit = removal(edges)
    return own.join(audit.where("kept").select("group"), "group").select("edge_id")


@edge_query(None)
def removal_audit(edges: DataFrame) -> DataFrame:
    """What was decided about each group: (group, cost, kept, utility, attempted, place, reason)."""
    return removal(edges)[1].withColumn("utility", F.round("utility", 9))
