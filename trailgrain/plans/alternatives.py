"""Queries: up to three alternative forks of each event, and faults of their witnesses. Labels come round by round, so there is no SQL; tests hold them against a table kept in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import alternatives as A
from trailgrain.operators import graph as G
from trailgrain.operators.graph import cut
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import pois


def labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = edges.select("edge_id", "src", "dst", F.col("timestamp_ns").alias("t"))
    back = cut(G.temporal_routes(edges, pois(edges), True).select("edge_id", "depth", F.col("parent").alias("next")))
    return events, back, cut(A.fork_labels(events, back))


@edge_query(None)
def alternative_forks(edges: DataFrame) -> DataFrame:
    """(edge_id, slot, depth, parent, parent_slot, pivot)."""
    return labelled(edges)[2]


@edge_query(None)
def alternative_witnesses(edges: DataFrame) -> DataFrame:
    """The distinct witnesses of all events: (anchor, slot, part, position, edge_id)."""
    _, back, labels = labelled(edges)
    return A.witnesses(labels, back)


@edge_query(None)
def witness_chain_faults(edges: DataFrame) -> DataFrame:
    """Faults of these witnesses, and of the same with the pivots of every fiftieth anchor replaced by an event that does not link: (witnesses, fault, rows)."""
    events, back, labels = labelled(edges)
    rows = cut(A.witnesses(labels, back))
    planted = (F.col("anchor") % 50 == 0) & (F.col("part") == "back") & (F.col("position") == 0)
    broken = rows.withColumn("edge_id", F.when(planted, F.col("edge_id") + 1).otherwise(F.col("edge_id")))
    found = [A.witness_faults(r, events, pois(edges)).groupBy("fault").agg(F.count("*").alias("rows")).select(F.lit(n).alias("witnesses"), "fault", "rows") for n, r in (("own", rows), ("planted", broken))]
    return found[0].unionByName(found[1])
