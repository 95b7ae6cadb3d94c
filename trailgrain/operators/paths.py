"""Paths of events in time order, as rows (path, position, edge_id), and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut


def next_events(edges: DataFrame) -> DataFrame:
    """For each event the first one that leaves its target strictly later: (edge_id, next)."""
    w = Window.partitionBy("node").orderBy(F.desc("timestamp_ns")).rangeBetween(Window.unboundedPreceding, -1)
    out = edges.select(F.col("src").alias("node"), "timestamp_ns", F.struct("timestamp_ns", "edge_id").alias("leaves"), F.lit(None).cast("long").alias("asks"))
    ask = edges.select(F.col("dst").alias("node"), "timestamp_ns", F.lit(None).cast(out.schema["leaves"].dataType).alias("leaves"), F.col("edge_id").alias("asks"))
    after = out.union(ask).withColumn("next", F.min("leaves").over(w)).where("asks is not null and next is not null")
    return after.select(F.col("asks").alias("edge_id"), F.col("next.edge_id").alias("next"))


def chains(edges: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Paths of `length` events at most from the starts (edge_id), each event followed by the next one: (path, position, edge_id)."""
    after = cut(next_events(edges))
    at = starts.select(F.col("edge_id").alias("path"), F.lit(0).alias("position"), "edge_id")
    found = at
    for k in range(1, length):
        at = at.join(after, "edge_id").select("path", F.lit(k).alias("position"), F.col("next").alias("edge_id"))
        found = found.unionByName(at)
    return cut(found)


def whole(paths: DataFrame, kept: DataFrame) -> DataFrame:
    """Whether all events of each path are kept (edge_id): (path, events, retained)."""
    flags = paths.join(kept.select("edge_id", F.lit(True).alias("kept")), "edge_id", "left")
    return flags.groupBy("path").agg(F.count("*").alias("events"), F.bool_and(F.coalesce("kept", F.lit(False))).alias("retained"))


def regularity(paths: DataFrame, values: DataFrame, excluded: Column, decay: float = 1.0) -> DataFrame:
    """Geometric mean of the events' regularity (edge_id, regularity) without the excluded ones, decayed: (path, regularity, anomaly)."""
    rows = paths.join(values, "edge_id").groupBy("path").agg(F.avg(F.when(~excluded, F.log("regularity"))).alias("m"))
    value = F.coalesce(F.least(F.lit(1.0), F.exp("m") * decay), F.lit(1.0))
    return rows.select("path", value.alias("regularity"), (1 - value).alias("anomaly"))
