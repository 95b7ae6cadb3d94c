"""Ingest: node upsert, placeholders, idempotent events and the wide edge view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(nodes: DataFrame, order: str) -> DataFrame:
    """One row for each uuid: the last type, and the last non-empty value of every other column in ingest order."""
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col(order)))
    return nodes.groupBy("uuid").agg(F.max_by("node_type", order).alias("node_type"), *[F.coalesce(last(c), F.lit("")).alias(c) for c in ("label", "host", "semantic_key")])


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and, for ends that nothing declared, nodes of type unknown that are named by their uuid."""
    ends = edges.select(F.col("src").alias("uuid")).union(edges.select("dst")).distinct()
    missing = ends.join(nodes.select("uuid"), "uuid", "left_anti")
    return nodes.unionByName(missing.select("uuid", F.lit("unknown").alias("node_type"), F.col("uuid").alias("label"), F.lit("").alias("host"), F.col("uuid").alias("semantic_key")))


def deduplicated(edges: DataFrame) -> DataFrame:
    """Equal events once; different events of one id keep it for the first (by content) and get a digest after it otherwise."""
    identity = ("event_id", "src", "dst", "relation", "timestamp_ns", "host")
    once = edges.dropDuplicates([*identity])
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in identity]), 256), 1, 16)
    first = once.groupBy("event_id").agg(F.min(F.struct("timestamp_ns", digest.alias("d"))).alias("first"))
    named = once.join(first, "event_id").withColumn("original_event_id", F.col("event_id"))
    return named.withColumn("event_id", F.when(digest == F.col("first.d"), F.col("event_id")).otherwise(F.concat("event_id", F.lit("#"), digest))).drop("first")


def wide(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with type and semantic key of both ends; unknown where a node is missing."""
    out = edges
    for end in ("src", "dst"):
        side = nodes.select(F.col("uuid").alias(end), F.col("node_type").alias(f"{end}_type"), F.col("semantic_key").alias(f"{end}_semantic"))
        out = out.join(side, end, "left").withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit("unknown"))).withColumn(f"{end}_semantic", F.coalesce(f"{end}_semantic", end))
    return out
