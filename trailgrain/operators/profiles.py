"""Historical interaction profiles: daily cubes, frozen counts before a cutoff, activity and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.schema import DAY_NS

#: cube name: the columns it counts by
CUBES = {
    "event": ("day", "host", "src_semantic", "dst_semantic", "relation"),
    "src_rel": ("day", "host", "src_semantic", "relation"),
    "type_event": ("day", "host", "src_type", "dst_type", "relation"),
    "type_src_rel": ("day", "host", "src_type", "relation"),
    "relation": ("day", "relation"),
    "pattern": ("day", "src_type", "relation", "dst_type"),
}


def daily_cube(edges: DataFrame, name: str) -> DataFrame:
    return edges.groupBy(*CUBES[name]).agg(F.count("*").alias("event_count"))


def both_ends(edges: DataFrame, *columns: str) -> DataFrame:
    """A row for each end of each edge: uuid, node_type, semantic_key, direction (out at the source, in at the destination)."""
    end = lambda e, d: [F.col(e).alias("uuid"), F.col(f"{e}_type").alias("node_type"), F.col(f"{e}_semantic").alias("semantic_key"), F.lit(d).alias("direction")]
    return edges.select(*columns, *end("src", "out")).union(edges.select(*columns, *end("dst", "in")))


def entity_cube(edges: DataFrame) -> DataFrame:
    """Daily events of each entity and direction; the node type is part of the key."""
    return both_ends(edges, "day", "host").groupBy("day", "host", "semantic_key", "node_type", "direction").agg(F.count("*").alias("event_count"))


def first_seen_cohorts(edges: DataFrame) -> DataFrame:
    first = both_ends(edges, "day").groupBy("uuid", "node_type").agg(F.min("day").alias("first_day"))
    return first.groupBy("first_day", "node_type").agg(F.count("*").alias("node_count"))


def host_day_counts(edges: DataFrame, cutoff_ns: int, *keys: str) -> DataFrame:
    """How many (host, day) pairs saw a key before the cutoff; repeats within a host's day count once."""
    seen = edges.where(F.col("timestamp_ns") < cutoff_ns).select(*keys, "host", "day").distinct()
    return seen.groupBy(*keys).agg(F.count("*").alias("host_days"))


def active_days(edges: DataFrame, cutoff_ns: int) -> DataFrame:
    """Distinct days on which each entity was a source or a destination before the cutoff."""
    before = both_ends(edges.where(F.col("timestamp_ns") < cutoff_ns), "day")
    return before.groupBy("semantic_key", "direction").agg(F.countDistinct("day").alias("active_days"))


def completed_day_counts(edges: DataFrame, cutoff_ns: int) -> DataFrame:
    """Active host-days of each entity from the cube's completed days only; unlike active_days, hosts count separately."""
    cube = entity_cube(edges).where(F.col("day") < cutoff_ns // DAY_NS)
    return cube.groupBy("semantic_key", "direction").agg(F.count("*").alias("active_host_days"), F.sum("event_count").alias("events"))


def type_frequencies(edges: DataFrame) -> DataFrame:
    """Counts of node types (distinct nodes), relations and patterns, in one long table."""
    nodes = both_ends(edges).groupBy("node_type").agg(F.countDistinct("uuid").alias("n"))
    relations = edges.groupBy("relation").agg(F.count("*").alias("n"))
    patterns = edges.groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("n"))
    return (
        nodes.select(F.lit("node_type").alias("kind"), F.col("node_type").alias("key"), "n")
        .union(relations.select(F.lit("relation"), "relation", "n"))
        .union(patterns.select(F.lit("pattern"), F.concat_ws("|", "src_type", "relation", "dst_type"), "n"))
    )


def occupancy(edges: DataFrame, start_ns: int, end_ns: int, bucket_ns: int) -> DataFrame:
    """Distinct time buckets of each channel in a half-open window."""
    inside = edges.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns))
    return inside.groupBy("host", "src_type", "src_semantic", "relation", "dst_type", "dst_semantic").agg(F.countDistinct(F.expr(f"timestamp_ns div {bucket_ns}")).alias("buckets"))


def concentration(edges: DataFrame) -> DataFrame:
    """Edges with out-degree of the destination over its in-degree."""
    out = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("dst").agg(F.count("*").alias("in_degree"))
    return edges.join(into, "dst").join(out, "dst", "left").withColumn("concentration", F.coalesce("out_degree", F.lit(0)) / F.col("in_degree"))


def channels(edges: DataFrame, weight: str) -> DataFrame:
    """One undirected channel for each pair of ends and relation, with the largest weight of its events."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").agg(F.max(weight).alias("weight"))


def relation_balanced(found: DataFrame) -> DataFrame:
    """Channel weights from each end, each relation of a node having the same share: (node, other, relation, share)."""
    ends = found.select(F.col("a").alias("node"), F.col("b").alias("other"), "relation", "weight").union(found.select("b", "a", "relation", "weight"))
    total = ends.groupBy("node", "relation").agg(F.sum("weight").alias("total"))
    kinds = total.where("total > 0").groupBy("node").agg(F.count("*").alias("kinds"))
    return ends.join(total, ["node", "relation"]).join(kinds, "node").where("total > 0").select("node", "other", "relation", (F.col("weight") / F.col("total") / F.col("kinds")).alias("share"))


def semantic_uniqueness(edges: DataFrame) -> DataFrame:
    """For each edge 1 / log2(1 + processes) that share its (object, relation), the smaller over both orientations."""
    pairs = edges.where("src_type = 'process'").select(F.col("src").alias("process"), F.col("dst_semantic").alias("object"), "relation")
    pairs = pairs.union(edges.where("dst_type = 'process'").select("dst", "src_semantic", "relation"))
    rare = pairs.groupBy("object", "relation").agg((1 / F.log2(1 + F.countDistinct("process"))).alias("u"))
    by = lambda end, name: rare.select(F.col("object").alias(end), "relation", F.col("u").alias(name))
    out = edges.join(by("dst_semantic", "u_dst"), ["dst_semantic", "relation"], "left").join(by("src_semantic", "u_src"), ["src_semantic", "relation"], "left")
    one = F.when(F.col("src_type") == "process", F.col("u_dst"))
    two = F.when(F.col("dst_type") == "process", F.col("u_src"))
    return out.withColumn("uniqueness", F.coalesce(F.least(one, two), F.lit(1.0))).drop("u_dst", "u_src")


def bundles(edges: DataFrame, block_ns: int) -> DataFrame:
    """Reversible bundles of equal interactions in a time block, named by a digest of their events."""
    return edges.groupBy("src", "dst", "relation", F.expr(f"timestamp_ns div {block_ns}").alias("block")).agg(
        F.count("*").alias("events"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("edge_id")), lambda x: x.cast("string"))), 256).alias("bundle_id"),
    )
