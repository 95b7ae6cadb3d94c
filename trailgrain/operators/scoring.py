"""Event scores from historical profiles and from points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import profiles as P

FLOOR, BACKOFF = 1e-6, 0.1
MINUTE_NS = 60_000_000_000


def transition_probability(edges: DataFrame, cutoff_ns: int) -> DataFrame:
    """Share of the source's host-days with the relation that led to the destination; types back it off, at a discount."""
    counts = lambda name, *keys: P.host_day_counts(edges, cutoff_ns, *keys).withColumnRenamed("host_days", name)
    out = edges
    for name, keys in (
        ("n", ("src_semantic", "dst_semantic", "relation")), ("d", ("src_semantic", "relation")),
        ("tn", ("src_type", "dst_type", "relation")), ("td", ("src_type", "relation")),
    ):
        out = out.join(counts(name, *keys), list(keys), "left")
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), x))
    p = F.when(F.col("n").isNotNull(), within(F.col("n") / F.col("d"))).when(F.col("tn").isNotNull(), within(BACKOFF * F.col("tn") / F.col("td"))).otherwise(FLOOR)
    return out.withColumn("probability", p).drop("n", "d", "tn", "td")


def stability(edges: DataFrame, cutoff_ns: int) -> DataFrame:
    """in_score and out_score of each semantic key: how far it is from daily activity, with fixed values for data."""
    days = P.active_days(edges, cutoff_ns).groupBy("semantic_key").pivot("direction", ["in", "out"]).agg(F.first("active_days"))
    span = edges.where(F.col("timestamp_ns") < cutoff_ns).agg((F.max("day") - F.min("day") + 1).alias("total")).first().total or 1
    types = P.both_ends(edges).groupBy("semantic_key").agg(F.min("node_type").alias("node_type"))
    out = types.join(days, "semantic_key", "left").fillna(0, ["in", "out"])
    data = (
        F.when(F.col("node_type") == "socket", 0.5)
        .when(F.col("node_type") != "file", F.lit(None))
        .when(F.lower("semantic_key").rlike(E.EXECUTABLE), 0.1)
        .when((F.col("in") > 0) & (F.col("out") == 0), 1.0)
        .otherwise(0.5)
    )
    share = lambda c: F.coalesce(data, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col(c) / span)))
    return out.select("semantic_key", "node_type", share("in").alias("in_score"), share("out").alias("out_score"))


def edge_rarity(edges: DataFrame, weights: tuple[float, float, float] = (0.2, 0.3, 0.5)) -> DataFrame:
    """Weighted rarity of the ends' types, the relation and the pattern, each against the most frequent of its kind.

    The three count tables hold a row for each type, relation and pattern, so they are joined without moving the edges.
    """
    patterns = edges.groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("c"))
    tables = {
        "node": P.both_ends(edges).groupBy("node_type").agg(F.countDistinct("uuid").alias("c")),
        "relation": patterns.groupBy("relation").agg(F.sum("c").alias("c")), "pattern": patterns,
    }
    top = F.max("c").over(Window.partitionBy(F.lit(0)))  # over a row for each type, relation or pattern
    rare = lambda k, name: tables[k].withColumn("top_", top).withColumn(name, E.log_rarity(F.col("c"), F.col("top_"))).drop("c", "top_")
    out = edges.join(rare("node", "r_src").withColumnRenamed("node_type", "src_type"), "src_type")
    out = out.join(rare("node", "r_dst").withColumnRenamed("node_type", "dst_type"), "dst_type")
    out = out.join(rare("relation", "r_rel"), "relation").join(rare("pattern", "r_pat"), ["src_type", "relation", "dst_type"])
    n, r, p = weights
    score = (n * (F.col("r_src") + F.col("r_dst")) / 2 + r * F.col("r_rel") + p * F.col("r_pat")) / (n + r + p)
    return out.withColumn("rarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("r_src", "r_dst", "r_rel", "r_pat")


def nearest_poi_ns(edges: DataFrame, pois: DataFrame) -> DataFrame:
    """Distance in time to the nearest point of interest, by the last one before and the first one after each event.

    One window over the time order would put all rows in a task, so times are cut into minutes first: within its minute an
    event has neighbours, and for minutes without any the nearest before and after come from a table of minutes.
    """
    slot = lambda c: F.expr(f"{c} div {MINUTE_NS}").alias("slot")
    times = pois.select(F.col("timestamp_ns").alias("t"), slot("timestamp_ns")).distinct()
    keep = edges.withColumn("slot", slot("timestamp_ns"))
    slots = keep.select("slot").union(times.select("slot")).distinct()
    per_slot = slots.join(times.groupBy("slot").agg(F.min("t").alias("first"), F.max("t").alias("last")), "slot", "left")
    order = Window.orderBy("slot")  # a row for each minute with events
    per_slot = per_slot.select("slot", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    marked = keep.withColumn("t", F.lit(None).cast("long")).unionByName(times.withColumn("timestamp_ns", F.col("t")), allowMissingColumns=True)
    within = Window.partitionBy("slot").orderBy("timestamp_ns")
    marked = marked.withColumn("back", F.max("t").over(within.rangeBetween(Window.unboundedPreceding, 0))).withColumn("ahead", F.min("t").over(within.rangeBetween(0, Window.unboundedFollowing)))
    out = marked.where("t is null").join(per_slot, "slot")
    back, ahead = F.coalesce("back", "earlier"), F.coalesce("ahead", "later")
    return out.withColumn("distance_ns", F.least(F.col("timestamp_ns") - back, ahead - F.col("timestamp_ns"))).drop("t", "back", "ahead", "earlier", "later", "slot")


def noisy_or(scores: DataFrame, key: str, poi: str, score: str, order: Column | None = None) -> DataFrame:
    """1 - product of (1 - score) for each key, with the strongest point of interest (ties: the smallest; or the least in the order) and the support."""
    return scores.groupBy(key).agg(
        (1 - F.product(1 - F.col(score))).alias("aggregate"),
        F.min_by(poi, F.struct(-F.col(score), F.col(poi)) if order is None else order).alias("winner"),
        F.max(score).alias("winner_score"),
        F.count_if(F.col(score) > 0).alias("support"),
    )
