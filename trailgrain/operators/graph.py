"""Graph operators as rounds of joins and aggregates; each round's state is a node table."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in spark.checkpoint.dir, which the driver and the executors must share.

    Only a local session, whose driver is the executor, may leave it unset.
    """
    folder_of(df)
    return df.checkpoint()


def filed(df: DataFrame) -> DataFrame:
    """df written to files beside the checkpoints and read back: for the state of many rounds, as a checkpoint hands what the optimizer knows of its plan on from round to round, until planning outlasts the work."""
    path = f"{folder_of(df).rstrip('/')}/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_of(df: DataFrame) -> str:
    """The folder of checkpoints, set where it was not."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trailgrain-"))
    return context.getCheckpointDir()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Undirected neighbourhood: (node, hop) of every node within so many hops of the seeds (column node).

    A hop is a union of two equi-joins, one for each direction, and an anti-join with what is known.
    """
    known = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    front = known
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    for hop in range(1, hops + 1):
        front = both.join(front.select("node"), "node").select(F.col("next").alias("node")).distinct().join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        front = cut(front)
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that directed paths reach from the seeds, those included, with the fewest hops."""
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    known = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    front = known
    for hop in itertools.count(1):
        front = steps.join(front.select("node"), "node").select(F.col("next").alias("node")).distinct().join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        front = cut(front)
        if front.isEmpty():
            return known
        known = cut(known.union(front))


def earliest_arrival(edges: DataFrame, starts: DataFrame, strict: bool = True) -> DataFrame:
    """Earliest time at which information of the starts (node, at) can be at each node, along edges in time order.

    strict: an edge carries on only what was there before its own time; otherwise equal times chain too.
    """
    steps = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "timestamp_ns"))
    best = front = cut(starts.groupBy("node").agg(F.min("at").alias("at")))
    later = F.col("timestamp_ns") > F.col("at") if strict else F.col("timestamp_ns") >= F.col("at")
    while True:
        new = steps.join(front, "node").where(later).groupBy(F.col("next").alias("node")).agg(F.min("timestamp_ns").alias("new"))
        both = cut(best.join(new, "node", "full").select("node", F.least("at", "new").alias("at"), F.coalesce(F.col("new") < F.col("at"), F.col("new").isNotNull()).alias("moved")))
        front, best = both.where("moved").select("node", "at"), both.select("node", "at")
        if front.isEmpty():
            return best


def latest_departure(edges: DataFrame, ends: DataFrame, strict: bool = True) -> DataFrame:
    """Latest time at which information at each node can still reach the ends (node, at): earliest arrival, mirrored."""
    mirrored = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("timestamp_ns")).alias("timestamp_ns"))
    found = earliest_arrival(mirrored, ends.select("node", (-F.col("at")).alias("at")), strict)
    return found.select("node", (-F.col("at")).alias("at"))


def temporal_routes(edges: DataFrame, pois: DataFrame, backward: bool = True, rounds: int | None = None) -> DataFrame:
    """Fewest strictly time-ordered hops from each event to a point of interest: (edge_id, depth, parent).

    Level by level: an event has depth d if its time is strictly before the latest event of less depth at its target (after
    the earliest, forward), to the end or, where `rounds` is given, to that depth. The parent is the latest event of the level before at that node, ties to the smallest edge_id.
    """
    sign = 1 if backward else -1
    a, b = ("src", "dst") if backward else ("dst", "src")
    rows = edges.select("edge_id", F.col(a).alias("near"), F.col(b).alias("far"), (sign * F.col("timestamp_ns")).alias("t"))
    start = rows.join(pois.select("edge_id"), "edge_id", "left_semi")
    exposed = start.select("edge_id", "t", F.explode(F.array("near", "far")).alias("node"))
    found = cut(start.select("edge_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    for depth in itertools.count(1) if rounds is None else range(1, rounds + 1):
        best = exposed.groupBy("node").agg(F.max(F.struct("t", (-F.col("edge_id")).alias("tie"))).alias("m")).select(F.col("node").alias("far"), F.col("m.t").alias("limit"), (-F.col("m.tie")).alias("parent"))
        left = rows.join(found.select("edge_id"), "edge_id", "left_anti")
        level = cut(left.join(best, "far").where("t < limit").select("edge_id", "near", "t", "parent"))
        if level.isEmpty():
            break
        found = cut(found.union(level.select("edge_id", F.lit(depth), "parent")))
        exposed = level.select("edge_id", "t", F.col("near").alias("node"))
    return found


def channel_pagerank(channels: DataFrame, seeds: DataFrame, rounds: int = 10, restart: float = 0.15, cut_every: int = 5) -> DataFrame:
    """Personalised PageRank over weighted undirected channels (a, b, weight) for a fixed number of rounds: (node, score)."""
    both = channels.select(F.col("a").alias("node"), F.col("b").alias("next"), "weight").union(channels.select("b", "a", "weight"))
    degree = both.groupBy("node").agg(F.sum("weight").alias("degree"))
    share = cut(both.join(degree, "node").select("node", "next", (F.col("weight") / F.col("degree")).alias("share")))
    n = seeds.count()
    teleport = seeds.select("node", F.lit(1.0 / n).alias("seed"))
    nodes = cut(degree.select("node").join(teleport, "node", "left").fillna(0.0, ["seed"]))
    score = nodes.select("node", "seed", F.col("seed").alias("score"))
    for k in range(1, rounds + 1):
        moved = share.join(score.select("node", "score"), "node").groupBy(F.col("next").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("m"))
        score = nodes.join(moved, "node", "left").select("node", "seed", (restart * F.col("seed") + (1 - restart) * F.coalesce("m", F.lit(0.0))).alias("score"))
        if k % cut_every == 0:
            score = cut(score)
    return score.select("node", "score")


def dependency_impact(edges: DataFrame, pois: DataFrame, weight: str, rounds: int = 8, tolerance: float | None = None) -> DataFrame:
    """Impact flows from the points of interest back over weighted edges: (node, score), fixed at 1 at their ends.

    With a tolerance rounds go on until no score changes by more; where a node's weights sum to less than 1, they get there.
    """
    fixed = cut(pois.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    score = fixed.withColumn("score", F.lit(1.0))
    flow = edges.groupBy("src", "dst").agg(F.sum(weight).alias("w"))
    flow = flow if tolerance is None else cut(flow)
    for k in range(rounds):
        before = score
        pushed = flow.join(score.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.least(F.lit(1.0), F.sum(F.col("w") * F.col("score"))).alias("score"))
        score = pushed.join(fixed, "node", "left_anti").unionByName(fixed.withColumn("score", F.lit(1.0)))
        if k % 4 == 3 or tolerance is not None:
            score = cut(score)
        if tolerance is not None:
            gap = score.join(before.withColumnRenamed("score", "old"), "node", "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            if (gap or 0.0) <= tolerance:
                return score
    if tolerance is not None:
        raise RuntimeError(f"impact did not settle in {rounds} rounds")
    return score


def lineage(births: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Processes started by the seeds' processes, generation by generation: (root, process, generation, born)."""
    front = cut(seeds.select(F.col("process").alias("root"), "process", F.lit(0).alias("generation"), "born"))
    found = front
    for g in range(1, depth + 1):
        child = births.select(F.col("parent").alias("process"), F.col("process").alias("child"), F.col("born").alias("child_born"))
        front = front.join(child, "process").where("child_born > born").select("root", F.col("child").alias("process"), F.lit(g).alias("generation"), F.col("child_born").alias("born"))
        front = cut(front.groupBy("root", "process").agg(F.min("generation").alias("generation"), F.min("born").alias("born")).join(found.select("root", "process"), ["root", "process"], "left_anti").select("root", "process", "generation", "born"))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): (node, component), component being the smallest node of it.

    Star contraction: every node's larger neighbours move to its smallest one, then every node's neighbours do; the number
    of rounds grows with the logarithm of the number of nodes, whatever the longest path.
    """
    seen = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = cut(large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).distinct())
        if new.count() == now.count() and new.exceptAll(now).isEmpty():
            return seen.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
        now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def followed(seeds: DataFrame, pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """The seeds (edge_id) and all that pointers (edge_id, next) lead to from them, by doubling: as many rounds as the logarithm of the longest chain."""
    known, jump = cut(seeds.distinct()), cut(pointers.select("edge_id", "next"))
    for _ in range(rounds):
        reached = known.join(jump, "edge_id").select(F.col("next").alias("edge_id"))
        known = cut(known.union(reached).distinct())
        jump = cut(jump.join(jump.select(F.col("edge_id").alias("next"), F.col("next").alias("after")), "next").select("edge_id", F.col("after").alias("next")))
        if jump.isEmpty():
            return known
    raise RuntimeError("pointers have a cycle")
