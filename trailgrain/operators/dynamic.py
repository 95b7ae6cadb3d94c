"""Personalised PageRank kept under edits: estimate and signed residual as tables, repaired where rows of the transition change.

The invariant is residual = restart * seed + (1 - restart) * P' * estimate - estimate. An edit changes the residual only at the
neighbours of its ends; then all nodes above a threshold push at once, round by round, until none is left. Work follows the edit, and the sum of the
absolute residuals over the restart bounds the distance to the solution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut

WEIGHTS, VALUES, SEEDS = "node string, next string, weight double, share double", "node string, estimate double, residual double", "node string, mass double"


@dataclass(frozen=True)
class Rank:
    """weights: rows of the transition (node, next, weight, share), both ways; values: (node, estimate, residual); seeds: (node, mass), masses sum to 1."""

    weights: DataFrame
    values: DataFrame
    seeds: DataFrame
    restart: float = 0.15


def empty(spark: SparkSession, restart: float = 0.15) -> Rank:
    if not 0 < restart < 1:
        raise ValueError("restart must be between 0 and 1")
    return Rank(*[spark.createDataFrame([], s) for s in (WEIGHTS, VALUES, SEEDS)], restart)


def _row(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shares (node, next, share) of these nodes' rows; a node without weights keeps its mass."""
    rows = nodes.join(weights.select("node", "next", "share"), "node", "left")
    return rows.withColumns({"next": F.coalesce("next", "node"), "share": F.coalesce("share", F.lit(1.0))})


def _repaired(values: DataFrame, more: DataFrame) -> DataFrame:
    """values with more (node, residual) added to the residuals."""
    both = values.unionByName(more.select("node", F.lit(0.0).alias("estimate"), "residual"))
    return both.groupBy("node").agg(F.sum("estimate").alias("estimate"), F.sum("residual").alias("residual"))


def with_seeds(rank: Rank, seeds: DataFrame) -> Rank:
    """New seeds (node, mass >= 0, not all 0), scaled to sum 1; the difference goes to the residuals."""
    own = seeds.groupBy("node").agg(F.sum(F.col("mass").cast("double")).alias("mass"))
    total = own.agg(F.sum("mass").alias("s"), F.min("mass").alias("least")).first()
    if not total.s or total.s <= 0 or total.least < 0:
        raise ValueError("seeds must be nonnegative and not all zero")
    new = cut(own.select("node", (F.col("mass") / total.s).alias("mass")))
    change = new.unionByName(rank.seeds.select("node", (-F.col("mass")).alias("mass"))).groupBy("node").agg((rank.restart * F.sum("mass")).alias("residual"))
    return Rank(rank.weights, cut(_repaired(rank.values, change)), new, rank.restart)


def with_edits(rank: Rank, edits: DataFrame) -> Rank:
    """Undirected edits (a, b, weight): the new weight of a pair, 0 to delete it; a pair appears once. Only changed rows are looked at."""
    if edits.where("weight is null or weight < 0 or isnan(weight) or weight = double('infinity')").limit(1).count():
        raise ValueError("weights must be finite and nonnegative")
    both = edits.select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("weight").cast("double").alias("new")).where("node <> next")
    both = both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"), "new")).unionByName(edits.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("weight").cast("double").alias("new")))
    both = cut(both.join(rank.weights, ["node", "next"], "left").where("coalesce(weight, 0) <> new").select("node", "next", "new"))
    nodes = both.select("node").distinct()
    before = rank.weights.join(nodes, "node", "left_semi")
    rows = before.select("node", "next", "weight").join(both, ["node", "next"], "left_anti").unionByName(both.where("new > 0").withColumnRenamed("new", "weight"))
    rows = cut(rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("node"))))
    weights = cut(rank.weights.join(nodes, "node", "left_anti").unionByName(rows))
    old, new = _row(before, nodes), _row(rows, nodes)
    change = new.unionByName(old.withColumn("share", -F.col("share"))).groupBy("node", "next").agg(F.sum("share").alias("share"))
    moved = change.join(rank.values.where("estimate <> 0"), "node").groupBy(F.col("next").alias("node")).agg(((1 - rank.restart) * F.sum(F.col("share") * F.col("estimate"))).alias("residual"))
    seen = _repaired(rank.values, moved.unionByName(both.select(F.explode(F.array("node", "next")).alias("node")).distinct().withColumn("residual", F.lit(0.0))))
    return Rank(weights, cut(seen), rank.seeds, rank.restart)


def solved(rank: Rank, tolerance: float = 1e-7, rounds: int = 1000) -> tuple[Rank, float, int]:
    """Push until every residual is below its share of the tolerance, or for so many rounds: the rank, the bound on the L1 error, and the pushes."""
    if tolerance <= 0 or rounds < 1:
        raise ValueError("tolerance and rounds must be positive")
    values = cut(rank.values)
    threshold = rank.restart * tolerance / max(1, values.count())
    pushes = 0
    for _ in range(rounds):
        front = values.where(F.abs("residual") > threshold).select("node", "residual")
        n = front.count()
        if n == 0:
            break
        pushes += n
        rows = front.join(rank.weights.select("node", "next", "share"), "node", "left")
        rows = rows.withColumns({"next": F.coalesce("next", "node"), "share": F.coalesce("share", F.lit(1.0))})
        moved = rows.groupBy(F.col("next").alias("node")).agg(((1 - rank.restart) * F.sum(F.col("share") * F.col("residual"))).alias("residual"))
        taken = front.select("node", F.col("residual").alias("estimate"), (-F.col("residual")).alias("residual"))
        both = values.unionByName(taken).unionByName(moved.select("node", F.lit(0.0).alias("estimate"), "residual"))
        values = cut(both.groupBy("node").agg(F.sum("estimate").alias("estimate"), F.sum("residual").alias("residual")))
    bound = (values.agg(F.sum(F.abs("residual"))).first()[0] or 0.0) / rank.restart
    return Rank(rank.weights, values, rank.seeds, rank.restart), bound, pushes
