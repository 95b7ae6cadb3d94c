"""Audits of selections: reasons, objectives and replays of a choice's ledger (case, step, anchor, edge_id, gain) by joins and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.bundles import QUALITY
from trailgrain.operators.graph import cut


def reasons(events: DataFrame, rows: DataFrame, parts: DataFrame, taken: DataFrame, budgets: DataFrame) -> DataFrame:
    """(edge_id, reason) of every event (case, edge_id): rows (edge_id, score, mandatory, pivot) of those with a value; parts: (anchor, member)."""
    kept = taken.select("case", "edge_id").distinct()
    room = budgets.join(kept.groupBy("case").agg(F.count("*").alias("n")), "case", "left").select("case", (F.col("budget") - F.coalesce("n", F.lit(0))).alias("room"))
    missing = parts.select(F.col("anchor").alias("edge_id"), F.col("member")).join(kept.select(F.col("edge_id").alias("member")), "member", "left_anti").groupBy("edge_id").agg(F.count("*").alias("missing"))
    own = rows.select("edge_id", "score", "mandatory", "pivot")
    all_ = events.join(own, "edge_id", "left").join(kept.select("edge_id", F.lit(True).alias("kept")), "edge_id", "left").join(missing, "edge_id", "left").join(room, "case", "left")
    reason = (
        F.when(F.col("mandatory"), "mandatory").when(F.col("kept") & (F.col("score") > 0), "evidence").when(F.col("kept"), "connector")
        .when(F.col("pivot").isNull(), "no witness").when(F.col("score") <= 0, "no evidence").when(F.col("missing") > F.col("room"), "bundle exceeds the budget left").otherwise("left out")
    )
    return all_.select("edge_id", reason.alias("reason"))


def _value(mass: Column, weight: Column, quality: float) -> Column:
    return F.when(weight > 0, quality * mass + (1 - quality) * weight * F.log1p(mass / weight)).otherwise(0.0)


def objective(rows: DataFrame, taken: DataFrame, family: str = "channel", quality: float = QUALITY) -> DataFrame:
    """(case, attained, upper, share): the objective of what was taken, and of all eligible events, which no choice under a budget exceeds."""
    own = rows.select("case", "edge_id", F.col(family).alias("family"), "score").join(taken.select("edge_id", F.lit(True).alias("kept")).distinct(), "edge_id", "left")
    by = own.groupBy("case", "family").agg(F.max("score").alias("weight"), F.sum("score").alias("all"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("score"))), F.lit(0.0)).alias("mass"))
    out = by.groupBy("case").agg(F.sum(_value(F.col("mass"), F.col("weight"), quality)).alias("attained"), F.sum(_value(F.col("all"), F.col("weight"), quality)).alias("upper"))
    return out.withColumn("share", F.when(F.col("upper") > 0, F.col("attained") / F.col("upper")).otherwise(1.0))


def faults(rows: DataFrame, parts: DataFrame, taken: DataFrame, budgets: DataFrame, family: str = "channel", quality: float = QUALITY) -> DataFrame:
    """What a replay of the ledger finds wrong: (fault, rows), one row for each kind of fault, 0 if there is none.

    Each step must add just what its anchor's bundle lacked, within the budget, for the gain that it states; all mandatory
    events must be kept; the bundle of every step's anchor must be kept whole; no event is added twice.
    """
    taken = cut(taken.select("case", "step", "anchor", "edge_id", "gain"))
    entered = taken.groupBy("case", "edge_id").agg(F.min("step").alias("since"), F.count("*").alias("times"))
    steps = taken.where("step > 0").groupBy("case", "step").agg(F.first("anchor").alias("anchor"), F.min("gain").alias("gain"), F.count("*").alias("n"))
    bundle = steps.join(parts, "anchor").join(entered.withColumnRenamed("edge_id", "member"), ["case", "member"], "left")
    lost = bundle.where("since is null")
    early = bundle.groupBy("case", "step").agg(F.count(F.when(F.col("since") >= F.col("step"), 1)).alias("due"))
    wrong = steps.join(early, ["case", "step"], "left").where("due is null or due <> n")
    over = taken.groupBy("case").agg(F.count("*").alias("n")).join(budgets, "case").where("n > budget and n > 0")
    info = rows.select("case", "edge_id", F.col(family).alias("family"), "score")
    weight = info.groupBy("case", "family").agg(F.max("score").alias("weight"))
    adds = taken.join(info, ["case", "edge_id"]).groupBy("case", "family", "step").agg(F.sum("score").alias("add")).join(weight, ["case", "family"])
    seen = O.running(adds, ["case", "family"], ["step"], before=F.col("add"))
    gains = seen.withColumn("g", _value(F.col("before") + F.col("add"), F.col("weight"), quality) - _value(F.col("before"), F.col("weight"), quality)).groupBy("case", "step").agg(F.sum("g").alias("g"))
    unequal = steps.join(gains, ["case", "step"], "left").where(F.abs(F.coalesce("g", F.lit(0.0)) - F.col("gain")) > 1e-8 * F.greatest(F.abs("gain"), F.lit(1.0)))
    absent = rows.where("mandatory").join(taken.select("edge_id"), "edge_id", "left_anti")
    kinds = [("bundle incomplete", lost), ("members differ", wrong), ("budget exceeded", over), ("gain differs", unequal), ("mandatory event missing", absent), ("added twice", entered.where("times > 1"))]
    found = [t.agg(F.count("*").alias("rows")).select(F.lit(k).alias("fault"), "rows") for k, t in kinds]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
