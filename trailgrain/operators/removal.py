"""Progressive removal: the least useful groups go until a budget holds, but none that a kept group depends on.

One after another, the group of the least utility goes among those whose dependents are gone. That order has a closed form: a group
that waits for a dependent goes right after it. Its key is the list of the greater keys of the last dependent, and its own; lists
are compared element by element. So keys come level by level over the dependencies, and what goes is a prefix of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import components, cut

ROUNDS = 1000


def _own() -> Column:
    """A group's own key: the order among groups that wait for nothing."""
    return F.struct("utility", "group")


def atomic_groups(events: DataFrame, links: DataFrame) -> DataFrame:
    """(edge_id, group): events that must stay or go together by links (a, b); the group is its smallest event."""
    found = components(links)
    return events.select("edge_id").join(found.withColumnRenamed("node", "edge_id"), "edge_id", "left").select("edge_id", F.coalesce("component", "edge_id").alias("group"))


def as_groups(events: DataFrame) -> DataFrame:
    """Groups (group, cost, base, consistency, redundancy, previous, mandatory) from events (edge_id, group, score, consistency, redundancy, previous, mandatory)."""
    return events.groupBy("group").agg(
        F.count("*").alias("cost"), F.max("score").alias("base"), F.max(F.coalesce("consistency", F.lit(0.0))).alias("consistency"), F.min("redundancy").alias("redundancy"),
        F.count(F.when(F.col("previous"), 1)).alias("previous"), F.max("mandatory").alias("mandatory"),
    )


def _keys(rows: DataFrame, depends: DataFrame) -> DataFrame:
    """Groups (group, utility, stays) that can go, with their key; a group that waits for one that stays, or for itself, can't."""
    left = cut(rows.where("not stays").select("group", "utility"))
    waits = cut(depends.select(F.col("required").alias("group"), "dependent").distinct())
    out = []
    known = None
    for _ in range(ROUNDS):
        if known is None:
            now = left.join(waits.select("group").distinct(), "group", "left_anti").withColumn("key", F.array(_own()))
        else:
            need = waits.join(left.select("group"), "group", "left_semi").join(known.select(F.col("group").alias("dependent"), "key"), "dependent", "left")
            ready = need.groupBy("group").agg(F.count(F.when(F.col("key").isNull(), 1)).alias("open"), F.max("key").alias("last")).where("open = 0").select("group", "last")
            now = left.join(ready, "group").withColumn("own_", _own()).withColumn("key", F.concat(F.filter("last", lambda x: x > F.col("own_")), F.array("own_"))).select("group", "utility", "key")
        now = cut(now)
        if now.isEmpty():
            break
        out.append(now)
        known = now if known is None else cut(known.unionByName(now))
        left = cut(left.join(now.select("group"), "group", "left_anti"))
    else:
        raise RuntimeError(f"dependencies are deeper than {ROUNDS}")
    return known if known is not None else left.withColumn("key", F.array(_own()))


def _order(rows: DataFrame, depends: DataFrame) -> DataFrame:
    """All groups with their final utility and, if they can go, their place in the order in which they would.

    Of a redundancy key the last one that is left loses its penalty; who that is follows from the order, and the order from it.
    """
    now = rows.withColumn("alone", F.lit(False))
    before = None
    for _ in range(ROUNDS):
        rated = cut(now.withColumn("utility", F.when(F.col("alone"), F.col("plain")).otherwise(F.col("penal"))))
        keys = _keys(rated, depends)
        if before is None:  # without redundancy one pass is enough
            before = rated.where("redundancy is not null and plain <> penal and not stays").select("group").limit(1).count()
        if before:
            both = rated.select("group", "redundancy").join(keys.select("group", "key"), "group", "left").where("redundancy is not null")
            last = both.groupBy("redundancy").agg(F.max(F.struct("key", "group")).alias("m"), F.count(F.when(F.col("key").isNull(), 1)).alias("stay")).where("stay = 0").select(F.col("m.group").alias("group"), F.lit(True).alias("alone_"))
            new = cut(rated.join(last, "group", "left").withColumn("next", F.coalesce("alone_", F.lit(False))).drop("alone_"))
            if not new.where("next <> alone").isEmpty():
                now = new.drop("alone", "utility").withColumnRenamed("next", "alone")
                continue
        placed = O.running(keys.join(rated.select("group", "cost", "previous"), "group"), [], ["key"], place=F.lit(1).cast("long"), freed=F.col("cost"), churned=F.col("previous"))
        return cut(rated.join(placed.select("group", "key", "place", "freed", "churned"), "group", "left"))
    raise RuntimeError("redundancy did not settle")


def progressive(groups: DataFrame, depends: DataFrame, budget: int, churn: int | None = None, consistency: float = 0.1, redundancy: float = 0.02) -> DataFrame:
    """The audit of a removal: (group, cost, kept, utility, attempted, place, reason), one row for each group.

    groups: see as_groups; depends: (dependent, required). budget: events that may stay. churn: how many events of the previous
    choice (`previous`) may go; a group that would exceed it stays for good. Utility is the best score and a share of the best
    consistency, less a penalty while another kept group has its redundancy key, by cost. Ties go by the smaller group.
    """
    if budget < 0 or not 0 <= consistency <= 1 or not 0 <= redundancy <= 0.25:
        raise ValueError("budget, consistency or redundancy out of range")
    base = F.col("base") + consistency * F.col("consistency")
    many = groups.where("redundancy is not null").groupBy("redundancy").agg((F.count("*") > 1).alias("shared"))
    rows = groups.join(many, "redundancy", "left")
    plain, penal = base / F.col("cost"), (base - F.when(F.col("shared"), redundancy).otherwise(0.0)) / F.col("cost")
    rows = cut(rows.select("group", "cost", "redundancy", "previous", "mandatory", plain.alias("plain"), penal.alias("penal"), F.col("mandatory").alias("stays"), F.lit(None).cast("array<struct<utility: double, group: bigint>>").alias("due")))
    total = rows.agg(F.sum("cost")).first()[0] or 0
    for _ in range(ROUNDS):
        order = _order(rows, depends)
        turn = total - F.col("freed") > budget  # still too many when its turn comes
        if churn is None:
            break
        late = order.where(turn & (F.col("churned") + F.col("previous") > churn)).agg(F.min(F.struct("place", "churned"))).first()[0]
        if late is None:
            break
        # What others take leaves less room, so none from there on that does not fit now ever will.
        hit = order.where((F.col("place") >= late.place) & (F.col("previous") > churn - late.churned)).select("group", F.col("key").alias("hit"))
        rows = cut(rows.join(hit, "group", "left").withColumn("stays", F.col("stays") | F.col("hit").isNotNull()).withColumn("due", F.coalesce("due", "hit")).drop("hit"))
    else:
        raise RuntimeError(f"churn did not settle in {ROUNDS} rounds")
    order = order.withColumn("gone", F.coalesce(turn, F.lit(False)))
    ends = order.agg(F.max(F.when(F.col("gone"), F.col("key"))).alias("end_"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("cost"))), F.lit(0)).alias("gone_"))
    held = order.where("not gone").select(F.col("group").alias("dependent")).join(depends, "dependent").select(F.col("required").alias("group"), F.lit(True).alias("held")).distinct()
    order = order.join(held, "group", "left").crossJoin(F.broadcast(ends))  # one row
    asked = F.coalesce(F.array(_own()) < F.col("end_"), F.lit(False)) | (total - F.col("gone_") > budget)
    churns = F.col("due").isNotNull() & F.col("held").isNull() & (F.coalesce(F.col("due") < F.col("end_"), F.lit(False)) | (total - F.col("gone_") > budget))
    attempted = F.col("gone") | churns | (~F.col("mandatory") & asked)
    reason = F.when(F.col("gone"), None).when(F.col("mandatory"), "protected").when(churns, "churn").when(attempted, "required")
    return order.select("group", "cost", (~F.col("gone")).alias("kept"), "utility", attempted.alias("attempted"), F.when(F.col("gone"), F.col("place") + 1).alias("place"), reason.alias("reason"))
