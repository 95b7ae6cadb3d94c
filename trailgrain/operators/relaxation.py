"""Time-ordered relaxation: the best value that reaches each event along events in time order.

What a node offers is a stair: the arrivals in time order that are better than all before them. A round adds the events that
improved to the stairs of their nodes, by a window over arrivals only, and brings the stretches of time in which a stair got
better to the events that leave within them. Events that cannot improve are neither sorted nor moved, and rounds end when no
stair gets better.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut, filed

MOST_ROUNDS = 10_000  # far more than events in a chain; reached only if a step does not improve strictly
PIECE = 64  # stretches of a long stair that are looked through one by one


def best_before(arrivals: DataFrame, probes: DataFrame, largest: bool, strict: bool) -> DataFrame:
    """For each probe (edge_id, node, t) the best arrival (node, t, value, via, root) at its node before it: edge_id, value, via, root.

    strict: an arrival of the same time is not before; otherwise equal times are ordered by edge_id, starts (via null) first.
    Ties go to starts, then to the smallest via.
    """
    sign = 1 if largest else -1
    offer = F.struct((sign * F.col("value")).alias("v"), F.col("via").isNull().alias("start"), (-F.col("via")).alias("tie"), "root")
    come = arrivals.select("node", "t", F.coalesce("via", F.lit(-(1 << 62))).alias("o"), offer.alias("offer"), F.lit(None).cast("long").alias("edge_id"))
    ask = probes.select("node", "t", F.col("edge_id").alias("o"), F.lit(None).cast(come.schema["offer"].dataType).alias("offer"), "edge_id")
    w = Window.partitionBy("node")
    w = w.orderBy("t").rangeBetween(Window.unboundedPreceding, -1) if strict else w.orderBy("t", "o").rowsBetween(Window.unboundedPreceding, -1)
    seen = come.union(ask).withColumn("best", F.max("offer").over(w)).where("edge_id is not null and best is not null")
    return seen.select("edge_id", (sign * F.col("best.v")).alias("value"), (-F.col("best.tie")).alias("via"), F.col("best.root").alias("root"))


def relaxed(
    edges: DataFrame, starts: DataFrame, step: Column, largest: bool = True, strict: bool = True, rounds: int | None = None, fixed: DataFrame | None = None,
) -> DataFrame:
    """Values of events (edge_id, near, far, t, ..) that grow from starts (node, t, value, via, root): edge_id, value, via, root, hops.

    An event is reached at its far node, gets `step` of the best `value` there, and offers it at its near node; `step` must not
    fall as the value gets better. via is the event that offered it, root the one at which the chain began. fixed: (edge_id, value)
    events that keep their value and offer it at both ends.
    """
    given = starts.select("node", "t", F.col("value").cast("double").alias("value"), F.col("via").cast("long").alias("via"), F.col("root").cast("long").alias("root"))
    probes, own = filed(edges) if fixed is None else edges, None
    if fixed is not None:
        marked = filed(probes.join(fixed.select("edge_id", F.col("value").cast("double").alias("fixed_")), "edge_id", "left"))
        own = marked.where("fixed_ is not null").withColumn("value", F.col("fixed_"))
        offers = own.select("t", "value", F.col("edge_id").alias("via"), F.col("edge_id").alias("root"), F.explode(F.array("near", "far")).alias("node"))
        given = given.unionByName(offers)
        probes = marked.where("fixed_ is null").drop("fixed_")
    given = filed(given)
    stairs, found, new = [], [], given
    for hop in itertools.count(1):
        if hop > MOST_ROUNDS:
            raise RuntimeError(f"relaxation did not settle in {MOST_ROUNDS} rounds")
        stair = filed(raised(new, _all(stairs), largest, strict))
        most = stair.where("better").groupBy("node").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        reached = within(probes, stair.where("better"), strict, most).withColumn("value", step)
        round_ = filed(reached.select("edge_id", "near", "t", "value", "via", "root", F.lit(hop).alias("hops")))
        stairs.append(stair)
        found.append(round_)
        if hop == rounds:
            break
        new = round_.select(F.col("near").alias("node"), "t", "value", F.col("edge_id").alias("via"), "root")
    sign = 1 if largest else -1
    kept = None if own is None else own.select("edge_id", "value", F.lit(None).cast("long").alias("via"), F.col("edge_id").alias("root"), F.lit(0).alias("hops"))
    if not found:
        return kept if kept is not None else probes.limit(0).select("edge_id", *[F.lit(None).cast(k).alias(c) for c, k in (("value", "double"), ("via", "long"), ("root", "long"), ("hops", "int"))])
    last = F.max(F.struct((sign * F.col("value")).alias("v"), (-F.col("hops")).alias("h"), "via", "root")).alias("m")  # of equal values the first stays
    out = _all(found).groupBy("edge_id").agg(last).select("edge_id", (sign * F.col("m.v")).alias("value"), "m.via", "m.root", (-F.col("m.h")).alias("hops"))
    return cut(out if kept is None else kept.unionByName(out))


def _all(parts: list[DataFrame]) -> DataFrame | None:
    """Rows of several `filed` tables of one schema, as one read."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()]) if parts else None


def raised(new: DataFrame, stairs: DataFrame | None, largest: bool, strict: bool) -> DataFrame:
    """The stairs of nodes at which something arrived: their new stairs, and the stretches of time in which the best got better.

    new: (node, t, value, via, root); stairs: what earlier rounds returned. Rows (node, t, o, offer, stair, better, value, via, root,
    until_t, until_o): the stretch is after (t, o) up to (until_t, until_o), which is null at the end. Ties are those of `best_before`.
    """
    sign = 1 if largest else -1
    offer = F.struct((sign * F.col("value")).alias("v"), F.col("via").isNull().alias("start"), (-F.col("via")).alias("tie"), "root")
    place = F.lit(0).cast("long") if strict else F.coalesce("via", F.lit(-(1 << 62)))
    rows = new.select("node", "t", place.alias("o"), offer.alias("offer"), F.lit(False).alias("old"))
    if stairs is not None:
        known = stairs.where("stair").join(new.select("node").distinct(), "node", "left_semi")
        rows = rows.unionByName(known.select("node", "t", "o", "offer", F.lit(True).alias("old")))
    w = Window.partitionBy("node").orderBy("t", "o", F.desc("offer"), "old")
    until, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    was = F.when(F.col("old"), F.col("offer"))
    rows = rows.withColumns({"now": F.max("offer").over(until), "above": F.max("offer").over(before), "then": F.max(was).over(until), "then_above": F.max(was).over(before)})
    stair = F.col("above").isNull() | (F.col("offer") > F.col("above"))
    old_stair = F.col("old") & (F.col("then_above").isNull() | (F.col("offer") > F.col("then_above")))
    rows = rows.withColumn("stair", stair & ~F.col("old")).where(stair | old_stair)
    rows = rows.withColumns({"until_t": F.lead("t").over(w), "until_o": F.lead("o").over(w), "better": F.col("then").isNull() | (F.col("now.v") > F.col("then.v"))})
    rows = rows.where("stair or better")
    return rows.select("node", "t", "o", "offer", "stair", "better", (sign * F.col("now.v")).alias("value"), (-F.col("now.tie")).alias("via"), F.col("now.root").alias("root"), "until_t", "until_o")


def within(probes: DataFrame, stretches: DataFrame, strict: bool, most: int) -> DataFrame:
    """probes (edge_id, far, t, ..) with value, via and root of the stretch of `raised` at their far node in which they are; most: stretches of a node.

    Stretches of a node do not overlap. A long stair is looked through in two steps: by pieces, then in a piece.
    """
    own = stretches.select("node", "value", "via", "root", *[F.col(c).alias(f"{c}_") for c in ("t", "o", "until_t", "until_o")])
    inside = _after("t_", "o_", strict) & (F.col("until_t_").isNull() | ~_after("until_t_", "until_o_", strict))
    if most <= 4 * PIECE:
        joined = probes.join(own, (F.col("far") == F.col("node")) & inside)
    else:
        own = filed(own.withColumn("piece", F.expr(f"(row_number() over (partition by node order by t_, o_) - 1) div {PIECE}")))
        first, last = F.struct("t_", "o_"), F.max_by(F.struct("until_t_", "until_o_"), F.struct("t_", "o_"))
        pieces = own.groupBy("node", "piece").agg(F.min(first).alias("a"), last.alias("b")).select("node", "piece", "a.*", "b.*")
        joined = probes.join(pieces, (F.col("far") == F.col("node")) & inside).drop("t_", "o_", "until_t_", "until_o_")
        joined = joined.join(own, ["node", "piece"]).where(inside).drop("piece")
    return joined.drop("node", "t_", "o_", "until_t_", "until_o_")


def _after(t: str, o: str, strict: bool) -> Column:
    """Whether an event is after a place in time."""
    return F.col("t") > F.col(t) if strict else (F.col("t") > F.col(t)) | ((F.col("t") == F.col(t)) & (F.col("edge_id") > F.col(o)))
