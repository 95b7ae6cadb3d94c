"""Cheapest ways along time: from every event to a target event, and between the declared stages of an attack.

An event costs 1 - score, a billionth at least. Events are in the order of (time, edge_id); ties of cost go to the smaller edge_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import ordered as O
from trailgrain.operators import relaxation as R
from trailgrain.operators.graph import cut

LEAST = 1e-9  # fixed value: what an event costs at least


def event_cost() -> Column:
    return F.greatest(F.lit(LEAST), 1 - F.coalesce(F.col("score"), F.lit(0.0)))


def bridges(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The cheapest strictly later continuation of each event to a target: (edge_id, cost, next), next being null where a target is at hand.

    edges: (edge_id, src, dst, timestamp_ns, score); targets: (edge_id), both of whose ends can be reached. Events from which no
    target can be reached have no row; cost is that of the events between. Without targets or edges there is no row.
    """
    placed = O.ranked(edges.select("edge_id", "src", "dst", "timestamp_ns", event_cost().alias("cost")), [], [F.desc("timestamp_ns"), F.desc("edge_id")], "t")
    steps = cut(placed.select("edge_id", F.col("src").alias("near"), F.col("dst").alias("far"), "t", "cost"))
    ends = cut(targets.select("edge_id").distinct().join(steps.select("edge_id"), "edge_id", "left_semi"))
    none = steps.sparkSession.createDataFrame([], f"node {steps.schema['near'].dataType.simpleString()}, t long, value double, via long, root long")
    fixed = ends.withColumn("value", F.lit(0.0))
    found = R.relaxed(steps, none, F.col("value") + F.col("cost"), largest=False, fixed=fixed)
    # The rounds keep the first of equal offers; one more look at the final ones takes the smallest.
    at = cut(found.select("edge_id", "value").join(steps, "edge_id"))
    own = at.join(ends, "edge_id", "left_semi").select(F.explode(F.array("near", "far")).alias("node"), "t", "value", F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("root"))
    others = at.join(ends, "edge_id", "left_anti")
    offers = own.unionByName(others.select(F.col("near").alias("node"), "t", "value", F.col("edge_id").alias("via"), F.lit(None).cast("long").alias("root")))
    best = R.best_before(offers, others.select("edge_id", F.col("far").alias("node"), "t"), largest=False, strict=True)
    return ends.select("edge_id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("next")).unionByName(best.select("edge_id", F.col("value").alias("cost"), F.col("via").alias("next")))


def bridge_events(found: DataFrame) -> DataFrame:
    """The events of each bridge of `bridges`: (edge_id, position, bridge)."""
    jump = cut(found.where("next is not null").select("edge_id", "next"))
    out, step = jump.select("edge_id", F.lit(0).alias("position"), F.col("next").alias("bridge")), 1
    while True:  # the ways so far, and from their ends the ways so far again
        out = cut(out.unionByName(jump.join(out.withColumnRenamed("edge_id", "next"), "next").select("edge_id", (F.col("position") + step).alias("position"), "bridge")))
        jump = cut(jump.join(jump.select(F.col("edge_id").alias("next"), F.col("next").alias("after")), "next").select("edge_id", F.col("after").alias("next")))
        if jump.isEmpty():
            return out
        step *= 2


def stage_pairs(sequences: DataFrame) -> DataFrame:
    """Neighbouring events of declared sequences (sequence, position, edge_id): (pair, sequence, start, target); an event may be in one sequence only."""
    if sequences.groupBy("edge_id").count().where("count > 1").limit(1).count():
        raise ValueError("an event occurs more than once in the sequences")
    ahead = sequences.select("sequence", (F.col("position") - 1).alias("position"), F.col("edge_id").alias("target"))
    pairs = sequences.withColumnRenamed("edge_id", "start").join(ahead, ["sequence", "position"])
    return pairs.select(F.concat_ws("|", "sequence", "position").alias("pair"), "sequence", "start", "target")


def stage_paths(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest way between the events of each pair: (pair, start, target, status) and (pair, position, edge_id), the events between.

    edges: (edge_id, src, dst, relation, timestamp_ns, score). A way leaves the first event's causal target or the end from which
    it is traced, goes along causal directions strictly in order between both, and ends at the second's causal source or its own
    such end. status: `absent` (an event is not there), `backwards`, `disconnected` or `connected`; equal ends need no event. An
    event meets only the pairs whose window it is in: one a sequence, if that is in time order.
    """
    order = F.struct("timestamp_ns", "edge_id")
    rows = edges.select("edge_id", E.causal_source().alias("from"), E.causal_target().alias("to"), E.investigation_anchor().alias("anchor"), "timestamp_ns", event_cost().alias("cost"), order.alias("at"))
    # Starts cut time into stretches: an event is in the one after the last start before it, and a pair's window is whole stretches but for its end.
    begins = pairs.select(F.col("start").alias("edge_id"), F.lit(1).cast("long").alias("begins")).distinct()
    rows = cut(O.running(rows.join(begins, "edge_id", "left"), [], ["timestamp_ns", "edge_id"], stretch=F.coalesce("begins", F.lit(0).cast("long"))).drop("begins"))
    one = rows.select(F.col("edge_id").alias("start"), F.array_distinct(F.array("to", "anchor")).alias("outs"), F.col("at").alias("since"), (F.col("stretch") + 1).alias("first"))
    two = rows.select(F.col("edge_id").alias("target"), F.array_distinct(F.array("from", "anchor")).alias("ins"), F.col("at").alias("until"), F.col("stretch").alias("last"))
    both = pairs.join(one, "start", "left").join(two, "target", "left")
    here = F.when(F.col("since").isNull() | F.col("until").isNull(), "absent").when(F.col("until") <= F.col("since"), "backwards").when(F.arrays_overlap("outs", "ins"), "connected")
    known = cut(both.withColumn("status", here))
    open_ = known.where("status is null").select("pair", "outs", "ins", "until", "first", "last")
    windows = open_.select("pair", "until", F.explode(F.sequence("first", "last")).alias("stretch"))  # the start is before the end, so first <= last
    inside = rows.join(windows, "stretch").where(F.col("at") < F.col("until")).select("pair", "edge_id", "from", "to", "timestamp_ns", "cost")
    # A pair's copy of an event is a node table of its own; t numbers them in order, and edge_id is that number for the rounds.
    placed = cut(O.ranked(inside, ["pair"], ["timestamp_ns", "edge_id"], "t"))
    named = O.ranked(placed, [], ["edge_id", "pair"], "name")  # ascends with edge_id, so ties go as they should
    steps = cut(named.select(F.col("name").alias("edge_id"), F.concat_ws("|", "pair", "to").alias("near"), F.concat_ws("|", "pair", "from").alias("far"), "t", "cost", "pair", F.col("edge_id").alias("event")))
    starts = open_.select(F.explode(F.transform("outs", lambda n: F.concat_ws("|", "pair", n))).alias("node"), F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("value"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("root"))
    found = cut(R.relaxed(steps.select("edge_id", "near", "far", "t", "cost"), starts, F.col("value") + F.col("cost"), largest=False))
    at = cut(found.select("edge_id", "value").join(steps, "edge_id"))
    arrive = cut(open_.select("pair", F.explode("ins").alias("node")).select("pair", F.concat_ws("|", "pair", "node").alias("near")))
    last = at.join(arrive, ["pair", "near"]).groupBy("pair").agg(F.min(F.struct("value", "t", "edge_id")).alias("m")).select("pair", F.col("m.edge_id").alias("edge_id"))
    # Of equal offers the one that arrived first is kept at a node.
    offers = at.select(F.col("near").alias("node"), "t", "value", F.col("t").alias("via"), F.lit(None).cast("long").alias("root")).unionByName(starts)
    back = R.best_before(offers, at.select("edge_id", F.col("far").alias("node"), "t"), largest=False, strict=True)
    back = cut(back.join(steps.select("edge_id", "pair"), "edge_id").join(steps.select("pair", F.col("t").alias("via"), F.col("edge_id").alias("before")), ["pair", "via"]).select("edge_id", "before"))
    front, out = last, []
    while True:
        front = cut(front)
        if out and front.isEmpty():
            break
        out.append(front.select("pair", F.lit(len(out)).alias("back"), "edge_id"))
        front = front.join(back, "edge_id").select("pair", F.col("before").alias("edge_id"))
    ways = out[0]
    for o in out[1:]:
        ways = ways.unionByName(o)
    length = ways.groupBy("pair").agg(F.max("back").alias("most"))
    ways = cut(ways.join(steps.select("edge_id", "event"), "edge_id").join(length, "pair").select("pair", (F.col("most") - F.col("back")).cast("int").alias("position"), F.col("event").alias("edge_id")))
    reached = ways.select("pair").distinct().withColumn("there", F.lit(True))
    state = known.join(reached, "pair", "left").withColumn("status", F.coalesce("status", F.when(F.col("there"), "connected").otherwise("disconnected")))
    return state.select("pair", "start", "target", "status"), ways
