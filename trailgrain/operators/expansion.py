"""Causal expansion from alerts: a frontier of states by priority, time windows that grow with what they find, and guards.

A state is a node at a time with the suspicion of the way there. In a round the best `batch` states of every case expand together:
each looks along its node's events within its window, keeps one event of a dependency as representative, and pushes a state for
each representative that is suspicious enough and was not expanded before. With a batch of one this is the order of a heap; with
a larger one, states of a round act as if taken one after another, and their children wait for the next round. All cases advance side by side, so
rounds grow with the longest way, not with the number of alerts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut

SECOND = 1_000_000_000
LINEAGE = ("EVENT_CLONE", "EVENT_EXECUTE", "EVENT_FORK")  # fixed values: relations that start a process
STATE = "case string, id long, parent long, edge_id long, node string, a long, suspicion double, hops int, priority double"


@dataclass(frozen=True)
class Search:
    """Thresholds, weights and guards; a guard of None is off. soft_fanout: nodes with so few candidates keep them all."""

    min_edge: float = 0.55
    min_path: float = 0.45
    min_frontier: float = 0.45
    momentum: float = 0.8
    decay: float = 0.95
    window_s: float = 900.0
    growth: float = 2.0
    boundary: float = 0.1
    half_life_s: float = 900.0
    rarity_weight: float = 0.6
    time_weight: float = 0.25
    fanout_weight: float = 0.15
    many: int = 1000
    slice_s: float = 60.0
    soft_fanout: int | None = None
    max_edges: int | None = None
    max_states: int | None = None
    max_hops: int | None = None
    batch: int = 256


class Expansion(NamedTuple):
    """events (case, edge_id); states with status (complete, truncated or extended) and the order `done` in which they ended; reasons (case, reason, n); excluded (case, edge_id)."""

    events: DataFrame
    states: DataFrame
    reasons: DataFrame
    excluded: DataFrame


def priority(anomaly: Column, distance: Column, fanout: Column, p: Search) -> Column:
    """Of rarity, nearness in time and few alternatives."""
    return p.rarity_weight * anomaly + p.time_weight * F.exp(-distance / (p.half_life_s * SECOND)) + p.fanout_weight / (1 + F.log1p(F.greatest(F.lit(0), fanout - 1)))


def _representatives(states: DataFrame, steps: DataFrame) -> DataFrame:
    """For each state (case, id, node, a, w) the representative of each dependency within its window: the most anomalous, then the nearest, then the smallest edge_id."""
    seen = states.join(steps, "node").where("t >= a and t <= a + w")
    best = F.min_by(F.struct("edge_id", "next", "t", "anomaly"), F.struct(-F.col("anomaly"), F.col("t"), F.col("edge_id")))
    return seen.groupBy("case", "id", "dep").agg(best.alias("r")).select("case", "id", "dep", "r.*")


def _windows(taken: DataFrame, steps: DataFrame, p: Search) -> tuple[DataFrame, DataFrame]:
    """States with their final window w, and how often windows grew or jumped: (case, reason)."""
    open_ = cut(taken.select("case", "id", "node", "a", F.lit(int(p.window_s * SECOND)).cast("long").alias("w")))
    final, grown = [], []
    while not open_.isEmpty():
        reps = _representatives(open_, steps).join(open_.select("case", "id", "a", "w"), ["case", "id"])
        at_edge = (F.col("t") - F.col("a") >= F.col("w") * (1 - p.boundary)) & (F.col("anomaly") >= p.min_edge)
        state = open_.join(reps.groupBy("case", "id").agg(F.max(at_edge).alias("edge")), ["case", "id"], "left")
        empty = state.where("edge is null")
        ahead = empty.join(steps, "node").where("t >= a").groupBy("case", "id").agg(F.min(F.struct("t", "edge_id", "anomaly")).alias("first"))
        state = state.join(ahead, ["case", "id"], "left")
        jump = F.col("edge").isNull() & (F.col("first.anomaly") >= p.min_edge)
        jumped = F.greatest(F.col("w") + 1, ((F.col("first.t") - F.col("a")) * p.growth).cast("long"))
        new = F.when(jump, jumped).when(F.col("edge"), (F.col("w") * p.growth).cast("long"))
        state = cut(state.select("case", "id", "node", "a", "w", new.alias("new"), F.when(jump, "window jumped to an event").when(F.col("edge"), "window grew").alias("reason")))
        final.append(state.where("new is null").select("case", "id", "node", "a", "w"))
        grown.append(state.where("new is not null").select("case", "reason"))
        open_ = state.where("new is not null").select("case", "id", "node", "a", F.col("new").alias("w"))
    return _union(final, taken.select("case", "id", "node", "a").withColumn("w", F.lit(0).cast("long")).limit(0)), _union(grown, taken.select("case", F.lit("").alias("reason")).limit(0))


def _union(tables: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for t in tables:
        out = out.unionByName(t)
    return out


def expand(edges: DataFrame, starts: DataFrame, backward: bool, p: Search, blocked: DataFrame | None = None) -> Expansion:
    """Expansion of cases (case, node, at) over edges (edge_id, src, dst, relation, timestamp_ns, anomaly), against or along the flow.

    blocked: (case, edge_id) of events that count as selected but are not expanded. Events of the start's own time belong.
    """
    spark, sign = edges.sparkSession, -1 if backward else 1
    near, far = ("dst", "src") if backward else ("src", "dst")
    dep = F.concat_ws("\x1f", "src", "dst", "relation")
    steps = cut(edges.select(F.col(near).alias("node"), F.col(far).alias("next"), "edge_id", dep.alias("dep"), (sign * F.col("timestamp_ns")).alias("t"), "anomaly").repartition("node"))
    none = spark.createDataFrame([], "case string, edge_id long")
    stop = cut(blocked.select("case", "edge_id")) if blocked is not None else none
    begin = starts.select("case", F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge_id"), "node", (sign * F.col("at")).alias("a"), F.lit(None).cast("double").alias("suspicion"), F.lit(0).alias("hops"), F.lit(1.0).alias("priority"))
    frontier, selected, expanded = cut(begin), stop, none
    ended, counted, out_excluded = [], [], []
    processed = cut(starts.groupBy("case").agg(F.lit(0).cast("long").alias("n")))
    for number in itertools.count(1):
        if frontier.isEmpty():
            break
        order = Window.partitionBy("case").orderBy(F.desc("priority"), "id")
        queue = frontier.withColumn("k", F.row_number().over(order)).withColumn("top", F.max("priority").over(Window.partitionBy("case"))).join(processed, "case")
        over = F.lit(False) if p.soft_fanout is not None else F.col("top") < p.min_frontier
        spent = F.lit(False) if p.max_states is None else F.col("n") >= p.max_states
        most = F.lit(p.batch) if p.max_states is None else F.least(F.lit(p.batch), p.max_states - F.col("n"))
        weak = F.lit(False) if p.soft_fanout is not None else F.col("priority") < p.min_frontier
        fate = F.when(over, "below relevance").when(spent, "too many states").when((F.col("k") > most) | weak, "waits")
        fate = fate if p.max_hops is None else F.coalesce(fate, F.when(F.col("hops") >= p.max_hops, "too many hops"))
        queue = cut(queue.withColumn("fate", F.coalesce(fate, F.lit("taken"))).withColumn("done", F.lit(number).cast("long") * (1 << 32) + F.col("k")).drop("top", "n"))
        out = queue.where("fate in ('below relevance', 'too many states', 'too many hops')")
        ended.append(out.select("case", "id", "parent", "edge_id", "hops", "done", F.when(F.col("fate") == "below relevance", "complete").otherwise("truncated").alias("status")))
        counted.append(out.groupBy("case", F.col("fate").alias("reason")).agg(F.count("*").alias("n")))
        processed = cut(processed.join(queue.where("fate in ('taken', 'too many hops')").groupBy("case").agg(F.count("*").alias("m")), "case", "left").select("case", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        taken = queue.where("fate = 'taken'")
        placed, grown = _windows(taken, steps, p)
        placed = cut(placed)
        counted.append(grown.groupBy("case", "reason").agg(F.count("*").alias("n")))
        claims, sliced = _claims(placed, taken, steps, p)
        counted.append(sliced)
        claims = claims.join(stop, ["case", "edge_id"], "left_anti").join(expanded, ["case", "edge_id"], "left_anti")
        good = claims.where("eligible").groupBy("case", "edge_id").agg(F.min("rank").alias("first"))
        claims = cut(claims.join(good, ["case", "edge_id"], "left").where("first is null or rank <= first"))
        low = claims.where("not eligible")
        counted.append(low.groupBy("case", F.lit("priority below threshold").alias("reason")).agg(F.count("*").alias("n")))
        seen = placed.join(steps, "node").where("t >= a and t <= a + w").select("case", "id", "dep", "t", F.col("edge_id").alias("instance"))
        out_excluded.append(cut(low.join(seen, ["case", "id", "dep"]).select("case", F.col("instance").alias("edge_id")).distinct()))
        taking = claims.where("eligible")
        fresh = taking.drop("t").join(seen, ["case", "id", "dep"])
        fresh = fresh.groupBy("case", F.col("instance").alias("edge_id")).agg(F.min(F.struct("rank", "t")).alias("m")).select("case", "edge_id", "m.rank", "m.t").join(selected, ["case", "edge_id"], "left_anti")
        if p.max_edges is not None:
            fresh, limited = _capped(fresh, taking, selected, p.max_edges)
        else:
            limited = taking.limit(0).select("case", "id", "edge_id", F.lit(True).alias("stopped"))
        fresh, limited = cut(fresh), cut(limited)
        selected = cut(selected.unionByName(fresh.select("case", "edge_id")))
        born = cut(taking.join(limited.where("stopped").select("case", "edge_id"), ["case", "edge_id"], "left_anti"))
        pushed = born.withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy("rank")))
        sub = pushed.select("case", (F.lit(number).cast("long") * (1 << 32) + F.col("k")).alias("id"), F.col("id").alias("parent"), "edge_id", F.col("next").alias("node"), F.col("t").alias("a"), F.col("successor").alias("suspicion"), (F.col("hops") + 1).alias("hops"), (F.col("successor") * F.col("p")).alias("priority"))
        expanded = cut(expanded.unionByName(born.select("case", "edge_id")))
        flags = taken.join(born.select("case", "id").distinct().withColumn("extended", F.lit(True)), ["case", "id"], "left").join(limited.select("case", "id").distinct().withColumn("limited", F.lit(True)), ["case", "id"], "left")
        status = F.when(F.col("extended"), "extended").when(F.col("limited"), "truncated").otherwise("complete")
        flags = cut(flags.select("case", "id", "parent", "edge_id", "hops", "done", status.alias("status"), "limited"))
        ended.append(flags.drop("limited"))
        natural = F.lit("natural head" if backward else "natural tail")
        counted += [t.groupBy("case", r.alias("reason")).agg(F.count("*").alias("n")) for t, r in ((flags.where("limited"), F.lit("too many events")), (flags.where("status = 'complete'"), natural))]
        frontier = cut(queue.where("fate = 'waits'").select(*begin.columns).unionByName(sub.select(*begin.columns)))
        ended, counted, out_excluded = [[cut(_union(t[1:], t[0]))] for t in (ended, counted, out_excluded)]
    states = ended[0] if ended else spark.createDataFrame([], "case string, id long, parent long, edge_id long, hops int, done long, status string")
    reasons = counted[0].groupBy("case", "reason").agg(F.sum("n").alias("n")) if counted else spark.createDataFrame([], "case string, reason string, n long")
    excluded = out_excluded[0].distinct() if out_excluded else none
    return Expansion(selected, states, reasons, excluded)


def _claims(placed: DataFrame, taken: DataFrame, steps: DataFrame, p: Search) -> tuple[DataFrame, DataFrame]:
    """The representatives that states could go on to, with their rank in the case's round, and the slices of busy nodes as reasons."""
    reps = _representatives(placed, steps).join(taken.select("case", "id", "a", "suspicion", "hops", "k"), ["case", "id"])
    reps = cut(reps.withColumn("distance", F.col("t") - F.col("a")).withColumn("fanout", F.count("*").over(Window.partitionBy("case", "id"))))
    place = F.when(F.col("fanout") >= p.many, F.expr(f"distance div {int(p.slice_s * SECOND)}"))
    reps = reps.withColumn("slice", place).withColumn("local", F.when(F.col("fanout") >= p.many, F.count("*").over(Window.partitionBy("case", "id", "slice"))).otherwise(F.col("fanout")))
    slices = reps.where("slice is not null").select("case", "id", "slice").distinct().groupBy("case", F.lit("slices of a busy node").alias("reason")).agg(F.count("*").alias("n"))
    reps = reps.withColumn("p", priority(F.col("anomaly"), F.col("distance"), F.col("local"), p))
    successor = F.coalesce(p.momentum * F.col("suspicion") + (1 - p.momentum) * F.col("p"), F.col("p")) * p.decay
    reps = reps.withColumn("successor", successor)
    soft = F.lit(False) if p.soft_fanout is None else F.col("fanout") <= p.soft_fanout
    eligible = soft | (F.col("anomaly") >= p.min_edge) | (F.col("p") >= p.min_edge) | (F.col("successor") >= p.min_path)
    order = Window.partitionBy("case").orderBy("k", F.desc("p"), F.desc("anomaly"), "distance", "edge_id")
    return reps.withColumn("eligible", eligible).withColumn("rank", F.row_number().over(order)), slices


def _capped(fresh: DataFrame, taking: DataFrame, selected: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The new events within the cap, and the claims (case, id, edge_id) that it touches; it stops those that had no room left when their turn came, or whose representative did not get in."""
    held = selected.groupBy("case").agg(F.count("*").alias("held"))
    rows = fresh.join(held, "case", "left").fillna(0, ["held"])
    kept = cut(rows.withColumn("at", F.row_number().over(Window.partitionBy("case").orderBy("rank", "t", "edge_id"))).where(F.col("at") + F.col("held") <= most))
    new = fresh.groupBy("case", "rank").agg(F.count("*").alias("new"))
    turn = taking.join(new, ["case", "rank"], "left").join(held, "case", "left").fillna(0, ["new", "held"])
    before = F.coalesce(F.sum("new").over(Window.partitionBy("case").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = turn.withColumn("before", before).withColumn("full", F.col("held") + F.col("before") >= most)
    have = kept.select("case", "edge_id").union(selected).distinct().withColumn("have", F.lit(True))
    stopped = F.col("full") | F.col("have").isNull()
    limited = turn.join(have, ["case", "edge_id"], "left").where(stopped | (F.col("held") + F.col("before") + F.col("new") > most))
    return kept.select("case", "edge_id"), limited.select("case", "id", "edge_id", stopped.alias("stopped"))


def ways(found: Expansion) -> DataFrame:
    """The ways of states that ended complete: (case, id, done, position, edge_id), from the start outwards."""
    links = cut(found.states.select("case", "id", "parent", "edge_id", "hops"))
    at = found.states.where("status = 'complete' and edge_id is not null").select("case", F.col("id").alias("way"), "done", "id")
    out = []
    while not at.isEmpty():
        here = cut(at.join(links, ["case", "id"]).where("edge_id is not null"))
        out.append(here.select("case", F.col("way").alias("id"), "done", F.col("hops").alias("position"), "edge_id"))
        at = here.select("case", "way", "done", F.col("parent").alias("id")).where("id is not null")
    return _union(out, found.states.select("case", "id", "done", F.col("hops").alias("position"), "edge_id").limit(0))


class Context(NamedTuple):
    """Of alerts: events (alert, edge_id), ways with side and order (alert, side, part, way, done, position, edge_id), reasons (alert, reason, n), truncated (alert, n)."""

    events: DataFrame
    ways: DataFrame
    reasons: DataFrame
    truncated: DataFrame


def contexts(edges: DataFrame, alerts: DataFrame, p: Search, backward: Column | None, forward: Column | None, cone: bool = False) -> Context:
    """What explains alerts (edge_id) and what they lead to, from the ends that the columns name (None: not that side).

    Events of the alert's dependency at its own time belong to it and are not expanded. cone: from each process that the backward
    ways start, also forward from its start.
    """
    own = cut(alerts.select("edge_id").distinct().join(edges, "edge_id").withColumn("alert", F.col("edge_id")))
    same = edges.select("src", "dst", "relation", "timestamp_ns", F.col("edge_id").alias("other")).join(own.select("alert", "src", "dst", "relation", "timestamp_ns"), ["src", "dst", "relation", "timestamp_ns"]).select("alert", F.col("other").alias("edge_id"))
    same = cut(same)
    sides = []
    if backward is not None:
        starts = own.select(F.col("alert").cast("string").alias("case"), backward.alias("node"), F.col("timestamp_ns").alias("at"))
        found = expand(edges, starts, True, p, same.select(F.col("alert").cast("string").alias("case"), "edge_id"))
        sides.append(("before", found, cut(ways(found))))
        if cone:
            points = sides[0][2].select("case", "edge_id").distinct().join(edges, "edge_id").where(F.upper("relation").isin(*LINEAGE) & (F.col("dst_type") == "process"))
            points = cut(points.select("case", F.col("dst").alias("node"), F.col("timestamp_ns").alias("at")).distinct().withColumn("alert", F.col("case")).withColumn("case", F.concat_ws("|", "alert", "node", F.col("at").cast("string"))))
            block = points.select("case", "alert").join(same.select(F.col("alert").cast("string").alias("alert"), "edge_id"), "alert").select("case", "edge_id")
            found = expand(edges, points, False, p, block)
            sides.append(("cone", found, cut(ways(found))))
    if forward is not None:
        starts = own.select(F.col("alert").cast("string").alias("case"), forward.alias("node"), F.col("timestamp_ns").alias("at"))
        found = expand(edges, starts, False, p, same.select(F.col("alert").cast("string").alias("case"), "edge_id"))
        sides.append(("after", found, cut(ways(found))))
    alert = F.substring_index("case", "|", 1).cast("long").alias("alert")
    events = same
    for _, f, _ in sides:
        events = events.union(f.events.select(alert, "edge_id"))
    rows = _union([w.select(alert, F.lit(n).alias("side"), F.col("case").alias("part"), F.col("id").alias("way"), "done", "position", "edge_id") for n, _, w in sides[1:]], sides[0][2].select(alert, F.lit(sides[0][0]).alias("side"), F.col("case").alias("part"), F.col("id").alias("way"), "done", "position", "edge_id"))
    why = _union([f.reasons.select(alert, "reason", "n") for _, f, _ in sides[1:]], sides[0][1].reasons.select(alert, "reason", "n"))
    lost = _union([f.states.where("status = 'truncated'").select(alert) for _, f, _ in sides[1:]], sides[0][1].states.where("status = 'truncated'").select(alert))
    return Context(events.distinct(), rows, why.groupBy("alert", "reason").agg(F.sum("n").alias("n")), lost.groupBy("alert").agg(F.count("*").alias("n")))


def evidence_paths(edges: DataFrame, found: Context) -> DataFrame:
    """Whole paths through an alert as (alert, path array of edge_id): every backward way with the first forward one, and the first backward way with every other.

    Only simple paths count, and only of alerts without truncated states; forks from the cone are no part of a path.
    """
    listed = found.ways.where("side <> 'cone'").groupBy("alert", "side", "way").agg(F.min("done").alias("done"), F.sort_array(F.collect_list(F.struct("position", "edge_id"))).alias("p"))
    ids = listed.select("alert", "side", "way", "done", F.transform("p", lambda x: x["edge_id"]).alias("ids"))
    place = F.row_number().over(Window.partitionBy("alert", "side").orderBy("done", "way"))
    before = ids.where("side = 'before'").withColumn("b", place).select("alert", "b", F.reverse("ids").alias("left"))
    after = ids.where("side = 'after'").withColumn("f", place).select("alert", "f", F.col("ids").alias("right"))
    alerts = found.events.select("alert").distinct()
    both = alerts.join(before, "alert", "left").join(after.where("f = 1"), "alert", "left").select("alert", "left", "right")
    more = alerts.join(before.where("b = 1"), "alert", "left").join(after.where("f > 1"), "alert").select("alert", "left", "right")
    empty = F.array().cast("array<bigint>")
    paths = both.unionByName(more).select("alert", F.concat(F.coalesce("left", empty), F.array("alert"), F.coalesce("right", empty)).alias("path")).join(found.truncated.select("alert"), "alert", "left_anti")
    rows = paths.withColumn("n_", F.monotonically_increasing_id())
    rows = cut(rows)
    steps = rows.select("n_", F.posexplode("path").alias("position", "edge_id")).join(edges.select("edge_id", "src", "dst"), "edge_id")
    shape = steps.groupBy("n_").agg(F.sort_array(F.collect_list(F.struct("position", "src", "dst"))).alias("s"))
    nodes = F.concat(F.array(F.col("s")[0]["src"]), F.transform("s", lambda x: x["dst"]))
    linked = F.forall(F.sequence(F.lit(1), F.size("s")), lambda k: (k == F.size("s")) | (F.element_at("s", k)["dst"] == F.element_at("s", F.least(k + 1, F.size("s")))["src"]))
    simple = shape.where(linked & (F.size(F.array_distinct(nodes)) == F.size(nodes))).select("n_")
    return rows.join(simple, "n_", "left_semi").where(F.size(F.array_distinct("path")) == F.size("path")).select("alert", "path")


def cumulative(found: Context, alerts: DataFrame) -> DataFrame:
    """Groups of alerts (alert, group, at) in time order over the events of their alerts: (group, at, new, overlap, cumulative)."""
    groups = alerts.groupBy("group").agg(F.min("at").alias("at"))
    rows = found.events.join(alerts.select("alert", "group"), "alert").select("group", "edge_id").distinct().join(groups, "group")
    first = rows.groupBy("edge_id").agg(F.min(F.struct("at", "group")).alias("first"))
    marked = rows.join(first, "edge_id").groupBy("at", "group").agg(F.count(F.when(F.col("first.group") == F.col("group"), 1)).alias("new"), F.count("*").alias("all"))
    total = F.sum("new").over(Window.orderBy("at", "group").rowsBetween(Window.unboundedPreceding, 0))  # a row a group of alerts
    return marked.select("group", "at", "new", (F.col("all") - F.col("new")).alias("overlap"), total.alias("cumulative"))
