"""Pruning of candidate graphs to a share of their events: groups that stay whole, events that must stay, bridges, bounded churn.

Every case is pruned by itself, all cases at once. Groups are admitted in an order, each with the groups that its bridges need. Going
through them once is done in rounds: running totals show how far all that is not yet there fits, see `_admitted`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators import removal as V
from trailgrain.operators.bundles import unmet
from trailgrain.operators.graph import cut, reachable

ROUNDS = 10_000
MODES = ("ratio", "adaptive", "rdp_guard", "progressive")
GAP = 1e-12  # fixed value: a gap between scores that counts
MANY = 1 << 62
LIMITS = ("room", "quota", "wanted", "most")


def subset(sizes: list[tuple[int, int]], capacity: int, least: int) -> tuple[int, dict[int, int]]:
    """The largest sum within capacity, and how many of each (size, count) make the smallest sum of `least` or more, if there is one, else the largest.

    Counts are split into 1, 2, 4, .. and a rest, sizes ascending; of several ways that sum is made of the earliest such parts.
    Memory is five bytes a unit of capacity.
    """
    capacity = min(capacity, sum(s * n for s, n in sizes))
    if capacity <= 0:
        return 0, {}
    made_by = np.zeros(capacity + 1, np.int32)  # the part with which a sum first came up; 0: not yet
    there = np.zeros(capacity + 1, bool)
    there[0] = True
    parts = [(0, 0)]
    for size, count in sorted(sizes):
        step = 1
        while count:
            take = min(step, count)
            count, step, weight = count - take, 2 * step, size * take
            parts.append((size, take))
            if weight <= capacity:
                new = np.flatnonzero(there[: capacity + 1 - weight] & ~there[weight:]) + weight
                there[new], made_by[new] = True, len(parts) - 1
    sums = np.flatnonzero(there)
    largest = int(sums[-1])
    at = int(sums[np.searchsorted(sums, min(largest, max(0, least)))])
    taken: dict[int, int] = {}
    while at:
        size, take = parts[made_by[at]]
        taken[size] = taken.get(size, 0) + take
        at -= size * take
    return largest, taken


def planned(groups: DataFrame, wants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of the earlier result's groups (case, group, size) fit a capacity and hold an overlap (case, capacity, least): (case, largest) and (case, group).

    A case's sizes with their counts are one task's work, not its groups; of equal sizes the smallest groups are taken.
    """
    counts = groups.groupBy("case", "size").agg(F.count("*").alias("n")).join(wants, "case")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        largest, taken = subset(list(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), int(rows["capacity"].iloc[0]), int(rows["least"].iloc[0]))
        return pd.DataFrame({"case": rows["case"], "size": rows["size"], "take": [taken.get(s, 0) for s in rows["size"].tolist()], "largest": largest})

    found = cut(counts.groupBy("case").applyInPandas(solve, f"case {groups.schema['case'].dataType.simpleString()}, size long, take long, largest long"))
    placed = O.ranked(groups, ["case", "size"], ["group"])
    chosen = placed.join(found.where("take > 0"), ["case", "size"]).where("place <= take").select("case", "group")
    return found.groupBy("case").agg(F.max("largest").alias("largest")), cut(chosen)


def _admitted(order: DataFrame, needs: DataFrame, sizes: DataFrame, kept: DataFrame, limits: DataFrame, skip: bool) -> DataFrame:
    """What going through an order once adds to what is kept (case, group): (case, group, by).

    order: (case, place, group, own), own being what a turn takes of `quota`; needs: (case, group, member), the group itself
    included; sizes: (case, group, size, prior). limits: (case, room, quota, wanted, most): events, quota, events of the earlier
    result after which it ends, turns after which it ends. A turn whose group is there already is none. One that doesn't fit is
    passed over (skip), and never will fit, as what others take costs at least what it spares; or the order ends there.
    """
    left = cut(order.join(needs, ["case", "group"]).select("case", "place", "own", F.col("group").alias("anchor"), "member"))
    amounts, kept, out = sizes.select("case", F.col("group").alias("member"), "size", "prior"), kept.select("case", F.col("group").alias("member")), None
    for _ in range(ROUNDS):
        live = left.join(kept.withColumnRenamed("member", "anchor"), ["case", "anchor"], "left_anti")
        missing = live.join(kept, ["case", "member"], "left_anti").join(limits.where("room > 0").select("case"), "case", "left_semi")
        if skip:
            fits = missing.join(amounts, ["case", "member"]).groupBy("case", "place").agg(F.sum("size").alias("n"), F.max("own").alias("own")).join(limits, "case").where("n <= room and own <= quota")
            missing = missing.join(fits.select("case", "place"), ["case", "place"], "left_semi")
        left = cut(missing)
        if left.isEmpty():
            return out if out is not None else kept.limit(0).select("case", F.col("member").alias("group"), F.col("member").alias("by"))
        turns = left.join(unmet(left), ["case", "place"], "left_semi")
        first = cut(turns.groupBy("case", "member").agg(F.min(F.struct("place", "anchor", "own")).alias("m")).select("case", "member", "m.place", "m.anchor", "m.own").join(amounts, ["case", "member"]))
        costs = first.groupBy("case", "place").agg(F.sum("size").alias("n"), F.sum("prior").alias("p"), F.max("own").alias("o"))
        ahead = O.running(costs, ["case"], ["place"], n_before=F.col("n"), p_before=F.col("p"), o_before=F.col("o"), turn=F.lit(1).cast("long")).join(limits, "case")
        over = (F.col("p_before") >= F.col("wanted")) | (F.col("turn") >= F.col("most"))
        ends = cut(ahead.where(over | (F.col("n_before") + F.col("n") > F.col("room")) | (F.col("o_before") + F.col("o") > F.col("quota"))).groupBy("case").agg(F.min(F.struct("place", over.alias("over"))).alias("m")).select("case", F.col("m.place").alias("end"), F.col("m.over").alias("over")))
        new = cut(first.join(ends, "case", "left").where("end is null or place < end").select("case", "member", "anchor", "place", "size", "prior", "own"))
        added = new.select("case", F.col("member").alias("group"), F.col("anchor").alias("by"))
        out = added if out is None else cut(out.unionByName(added))
        kept = cut(kept.unionByName(new.select("case", "member")))
        used = new.groupBy("case").agg(F.sum("size").alias("n"), F.sum("prior").alias("p"), F.sum(F.when(F.col("member") == F.col("anchor"), F.col("own"))).alias("o"), F.countDistinct("place").alias("t"))
        less = {c: (F.col(c) - F.coalesce(a, F.lit(0))).alias(c) for c, a in zip(LIMITS, ("n", "o", "p", "t"), strict=True)}
        limits = cut(limits.join(used, "case", "left").select("case", *less.values()))
        left = left.join(ends.where("not over") if skip else ends.limit(0), "case").where("place > end").drop("end", "over")
    raise RuntimeError(f"admission did not end in {ROUNDS} rounds")


def _limits(state: DataFrame, room: Column, quota: Column | None = None, wanted: Column | None = None, most: Column | None = None) -> DataFrame:
    many = F.lit(MANY)
    return state.select("case", *[F.coalesce(c, many).cast("long").alias(n) for n, c in zip(LIMITS, (room, many if quota is None else quota, many if wanted is None else wanted, many if most is None else most), strict=True)])


def _gap_turns(ranks: DataFrame) -> DataFrame:
    """The place after which the score falls most, null where it doesn't: (case, gap_place)."""
    after = ranks.select("case", (F.col("place") - 1).alias("place"), F.col("score").alias("after"))
    gaps = ranks.join(after, ["case", "place"]).select("case", "place", (F.col("score") - F.col("after")).alias("gap"))
    return gaps.groupBy("case").agg(F.max(F.struct("gap", (-F.col("place")).alias("place"))).alias("m")).select("case", F.when(F.col("m.gap") > GAP, -F.col("m.place")).alias("gap_place"))


def pruned(
    events: DataFrame, bridges: DataFrame, keep_ratio: float, mode: str = "ratio", positive_only: bool = False, churn_slack: float | None = None,
    escape_ratio: float = 0.0, escape_threshold: float = 0.0, depends: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What stays of each case, and an account of it: (case, edge_id, group, reason, by, bridge, previous) and (case, budget, ..).

    events: (case, edge_id, group, score, mandatory, previous, escape), see `removal.atomic_groups`; group is its smallest event, score
    is in [0, 1], null flags are false, escape is null where an event has no claim to the quota. bridges: (edge_id, bridge), the
    events with which an event is connected. A case's budget is its number of events times keep_ratio, rounded down, one at least;
    what must stay (mandatory events, their groups and bridges) stays even beyond it.

    Groups are ranked by best score an event, best score, smallest event. `ratio` ends at the first that doesn't fit, so larger
    budgets only add; `adaptive` also ends after as many turns as the share of groups or, if later, the widest gap between scores;
    `rdp_guard` passes over what doesn't fit; `progressive` (one case) removes groups instead, with `depends` (dependent, required)
    beside the bridges, and without escapes. churn_slack: None without an earlier result; else its groups come first until no
    more of its events are lost than the smaller budget, new mandatory events, this share of the budget and whole groups demand.
    The quota, a share of the budget, goes to the best groups whose escape reaches the threshold. An empty table gives empty tables.
    """
    if not 0 < keep_ratio <= 1 or mode not in MODES or not 0 <= (churn_slack or 0) <= 1 or not 0 <= escape_ratio <= 1 or not 0 <= escape_threshold <= 1:
        raise ValueError("keep_ratio, mode, churn_slack, escape_ratio or escape_threshold out of range")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = cut(events.select("case", "edge_id", "group", F.coalesce("score", F.lit(0.0)).alias("score"), flag("mandatory").alias("mandatory"), flag("previous").alias("previous"), F.when(F.col("escape") >= escape_threshold, F.col("escape")).alias("escape")))
    if mode == "progressive" and rows.select("case").distinct().limit(2).count() > 1:
        raise ValueError("progressive removal takes one case")
    groups = rows.groupBy("case", "group").agg(F.count("*").alias("size"), F.max("score").alias("score"), F.max("mandatory").alias("mandatory"), F.max("previous").alias("previous"), F.max("escape").alias("escape"), F.count("escape").alias("own"))
    groups = cut(groups.withColumn("prior", F.when(F.col("previous") & F.lit(churn_slack is not None), F.col("size")).otherwise(0).cast("long")))
    of = rows.select("edge_id", "group")
    links = bridges.join(of, "edge_id").join(rows.select("case", F.col("edge_id").alias("bridge"), F.col("group").alias("member")), "bridge").select("case", "group", "member")
    needs = cut(links.union(groups.select("case", "group", F.col("group").alias("member"))).distinct())
    ranks = cut(O.ranked(groups, ["case"], [F.desc(F.col("score") / F.col("size")), F.desc("score"), "group"]))
    core = groups.where("mandatory").select("case", "group")
    first = cut(needs.join(core, ["case", "group"], "left_semi").groupBy("case", F.col("member").alias("group")).agg(F.min("group").alias("by")).join(core.withColumn("core", F.lit(True)), ["case", "group"], "left"))
    ledger = first.select("case", "group", F.when(F.col("core"), F.col("group")).otherwise(F.col("by")).alias("by"), F.when(F.col("core"), "mandatory").otherwise("bridge").alias("reason"))
    total = groups.groupBy("case").agg(F.sum("size").alias("events"), F.count("*").alias("groups"), F.sum("prior").alias("prior"))
    must = first.join(groups, ["case", "group"]).groupBy("case").agg(F.sum("size").alias("required"), F.sum("prior").alias("overlap"))
    state = total.join(must, "case", "left").fillna(0, ["required", "overlap"]).withColumn("budget", F.greatest(F.lit(1), F.floor(F.col("events") * keep_ratio)))
    slack = F.ceil(F.lit(churn_slack or 0.0) * F.col("budget"))
    declared = F.least("prior", F.greatest(F.lit(0), F.col("prior") - F.col("budget")) + F.col("required") - F.col("overlap") + slack) if churn_slack is not None else F.lit(0).cast("long")
    state = state.withColumns({"feasible": F.col("required") <= F.col("budget"), "declared": declared, "room": F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("required"))})
    state = cut(state.withColumn("lacking", F.greatest(F.lit(0).cast("long"), F.col("prior") - F.col("declared") - F.col("overlap"))))
    plan = None
    if churn_slack is not None and mode != "progressive":
        open_ = groups.where("prior > 0").join(first.select("case", "group"), ["case", "group"], "left_anti")
        most, plan = planned(open_, state.where("feasible").select("case", F.col("room").alias("capacity"), F.col("lacking").alias("least")))
        state = state.join(most, "case", "left").withColumn("atomic", F.when(F.col("feasible"), F.greatest(F.lit(0).cast("long"), F.col("lacking") - F.coalesce("largest", F.lit(0)))).otherwise(0)).drop("largest")
    else:
        state = state.withColumn("atomic", F.lit(0).cast("long"))
    state = cut(state.withColumn("allowed", F.least(F.col("prior"), F.col("declared") + F.col("atomic"))))
    quota = F.when(F.col("claims") > 0, F.greatest(F.lit(1), F.floor(F.col("budget") * escape_ratio))).otherwise(0) if escape_ratio > 0 and mode != "progressive" else F.lit(0)
    state = cut(state.join(groups.groupBy("case").agg(F.sum("own").alias("claims")), "case").withColumn("quota", quota.cast("long")).drop("claims"))
    if mode == "progressive":
        ledger, state = _removed(groups, needs, ledger, state, positive_only, depends)
    else:
        ledger = cut(ledger)
        if plan is not None:
            wanted = F.greatest(F.lit(0).cast("long"), F.col("prior") - F.col("allowed") - F.col("overlap"))
            ledger = _phase(ledger, ranks.withColumn("own", F.lit(0)).join(plan, ["case", "group"], "left_semi"), needs, groups, state.where("feasible"), "prior", wanted=wanted)
        if escape_ratio > 0:
            claim = O.ranked(groups.where("own > 0").drop("place"), ["case"], [F.desc("escape"), "group"])
            ledger = _phase(ledger, claim, needs, groups, state, "escape", quota=F.col("quota"))
        turns = None
        if mode == "adaptive":
            state = cut(state.join(_gap_turns(ranks), "case", "left"))
            turns = F.greatest(F.lit(1), F.ceil(F.col("groups") * keep_ratio), F.coalesce("gap_place", F.lit(0)))
        useful = ranks.where("score > 0") if positive_only else ranks
        ledger = _phase(ledger, useful.withColumn("own", F.lit(0)), needs, groups, state, "rank", most=turns, skip=mode == "rdp_guard")
    kept = cut(rows.join(ledger, ["case", "group"]).join(groups.select("case", "group", (F.col("prior") > 0).alias("prior")), ["case", "group"]))
    out = kept.select("case", "edge_id", "group", "reason", "by", (F.col("by") != F.col("group")).alias("bridge"), F.col("prior").alias("previous"))
    return out, _account(rows, kept, state, positive_only)


def _phase(ledger: DataFrame, order: DataFrame, needs: DataFrame, sizes: DataFrame, state: DataFrame, name: str, skip: bool = True, **limits: Column | None) -> DataFrame:
    """The ledger with what a further pass adds."""
    used = ledger.join(sizes.select("case", "group", "size"), ["case", "group"]).groupBy("case").agg(F.sum("size").alias("used"))
    now = state.join(used, "case", "left").withColumn("left_", F.col("budget") - F.coalesce("used", F.lit(0)))
    new = _admitted(order.select("case", "place", "group", "own").join(state.select("case"), "case", "left_semi"), needs, sizes, ledger, cut(_limits(now, F.col("left_"), **limits)), skip)
    return cut(ledger.unionByName(new.withColumn("reason", F.lit(name))))


def _removed(groups: DataFrame, needs: DataFrame, must: DataFrame, state: DataFrame, positive_only: bool, depends: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The progressive mode's ledger."""
    if groups.isEmpty():
        return must, state
    waits = needs.where("group <> member").select(F.col("group").alias("dependent"), F.col("member").alias("required"))
    waits = cut((waits if depends is None else waits.unionByName(depends.select("dependent", "required"))).where("dependent <> required").distinct())
    able = groups.where("score > 0").select("group") if positive_only else groups.select("group")
    able = reachable(waits.select(F.col("dependent").alias("src"), F.col("required").alias("dst")), able.union(must.select("group")).select(F.col("group").alias("node"))).select(F.col("node").alias("group"))
    held = must.select("group", F.lit(True).alias("held"))
    own = groups.drop("mandatory", "previous").join(able, "group", "left_semi").join(held, "group", "left")
    own = cut(own.select("group", F.col("size").alias("cost"), F.col("score").alias("base"), F.lit(0.0).alias("consistency"), F.lit(None).cast("string").alias("redundancy"), F.col("prior").alias("previous"), F.coalesce("held", F.lit(False)).alias("mandatory")))
    waits = cut(waits.join(able.withColumnRenamed("group", "dependent"), "dependent", "left_semi").join(able.withColumnRenamed("group", "required"), "required", "left_semi"))
    now = state.first()
    audit = V.progressive(own, waits, now.budget, now.allowed if now.prior else None)
    kept = audit.where("kept").select("group").join(groups.select("case", "group"), "group").join(must.select("group"), "group", "left_anti")
    return cut(must.unionByName(kept.select("case", "group", F.col("group").alias("by"), F.lit("retained").alias("reason")))), state


def _account(rows: DataFrame, kept: DataFrame, state: DataFrame, positive_only: bool) -> DataFrame:
    """One row a case: budget, what was required, kept, lost and added, and whether bounds hold."""
    of = kept.groupBy("case").agg(
        F.count("*").alias("kept"), F.count(F.when(F.col("prior"), 1)).alias("retained_previous"), F.sum("score").alias("mass"),
        F.min(F.when(F.col("by") == F.col("group"), F.col("score"))).alias("threshold"), F.count(F.when((F.col("reason") == "escape") & (F.col("by") == F.col("group")), F.col("escape"))).alias("escaped"),
        F.count(F.when(F.col("score") <= 0, 1)).alias("worthless"),
    )
    whole = rows.groupBy("case").agg(F.sum("score").alias("all_mass"), F.count(F.when(F.col("score") <= 0, 1)).alias("all_worthless"))
    found = state.join(of, "case", "left").join(whole, "case").fillna(0, ["kept", "retained_previous", "mass", "escaped", "worthless"])
    removed, added = F.col("prior") - F.col("retained_previous"), F.col("kept") - F.col("retained_previous")
    return found.select(
        "case", "events", "budget", "required", "feasible", "kept", F.greatest(F.lit(0), F.col("kept") - F.col("budget")).alias("overflow"), F.greatest(F.lit(0), F.col("budget") - F.col("kept")).alias("unused"),
        F.coalesce("threshold", F.lit(1.0)).alias("threshold"), F.when(F.col("all_mass") > 0, F.col("mass") / F.col("all_mass")).otherwise(1.0).alias("mass_share"),
        F.col("prior").alias("previous"), "retained_previous", removed.alias("removed_previous"), added.alias("added"), F.col("declared").alias("declared_loss"), F.col("atomic").alias("atomic_loss"), F.col("allowed").alias("allowed_loss"),
        (removed <= F.col("allowed")).alias("churn_holds"), F.when(F.col("prior") + added > 0, F.col("retained_previous") / (F.col("prior") + added)).otherwise(1.0).alias("jaccard"), "quota", "escaped",
        (F.lit(positive_only) & (F.col("kept") < F.col("budget")) & (F.col("all_worthless") > F.col("worthless"))).alias("stopped_at_zero"),
    )


def certificates(account: DataFrame, pois: DataFrame, kept: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Whether each case still shows its points of interest and the ways between them: (case, expected, retained, pairs, status).

    pois: (case, edge_id), all that are expected. before, after: (case, pair, status) of `bridges.stage_paths` on the candidates
    and on what is kept; None or no rows for a case: its points of interest have no order.
    """
    own = pois.select("case", "edge_id").distinct().join(kept.select("edge_id", F.lit(True).alias("there")).distinct(), "edge_id", "left")
    rows = account.select("case", "feasible").join(own.groupBy("case").agg(F.count("*").alias("expected"), F.count("there").alias("retained")), "case", "left").fillna(0, ["expected", "retained"])
    for name, table in (("before", before), ("after", after)):
        if table is None:
            rows = rows.withColumns({f"{name}_pairs": F.lit(0), f"{name}_ways": F.lit(0), f"{name}_sequences": F.lit(0)})
            continue
        counts = table.groupBy("case").agg(F.count("pair").alias(f"{name}_pairs"), F.count(F.when(F.col("status") == "connected", 1)).alias(f"{name}_ways"), F.countDistinct("sequence").alias(f"{name}_sequences"))
        rows = rows.join(counts, "case", "left").fillna(0, [f"{name}_pairs", f"{name}_ways", f"{name}_sequences"])
    ordered = F.col("before_pairs") > 0
    status = (
        F.when((F.col("expected") == 0) | (F.col("retained") < F.col("expected")), "missing_poi").when(~F.col("feasible"), "budget_infeasible")
        .when(ordered & (F.col("before_ways") < F.col("before_pairs")), "candidate_disconnected").when(ordered & (F.col("after_ways") < F.col("before_pairs")), "missing_poi")
        .when(F.col("expected") == 1, "poi_only").when(ordered & (F.col("before_sequences") > 1), "valid_forest").when(ordered, "valid").otherwise("unordered_multi_poi")
    )
    return rows.select("case", "expected", "retained", F.col("before_pairs").alias("pairs"), status.alias("status"))
