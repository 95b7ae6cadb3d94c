"""Selection of events with their whole witnesses under a cap, over all anchors of a case.

`packed` is the order by score alone and runs in rounds of joins and running totals. Where gains depend on what was taken before,
a case's choice is sequential: its anchors are streamed, sorted by what they can gain at most, into one task, which reads no further
once the budget is full or no unread anchor can beat those at hand, and holds what it has read, each waiting anchor as bytes.
"""

from __future__ import annotations

import heapq
import itertools
import marshal
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import cut

ROUNDS = 10_000  # a round takes one event of the budget at least; far beyond what is seen
ROUNDING = 1 + 1e-9  # bounds are computed by another library than gains


def eligible(rows: DataFrame) -> DataFrame:
    """Of (edge_id, score, mandatory, pivot, ..) the mandatory events and those with evidence and a witness."""
    return rows.where("mandatory or (score > 0 and pivot is not null)")


def members(anchors: DataFrame, pointers: DataFrame) -> DataFrame:
    """Events of each anchor's witness: up the fork to its pivot, and from there back to a point of interest: (anchor, member)."""
    links = cut(pointers.select("edge_id", "back", "parent", "pivot"))
    own = anchors.select(F.col("edge_id").alias("anchor"), F.col("edge_id").alias("at"))
    found = cut(own)
    for pointer in ("parent", "back"):
        front = own if pointer == "parent" else cut(own.join(links.withColumnRenamed("edge_id", "at"), "at").where("pivot is not null").select("anchor", F.col("pivot").alias("at")))
        found = found.union(front)
        while True:
            front = cut(front.join(links.withColumnRenamed("edge_id", "at"), "at").where(F.col(pointer).isNotNull()).select("anchor", F.col(pointer).alias("at")))
            if front.isEmpty():
                break
            found = cut(found.union(front))
    return found.distinct().withColumnRenamed("at", "member")


def packed(rows: DataFrame, parts: DataFrame, budgets: DataFrame) -> DataFrame:
    """The best anchors with all their members, each whole or not at all: (case, edge_id).

    rows: (case, edge_id, score, mandatory) of `eligible`; parts: (anchor, member). budgets: (case, budget) of events, mandatory
    ones included. The result is that of going through the anchors once, the best score first (ties: the smaller edge_id), and
    taking each that is not yet kept and whose missing members fit. An anchor that doesn't fit never will: what others take costs
    the budget at least as much as it spares. So a round drops those, takes all before the first that no longer fits after them,
    and goes on.
    """
    own = cut(rows.select("case", "edge_id", "score", "mandatory"))
    kept = cut(own.where("mandatory").select("case", F.col("edge_id").alias("member")).distinct())
    room = cut(budgets.join(kept.groupBy("case").agg(F.count("*").alias("n")), "case", "left").select("case", (F.col("budget") - F.coalesce("n", F.lit(0))).alias("room")).where("room > 0"))
    places = O.ranked(own.where("not mandatory"), ["case"], [F.desc("score"), "edge_id"]).select("case", "place", F.col("edge_id").alias("anchor"))
    left = places.join(parts, "anchor").select("case", "place", "anchor", "member").distinct()
    for _ in range(ROUNDS):
        live = left.join(kept.withColumnRenamed("member", "anchor"), ["case", "anchor"], "left_anti")
        missing = live.join(kept, ["case", "member"], "left_anti")
        fits = missing.groupBy("case", "place").agg(F.count("*").alias("n")).join(room, "case").where("n <= room").select("case", "place")
        left = cut(missing.join(fits, ["case", "place"], "left_semi").select("case", "place", "anchor", "member"))
        if left.isEmpty():
            return kept.withColumnRenamed("member", "edge_id")
        own_turn = left.join(unmet(left), ["case", "place"], "left_semi")
        first = cut(own_turn.groupBy("case", "member").agg(F.min("place").alias("place")))
        costs = O.running(first.groupBy("case", "place").agg(F.count("*").alias("n")), ["case"], ["place"], before=F.col("n"))
        ends = cut(costs.join(room, "case").where("before + n > room").groupBy("case").agg(F.min("place").alias("end")))
        new = cut(first.join(ends, "case", "left").where("end is null or place < end").select("case", "member"))
        kept = cut(kept.unionByName(new))
        room = cut(room.join(new.groupBy("case").agg(F.count("*").alias("n")), "case", "left").select("case", (F.col("room") - F.coalesce("n", F.lit(0))).alias("room")).where("room > 0"))
        left = left.join(ends, "case").where("place > end").drop("end")
    raise RuntimeError(f"packing did not end in {ROUNDS} rounds")


def unmet(left: DataFrame) -> DataFrame:
    """The places (case, place) whose anchor no earlier one of these has brought, if all of these fit.

    An anchor is decided once no undecided earlier one has it among its members.
    """
    anchors = left.select("case", "place", "anchor").distinct()
    hits = cut(left.select("case", F.col("place").alias("by"), F.col("member").alias("anchor")).join(anchors, ["case", "anchor"]).where("by < place").select("case", "by", "place"))
    open_ = cut(anchors.select("case", "place"))
    decided = []
    while True:
        waiting = hits.select("case", "place").distinct()
        sure = cut(open_.join(waiting, ["case", "place"], "left_anti"))
        decided.append(sure)
        if hits.isEmpty():
            out = decided[0]
            for d in decided[1:]:
                out = out.unionByName(d)
            return out
        met = hits.join(sure.withColumnRenamed("place", "by"), ["case", "by"], "left_semi").select("case", "place").distinct()
        gone = cut(sure.unionByName(met).distinct())
        open_ = cut(open_.join(gone, ["case", "place"], "left_anti"))
        hits = cut(hits.join(gone, ["case", "place"], "left_anti").join(gone.withColumnRenamed("place", "by"), ["case", "by"], "left_anti"))


def bundled(rows: DataFrame, parts: DataFrame, families: list[str], bound: Column) -> DataFrame:
    """For the streamed choice: each eligible row with its members, their scores and families where they count themselves, and its bound.

    bound: what the row can gain at most, from `score` and `weight`, the largest score in the row's first family. Families are numbered
    in the order of their names.
    """
    given = rows.select("case", "edge_id", F.col("score").cast("double").alias("score"), "mandatory", F.array(*[F.col(f).cast("string") for f in families]).alias("names"))
    given = cut(given)
    numbers = cut(O.ranked(given.select(F.explode("names").alias("name")).where("name is not null").distinct(), [], ["name"], "number"))
    for i in range(len(families)):
        given = given.join(numbers.select(F.col("name").alias(f"name{i}"), F.col("number").alias(f"number{i}")), F.col("names")[i] == F.col(f"name{i}"), "left").drop(f"name{i}")
    own = cut(given.select("case", "edge_id", "score", "mandatory", F.array(*[f"number{i}" for i in range(len(families))]).alias("families"), F.col("number0").alias("family")))
    info = own.join(own.groupBy("case", "family").agg(F.max("score").alias("weight")), ["case", "family"])
    of = info.select("case", F.col("edge_id").alias("member"), F.struct("score", "families", "weight").alias("info"))
    both = own.select("case", F.col("edge_id").alias("anchor")).join(parts.union(own.select("edge_id", "edge_id")).distinct(), "anchor").join(of, ["case", "member"], "left")
    listed = both.groupBy("case", F.col("anchor").alias("edge_id")).agg(F.collect_list(F.struct(F.col("member").alias("id"), "info.score", "info.families", "info.weight")).alias("members"))
    return info.join(listed, ["case", "edge_id"]).select("case", F.col("edge_id").alias("anchor"), "score", "families", "weight", "mandatory", "members").withColumn("bound", F.when(F.col("mandatory"), 0.0).otherwise(bound))


Taken = Iterator[tuple[int, int, int, float]]  # step, anchor, event, gain
Greedy = Callable[[Iterator[dict], int], Taken]
LEDGER = "case string, step int, anchor long, edge_id long, gain double"
FEW = 10_000  # rows of the ledger that leave the task at a time


def shelved(row: dict) -> bytes:
    """A row of `bundled` while it waits; Python's own objects would take several times as much."""
    return marshal.dumps((row["anchor"], row["score"], row["weight"], tuple(row["families"]), tuple((m["id"], m["score"], m["weight"], m["families"] and tuple(m["families"])) for m in row["members"])))


def unshelved(kept: bytes) -> dict:
    anchor, score, weight, families, members = marshal.loads(kept)
    return {"anchor": anchor, "score": score, "weight": weight, "families": families, "mandatory": False, "members": [{"id": i, "score": s, "weight": w, "families": f} for i, s, w, f in members]}


def streamed(bundles: DataFrame, budgets: DataFrame, how: Greedy) -> DataFrame:
    """The choice of each case as a ledger: (case, step, anchor, edge_id, gain), one row for each event taken; step 0 is mandatory."""
    rows = bundles.join(budgets, "case").repartition("case").sortWithinPartitions("case", F.desc("mandatory"), F.desc("bound"), "anchor")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        row = next(stream, None)
        while row is not None:
            case, budget, ahead = row["case"], row["budget"], [row]

            def own(case: str = case, ahead: list = ahead) -> Iterator[dict]:
                while ahead[0] is not None and ahead[0]["case"] == case:
                    now = ahead[0]
                    ahead[0] = next(stream, None)
                    yield now

            it = own()
            found = iter(how(it, budget))
            while some := list(itertools.islice(found, FEW)):
                yield pa.RecordBatch.from_pylist([{"case": case, "step": s, "anchor": a, "edge_id": e, "gain": g} for s, a, e, g in some], pa.schema([("case", pa.string()), ("step", pa.int32()), ("anchor", pa.int64()), ("edge_id", pa.int64()), ("gain", pa.float64())]))
            for _ in it:  # what was not needed
                pass
            row = ahead[0]

    return rows.mapInArrow(choose, LEDGER)


def _lazy(rows: Iterator[dict], budget: int, gain: Callable[[dict], float], take: Callable[[dict], None], least: float | None) -> Taken:
    """Again and again the anchor of the largest gain (ties: the smaller id) whose missing members fit. Gains never rise.

    take is told each event that enters and counts by itself. An anchor whose gain is at most `least` is out for good.
    """
    kept: set[int] = set()
    heap: list[tuple[float, int, bytes]] = []

    def enter(row: dict, step: int, value: float) -> Taken:
        new = [m for m in row["members"] if m["id"] not in kept] if not row["mandatory"] else [m for m in row["members"] if m["id"] == row["anchor"]]
        for m in new:
            kept.add(m["id"])
            if m["score"] is not None:
                take(m)
            yield step, row["anchor"], m["id"], value

    ahead = next(rows, None)
    while ahead is not None and ahead["mandatory"]:
        yield from enter(ahead, 0, 0.0)
        ahead = next(rows, None)
    step = 0
    while len(kept) < budget:
        while ahead is not None and (not heap or ahead["bound"] * ROUNDING >= -heap[0][0]):
            heapq.heappush(heap, (-gain(ahead), ahead["anchor"], shelved(ahead)))
            ahead = next(rows, None)
        if not heap:
            break
        _, anchor, shelf = heapq.heappop(heap)
        if anchor in kept:
            continue
        row = unshelved(shelf)
        now = gain(row)
        if least is not None and now <= least:
            continue
        if (heap and (-now, anchor) > heap[0][:2]) or (ahead is not None and ahead["bound"] * ROUNDING >= now):
            heapq.heappush(heap, (-now, anchor, shelf))
            continue
        if len(kept) + sum(m["id"] not in kept for m in row["members"]) <= budget:
            step += 1
            yield from enter(row, step, now)


def by_coverage(rows: Iterator[dict], budget: int) -> Taken:
    """By what an anchor adds to what its families have so far; a family counts its best score only. Bound: the score."""
    covered: dict[tuple[int, str], float] = {}

    def gain(r: dict) -> float:
        return sum(max(r["score"] - covered.get(f, 0.0), 0.0) for f in enumerate(r["families"])) / len(r["families"])

    def take(m: dict) -> None:
        for f in enumerate(m["families"]):
            covered[f] = max(covered.get(f, 0.0), m["score"])

    return _lazy(rows, budget, gain, take, 0.0)


QUALITY = 0.05  # weight of plain evidence beside the families' diminishing one


def diminishing_bound(quality: float = QUALITY) -> Column:
    s, w = F.col("score"), F.col("weight")
    return F.when(w > 0, (1 - quality) * w * F.log1p(s / w) + quality * s).otherwise(0.0)


def diminishing(rows: Iterator[dict], budget: int, quality: float = QUALITY) -> Taken:
    """Each family's further evidence counts less: its mass enters as ln(1 + mass / weight)."""
    mass: dict[str, float] = {}

    def gain(r: dict) -> float:
        w, m = r["weight"], mass.get(r["families"][0], 0.0)
        return (1 - quality) * w * (math.log1p((m + r["score"]) / w) - math.log1p(m / w)) + quality * r["score"] if w > 0 else 0.0

    def take(m: dict) -> None:
        mass[m["families"][0]] = mass.get(m["families"][0], 0.0) + m["score"]

    return _lazy(rows, budget, gain, take, None)


def evidence_bound(quality: float = QUALITY) -> Column:
    """No ratio of gain to cost is above the best member's own gain on empty families, as gains of sums are at most sums of gains."""
    return F.array_max(F.transform("members", lambda m: F.coalesce(F.when(m["weight"] > 0, (1 - quality) * m["weight"] * F.log1p(m["score"] / m["weight"]) + quality * m["score"]), F.lit(0.0))))


def by_evidence(rows: Iterator[dict], budget: int, quality: float = QUALITY) -> Taken:
    """The bundle of the most objective an event that it adds, over all its missing members; ties: the larger gain, then the smaller id.

    The objective is quality * mass + (1 - quality) * sum of weight * ln(1 + mass / weight) over families. Ratios fall as families
    fill and may rise when members enter with others, so anchors that share a new member are valued again at once.
    """
    kept: set[int] = set()
    mass: dict[str, float] = {}
    having: dict[int, list[int]] = {}  # the waiting anchors of each missing event; an anchor that is taken itself waits no more
    shelf: dict[int, bytes] = {}
    heap: list[tuple[float, float, int, int]] = []
    version: dict[int, int] = {}

    def value(r: dict) -> tuple[float, float, int]:
        """Ratio, gain and cost now."""
        add: dict[str, float] = {}
        weight: dict[str, float] = {}
        cost = 0
        for m in r["members"]:
            if m["id"] not in kept:
                cost += 1
                if m["score"] is not None and m["score"] > 0:
                    f = m["families"][0]
                    add[f] = add.get(f, 0.0) + m["score"]
                    weight[f] = m["weight"]
        gain = sum(quality * d + (1 - quality) * weight[f] * math.log1p(d / (weight[f] + mass.get(f, 0.0))) for f, d in sorted(add.items()))
        return (gain / cost if cost else 0.0, gain, cost)

    def push(r: dict) -> None:
        anchor = r["anchor"]
        ratio, gain, cost = value(r)
        if cost and gain > 0 and anchor not in kept:
            version[anchor] = version.get(anchor, 0) + 1
            heapq.heappush(heap, (-ratio, -gain, anchor, version[anchor]))
            if len(heap) > 2 * len(version) + 1000:  # most are out of date
                heap[:] = [h for h in heap if version.get(h[2]) == h[3]]
                heapq.heapify(heap)
        else:
            drop(anchor)

    def drop(anchor: int) -> None:
        version.pop(anchor, None)
        shelf.pop(anchor, None)

    def enter(ids: list[dict], anchor: int, step: int, gain: float) -> Taken:
        touched: set[int] = set()
        for m in ids:
            kept.add(m["id"])
            drop(m["id"])
            if m["score"] is not None and m["score"] > 0:
                mass[m["families"][0]] = mass.get(m["families"][0], 0.0) + m["score"]
            touched.update(having.pop(m["id"], ()))
            yield step, anchor, m["id"], gain
        for a in touched:
            if a in shelf:
                push(unshelved(shelf[a]))

    ahead = next(rows, None)
    while ahead is not None and ahead["mandatory"]:
        yield from enter([m for m in ahead["members"] if m["id"] == ahead["anchor"]], ahead["anchor"], 0, 0.0)
        ahead = next(rows, None)
    step = 0
    while len(kept) < budget:
        while ahead is not None and (not heap or ahead["bound"] * ROUNDING >= -heap[0][0]):
            if ahead["anchor"] not in kept:
                shelf[ahead["anchor"]] = shelved(ahead)
                for m in ahead["members"]:
                    if m["id"] != ahead["anchor"] and m["id"] not in kept:
                        having.setdefault(m["id"], []).append(ahead["anchor"])
                push(ahead)
            ahead = next(rows, None)
        if not heap:
            break
        ratio, gain, anchor, seen = heapq.heappop(heap)
        if seen != version.get(anchor):
            continue
        row = unshelved(shelf[anchor])
        now = value(row)
        if (-now[0], -now[1]) != (ratio, gain):
            push(row)
            continue
        if now[2] <= budget - len(kept):  # one that does not fit never will
            step += 1
            yield from enter([m for m in row["members"] if m["id"] not in kept], anchor, step, now[1])
        drop(anchor)
