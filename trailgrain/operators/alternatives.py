"""Up to k alternative forks for each event: chains along time from a pivot that itself leads to a point of interest.

Labels (depth, parent, parent's slot, pivot) come depth by depth. In a round the labels of one depth and the events that still have
room meet at their node in time order; a stream over each node's rows remembers the k best labels so far and nothing else.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut

LABEL = "edge_id long, slot int, depth int, parent long, parent_slot int, pivot long"


def _offers(labels: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """For each ask (edge_id, node, t) the k labels (node, t, parent, parent_slot, pivot) of the smallest parent and slot strictly before it."""
    schema = pa.schema([("edge_id", pa.int64()), ("parent", pa.int64()), ("parent_slot", pa.int32()), ("pivot", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, best = None, []
        for b in batches:
            out = []
            for n, _, asks_, edge, parent, slot, pivot in zip(*(b.column(c).to_pylist() for c in ("node", "t", "asks", "edge_id", "parent", "parent_slot", "pivot")), strict=True):
                if n != node:
                    node, best = n, []
                if asks_:
                    out += [{"edge_id": edge, "parent": p, "parent_slot": s, "pivot": v} for p, s, v in best]
                else:
                    best = heapq.nsmallest(k, [*best, (parent, slot, pivot)])
            yield pa.RecordBatch.from_pylist(out, schema)

    come = labels.select("node", "t", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("edge_id"), "parent", "parent_slot", "pivot")
    ask = asks.select("node", "t", F.lit(True).alias("asks"), "edge_id", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("parent_slot"), F.lit(None).cast("long").alias("pivot"))
    rows = come.unionByName(ask).repartition("node").sortWithinPartitions("node", "t", F.desc("asks"))  # at one time asks come before labels
    return rows.mapInArrow(meet, "edge_id long, parent long, parent_slot int, pivot long")


def fork_labels(events: DataFrame, back: DataFrame, k: int = 3) -> DataFrame:
    """LABEL rows of events (edge_id, src, dst, t): the k shallowest forks, ties to the own chain, then the smallest parent and slot.

    back: (edge_id, depth) of events with a strict chain to a point of interest; such an event is a pivot and offers both its ends.
    """
    if k < 1:
        raise ValueError("k must be positive")
    events = cut(events.select("edge_id", "src", "dst", "t"))
    own = cut(back.select("edge_id", F.col("depth").cast("int").alias("depth")))
    deepest = own.agg(F.max("depth")).first()[0]
    empty = own.sparkSession.createDataFrame([], LABEL)
    found, last = empty, empty
    for depth in itertools.count():
        used = found.groupBy("edge_id").agg(F.count("*").alias("used"))
        room = events.join(used, "edge_id", "left").select("edge_id", "src", "t", F.coalesce("used", F.lit(0)).alias("used")).where(F.col("used") < k)
        at = last.join(events, "edge_id")
        ends = F.when(F.col("pivot") == F.col("edge_id"), F.array_distinct(F.array("src", "dst"))).otherwise(F.array("dst"))
        offers = at.select(F.explode(ends).alias("node"), "t", F.col("edge_id").alias("parent"), F.col("slot").alias("parent_slot"), "pivot")
        asks = room.select("edge_id", F.col("src").alias("node"), "t").join(offers.select("node").distinct(), "node", "left_semi")
        mine = own.where(F.col("depth") == depth).select("edge_id", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("parent_slot"), F.col("edge_id").alias("pivot"))
        new = _offers(cut(offers), asks, k).unionByName(mine).join(room.select("edge_id", "used"), "edge_id")
        place = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.col("parent").asc_nulls_first(), "parent_slot", "pivot"))  # k + 1 rows an event at most
        new = new.withColumn("slot", F.col("used") + place - 1).where(F.col("slot") < k)
        last = cut(new.select("edge_id", F.col("slot").cast("int").alias("slot"), F.lit(depth).alias("depth"), "parent", "parent_slot", "pivot"))
        if last.isEmpty() and (deepest is None or depth >= deepest):
            return found
        found = cut(found.unionByName(last))


def witnesses(labels: DataFrame, back: DataFrame, k: int = 3) -> DataFrame:
    """(anchor, slot, part, position, edge_id): the forward chain of each label from the anchor to its pivot, and the pivot's chain back (edge_id, next).

    Of labels of an anchor that make the same set of events the first stays, and its slots are numbered anew.
    """
    links = cut(labels.select(F.col("edge_id").alias("at"), F.col("slot").alias("at_slot"), "parent", "parent_slot"))
    front = labels.select(F.col("edge_id").alias("anchor"), "slot", F.col("edge_id").alias("at"), F.col("slot").alias("at_slot"))
    out = []
    for position in itertools.count():
        front = cut(front)
        if front.isEmpty():
            break
        out.append(front.select("anchor", "slot", F.lit("forward").alias("part"), F.lit(position).alias("position"), F.col("at").alias("edge_id")))
        front = front.join(links, ["at", "at_slot"]).where("parent is not null").select("anchor", "slot", F.col("parent").alias("at"), F.col("parent_slot").alias("at_slot"))
    after = cut(back.select(F.col("edge_id").alias("at"), "next"))
    front = labels.select(F.col("edge_id").alias("anchor"), "slot", F.col("pivot").alias("at"))
    for position in itertools.count():
        front = cut(front)
        if front.isEmpty():
            break
        out.append(front.select("anchor", "slot", F.lit("back").alias("part"), F.lit(position).alias("position"), F.col("at").alias("edge_id")))
        front = front.join(after, "at").where("next is not null").select("anchor", "slot", F.col("next").alias("at"))
    rows = labels.limit(0).select(F.col("edge_id").alias("anchor"), "slot", F.lit("").alias("part"), F.lit(0).alias("position"), "edge_id")
    for o in out:
        rows = rows.unionByName(o)
    # An anchor's ways are moved once, as lists: all that follows goes by anchor.
    ways = rows.repartition("anchor").groupBy("anchor", "slot").agg(F.collect_list(F.struct("part", "position", "edge_id")).alias("way"))
    sets = ways.withColumn("events", F.array_sort(F.array_distinct(F.transform("way", lambda e: e["edge_id"]))))
    first = sets.groupBy("anchor", "events").agg(F.min_by("way", "slot").alias("way"), F.min("slot").alias("slot")).withColumn("new", F.row_number().over(Window.partitionBy("anchor").orderBy("slot")) - 1)
    return first.select("anchor", F.col("new").alias("slot"), F.explode("way").alias("e")).select("anchor", "slot", "e.*")


def witness_faults(rows: DataFrame, events: DataFrame, pois: DataFrame) -> DataFrame:
    """Links of witnesses that are not directed and strictly in time, and witnesses that do not end at a point of interest: (anchor, slot, fault)."""
    own = events.select("edge_id", "src", "dst", "t").join(pois.select("edge_id", F.lit(True).alias("poi")), "edge_id", "left").fillna(False, ["poi"])
    at = rows.join(own.withColumn("known", F.lit(True)), "edge_id", "left")  # events that are not known link nothing
    whole, w = Window.partitionBy("anchor", "slot"), Window.partitionBy("anchor", "slot").orderBy("part", "position")
    ahead_of = {f"p_{c}": F.lead(c).over(w) for c in ("part", "position", "src", "dst", "t", "poi", "known")}
    links = at.withColumns(ahead_of | {"end": F.max(F.when(F.col("known") & (F.col("part") == "forward"), F.col("position"))).over(whole)})
    linked = F.expr("known and p_known and p_part = part and p_position = position + 1")
    pivot = F.col("position") + 1 == F.col("end")
    ahead = ((F.col("p_dst") == F.col("src")) | (pivot & (F.col("p_src") == F.col("src")))) & (F.col("p_t") < F.col("t"))
    behind = ((F.col("dst") == F.col("p_src")) | (F.col("p_poi") & (F.col("dst") == F.col("p_dst")))) & (F.col("t") < F.col("p_t"))
    broken = F.max(linked & F.col("end").isNotNull() & ~F.when(F.col("part") == "forward", ahead).otherwise(behind))
    back = F.when(F.col("known") & (F.col("part") == "back"), F.col("position"))
    found = links.groupBy("anchor", "slot").agg(broken.alias("broken"), F.max_by("poi", back).alias("poi"))
    faults = F.array_compact(F.array(F.when(F.col("broken"), "broken link"), F.when(~F.coalesce("poi", F.lit(False)), "no point of interest")))
    return found.select("anchor", "slot", F.explode(faults).alias("fault"))
