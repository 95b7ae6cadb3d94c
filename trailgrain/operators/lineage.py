"""Execution lineage from corroborated processes: their launchers and the descendants within bounds of depth and time, with the events that show it.

A process has one birth, the first creation of it, so lineage is a tree and a round is one generation: an equi-join of births with the
processes of the generation before. Chains hold at most `depth` events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut

SECOND = 1_000_000_000
LINEAGE = "process string, kind string, root string, depth int, since long, expires long, chain array<long>"


@dataclass(frozen=True)
class Bounds:
    depth: int = 4
    lineage_s: float = 600.0
    launcher_s: float = 120.0

    def __post_init__(self) -> None:
        if self.depth < 0 or self.lineage_s < 0 or self.launcher_s < 0:
            raise ValueError("bounds are not negative")


def births(created: DataFrame, ended: DataFrame) -> DataFrame:
    """(process, parent, event, born, gone) of creations (edge_id, parent, process, t) and terminations (process, t): the first creation, and the first end from then on (null if none)."""
    first = created.groupBy("process").agg(F.min(F.struct("t", "edge_id", "parent")).alias("m"))
    first = first.select("process", "m.parent", F.col("m.edge_id").alias("event"), F.col("m.t").alias("born"))
    end = ended.join(first.select("process", "born"), "process").where("t >= born").groupBy("process").agg(F.min("t").alias("gone"))
    return first.join(end, "process", "left")


def lineage(own: DataFrame, roots: DataFrame, interpreters: DataFrame, b: Bounds | None = None) -> DataFrame:
    """LINEAGE rows of births for roots (process) and interpreters (process).

    root: depth 0, its lineage expires after lineage_s. launcher: an interpreter, born at most launcher_s before, that made a root while alive;
    of several roots the smallest name counts. descendant: born of a process of the lineage after that one's start, before its end and
    within the root's time. Roots without a birth and repeated rows add nothing. chain: the creations from the root or launcher on.
    """
    b = b or Bounds()
    own = cut(own)
    named = own.join(roots.select("process").distinct(), "process", "left_semi")
    first = named.select("process", F.lit("root").alias("kind"), F.col("process").alias("root"), F.lit(0).alias("depth"), F.col("born").alias("since"), (F.col("born") + int(b.lineage_s * SECOND)).alias("expires"), F.array().cast("array<long>").alias("chain"))
    parents = own.join(interpreters.select("process").distinct(), "process", "left_semi").select(F.col("process").alias("parent"), F.col("event").alias("p_event"), F.col("born").alias("p_born"), F.col("gone").alias("p_gone"))
    made = named.join(parents, "parent").join(named.select(F.col("process").alias("parent")), "parent", "left_anti")
    made = made.where((F.col("born") > F.col("p_born")) & (F.col("born") - F.col("p_born") <= int(b.launcher_s * SECOND)) & (F.col("p_gone").isNull() | (F.col("born") < F.col("p_gone"))))
    best = made.groupBy("parent").agg(F.min(F.struct("process", "born", "event", "p_event", "p_born")).alias("m"))
    launchers = best.select(F.col("parent").alias("process"), F.lit("launcher").alias("kind"), F.col("m.process").alias("root"), F.lit(0).alias("depth"), F.col("m.p_born").alias("since"), (F.col("m.born") + int(b.lineage_s * SECOND)).alias("expires"), F.array("m.p_event", "m.event").alias("chain"))
    front = found = cut(first.unionByName(launchers))
    fixed = found.select("process")
    for depth in range(1, b.depth + 1):
        at = front.join(own.select("process", "gone"), "process").select(F.col("process").alias("parent"), "kind", "root", "since", "expires", "chain", "gone")
        child = own.drop("gone").join(at, "parent").where("born > since and born <= expires and (gone is null or born < gone)").join(fixed, "process", "left_anti")
        chain = F.concat(F.when(F.col("kind") == "launcher", F.array().cast("array<long>")).otherwise(F.col("chain")), F.array("event"))
        front = cut(child.select("process", F.lit("descendant").alias("kind"), "root", F.lit(depth).alias("depth"), F.col("born").alias("since"), "expires", chain.alias("chain")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def lineage_faults(rows: DataFrame, own: DataFrame, roots: DataFrame, interpreters: DataFrame, b: Bounds | None = None) -> DataFrame:
    """(process, fault) of LINEAGE rows that do not replay from births: root, expiry, launcher, depth, link, end, target."""
    b = b or Bounds()
    own = cut(own)
    top = own.join(roots.select("process").distinct(), "process", "left_semi").select(F.col("process").alias("root"), F.col("parent").alias("r_parent"), F.col("born").alias("r_born"), F.col("event").alias("r_event"))
    shell = own.join(interpreters.select("process").distinct(), "process", "left_semi").select(F.col("process").alias("r_parent"), F.col("event").alias("s_event"), F.col("born").alias("s_born"), F.col("gone").alias("s_gone"))
    at = cut(rows.join(top.join(shell, "r_parent", "left"), "root", "left"))
    launched = F.expr(f"coalesce(r_born > s_born and r_born - s_born <= {int(b.launcher_s * SECOND)} and (s_gone is null or r_born < s_gone), false)")
    empty = F.size("chain") == 0
    out = [(F.col("r_born").isNull(), "root"), (F.col("expires") != F.col("r_born") + int(b.lineage_s * SECOND), "expiry")]
    out += [((F.col("kind") == "root") & ~((F.col("process") == F.col("root")) & empty & (F.col("depth") == 0) & (F.col("since") == F.col("r_born"))), "root")]
    out += [((F.col("kind") == "launcher") & ~(launched & (F.col("process") == F.col("r_parent")) & (F.col("depth") == 0) & (F.col("since") == F.col("s_born")) & (F.col("chain") == F.array("s_event", "r_event"))), "launcher")]
    out += [((F.col("kind") == "descendant") & ~((F.size("chain") == F.col("depth")) & (F.col("depth") <= b.depth) & ~empty), "depth"), (~F.col("kind").isin("root", "launcher", "descendant"), "kind")]
    flat = at.select("process", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in out])).alias("faults"))
    flat = flat.select("process", F.explode(F.array_distinct("faults")).alias("fault"))
    # Each link against its birth and the one before it.
    links = at.where("kind = 'descendant'").select("process", "root", "since", "expires", "r_born", "r_parent", "s_born", launched.alias("launched"), F.posexplode("chain").alias("i", "event"), F.size("chain").alias("n"))
    born = own.select(F.col("event"), F.col("process").alias("child"), "parent", "born")
    at_link = cut(links.join(born, "event", "left").join(own.select(F.col("process").alias("parent"), F.col("gone").alias("p_gone")), "parent", "left"))
    before = at_link.select("process", (F.col("i") + 1).alias("i"), F.col("child").alias("b_child"), F.col("born").alias("b_born"))
    at_link = at_link.join(before, ["process", "i"], "left")
    start = F.when(F.col("parent") == F.col("root"), F.col("r_born")).when((F.col("parent") == F.col("r_parent")) & F.col("launched"), F.col("s_born"))
    since = F.when(F.col("i") == 0, start).when(F.col("b_child") == F.col("parent"), F.col("b_born"))
    fine = F.coalesce((F.col("born") > since) & (F.col("born") <= F.col("expires")), F.lit(False))
    bad = [(~fine, "link"), (F.coalesce(F.col("p_gone") <= F.col("born"), F.lit(False)), "end")]
    bad += [((F.col("i") == F.col("n") - 1) & ~F.coalesce((F.col("child") == F.col("process")) & (F.col("born") == F.col("since")), F.lit(False)), "target")]
    more = at_link.select("process", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in bad]))).alias("fault"))
    return flat.unionByName(more).distinct()


def execution_chains(own: DataFrame, processes: DataFrame, most: int = 12) -> DataFrame:
    """(process, position, event, parent): the births that led to each process, its own first, at most so many; it ends at a process without a birth or born no earlier."""
    own = cut(own.select("process", "parent", "event", "born"))
    front = processes.select("process", F.col("process").alias("at"), F.lit(None).cast("long").alias("later")).distinct()
    found = None
    for position in range(most):
        step = front.join(own.withColumnRenamed("process", "at"), "at").where("later is null or born < later")
        step = cut(step.select("process", F.lit(position).alias("position"), "event", "parent", "born"))
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            break
        front = step.select("process", F.col("parent").alias("at"), F.col("born").alias("later"))
    return found.drop("born")
