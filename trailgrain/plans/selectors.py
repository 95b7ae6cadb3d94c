"""Queries: events chosen with their witnesses under a cap. The choice is sequential, so there is no SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import audits as A
from trailgrain.operators import bundles as B
from trailgrain.operators import sessions as S
from trailgrain.operators.graph import cut, followed
from trailgrain.operators.paths import next_events
from trailgrain.plans.diffusion import forked
from trailgrain.plans.ranking import select_mass
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, pois, rounded_rarity

DAY = 24 * HOUR
SHARE = 10  # a case keeps one of so many of its events


def witnessed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with score and witness, one case being the whole graph, and the pointers of witnesses."""
    rated = cut(rounded_rarity(edges))
    unit = rated.select("edge_id", "src", "dst", F.col("timestamp_ns").alias("t"), F.lit(1.0).alias("cf"), F.lit(1.0).alias("cb"))
    pointers = cut(forked(unit, pois(rated), None))
    own = pois(rated).select("edge_id", F.lit(True).alias("mandatory"))
    rows = rated.join(pointers, "edge_id").join(own, "edge_id", "left").fillna(False, ["mandatory"])
    score = F.when(F.col("mandatory"), 1.0).otherwise(F.col("rarity") / (1 + F.col("cost")))
    rows = rows.withColumn("score", F.round(score, 9)).withColumn("case", F.lit("graph"))
    channel, meaning = F.concat_ws("|", "src", "dst", "relation"), F.concat_ws("|", "src_semantic", "dst_semantic", "relation")
    return rows.withColumn("channel", channel).withColumn("meaning", meaning), pointers


def budgets(edges: DataFrame, case: Column) -> DataFrame:
    return edges.groupBy(case.alias("case")).agg(F.count("*").alias("n")).select("case", F.expr(f"n div {SHARE}").alias("budget"))


def packed(edges: DataFrame, rows: DataFrame, parts: DataFrame) -> DataFrame:
    return B.packed(rows, parts, budgets(edges, F.lit("graph"))).select("edge_id")


def by_host(edges: DataFrame, families: list[str], bound: Column, how: B.Greedy) -> DataFrame:
    """The ledger of a streamed choice, each host being a case."""
    rows, pointers = witnessed(edges)
    rows = cut(B.eligible(rows).withColumn("case", F.col("host")))
    bundles = B.bundled(rows, B.members(rows.select("edge_id"), pointers), families, bound)
    return B.streamed(bundles, budgets(edges, F.col("host")), how)


@edge_query(None)
def select_routes(edges: DataFrame) -> DataFrame:
    """The best events with their whole routes to a point of interest, under one budget for the graph."""
    rows, pointers = witnessed(edges)
    rows = cut(B.eligible(rows.where("pivot = edge_id")))
    return packed(edges, rows, B.members(rows.select("edge_id"), pointers))


@edge_query(None)
def select_forks(edges: DataFrame) -> DataFrame:
    """The best events with their whole forks, under one budget for the graph."""
    rows, pointers = witnessed(edges)
    rows = cut(B.eligible(rows))
    return packed(edges, rows, B.members(rows.select("edge_id"), pointers))


@edge_query(None)
def select_diverse(edges: DataFrame) -> DataFrame:
    """Forks by gains that diminish in each channel, under a budget for each host."""
    return by_host(edges, ["channel"], B.diminishing_bound(), B.diminishing).select("case", "edge_id")


@edge_query(None)
def select_coverage(edges: DataFrame) -> DataFrame:
    """Forks by what they add to channels and meanings, under a budget for each host."""
    return by_host(edges, ["channel", "meaning"], F.col("score"), B.by_coverage).select("case", "edge_id")


@edge_query(None)
def select_evidence(edges: DataFrame) -> DataFrame:
    """The ledger of the choice by evidence an added event: (case, step, anchor, edge_id, gain)."""
    return by_host(edges, ["channel"], B.evidence_bound(), B.by_evidence).withColumn("gain", F.round("gain", 9))


@edge_query(None)
def evidence_reasons(edges: DataFrame) -> DataFrame:
    """Why each event is kept or not by the choice by evidence: (edge_id, reason)."""
    rows, pointers = witnessed(edges)
    rows = cut(rows.withColumn("case", F.col("host")))
    parts, limits, taken = evidence(edges, rows, pointers)
    return A.reasons(edges.select("edge_id", F.col("host").alias("case")), rows, parts, taken, limits)


@edge_query(None)
def evidence_objective(edges: DataFrame) -> DataFrame:
    """What each host's choice attains, beside what all its evidence would without a budget: (case, attained, upper, share)."""
    rows, pointers = witnessed(edges)
    rows = cut(rows.withColumn("case", F.col("host")))
    _, _, taken = evidence(edges, rows, pointers)
    found = A.objective(B.eligible(rows), taken)
    return found.select("case", *[F.round(c, 6).alias(c) for c in ("attained", "upper", "share")])


@edge_query(None)
def evidence_faults(edges: DataFrame) -> DataFrame:
    """Faults that a replay of the ledger finds, first of the ledger itself and then of one with planted faults: (ledger, fault, rows)."""
    rows, pointers = witnessed(edges)
    rows = cut(rows.withColumn("case", F.col("host")))
    parts, limits, taken = evidence(edges, rows, pointers)
    last = taken.groupBy("case").agg(F.max("step").alias("last"))
    marked = taken.join(last, "case")
    broken = marked.where("not (step = last and edge_id = anchor)").withColumn("gain", F.when(F.col("step") == 1, F.col("gain") + 1).otherwise(F.col("gain"))).drop("last")
    both = [A.faults(B.eligible(rows), parts, t, limits).select(F.lit(name).alias("ledger"), "fault", "rows") for name, t in (("own", taken), ("planted", cut(broken)))]
    return both[0].unionByName(both[1])


def evidence(edges: DataFrame, rows: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of all anchors, budgets, and the ledger."""
    own = cut(B.eligible(rows))
    parts = cut(B.members(own.select("edge_id"), pointers))
    limits = cut(budgets(edges, F.col("host")))
    return parts, limits, cut(B.streamed(B.bundled(own, parts, ["channel"], B.evidence_bound()), limits, B.by_evidence))


@edge_query(None)
def select_episodes(edges: DataFrame) -> DataFrame:
    """The best event of each episode with the whole episode and its fork, under one budget for the graph."""
    rows, pointers = witnessed(edges)
    episode = cut(S.bounded_episodes(edges, ["src", "dst", "relation"], DAY).select("edge_id", F.concat_ws("|", "src", "dst", "relation", F.col("start").cast("string")).alias("episode")))
    best = rows.join(episode, "edge_id").groupBy("episode").agg(F.max_by("edge_id", F.struct("mandatory", "score", (-F.col("edge_id")).alias("t"))).alias("edge_id"))
    heads = cut(B.eligible(rows.join(best.select("edge_id"), "edge_id", "left_semi").unionByName(rows.where("mandatory")).distinct()))
    whole = heads.select("edge_id").join(episode, "edge_id").select(F.col("edge_id").alias("anchor"), "episode").join(episode.withColumnRenamed("edge_id", "member"), "episode").select("anchor", "member")
    return packed(edges, heads, B.members(heads.select("edge_id"), pointers).union(whole).distinct())


@edge_query(None)
def select_mass_closed(edges: DataFrame) -> DataFrame:
    """Events that hold most of their relation's score, with the chains of events that follow them."""
    return followed(select_mass(edges).select("edge_id"), next_events(edges))
