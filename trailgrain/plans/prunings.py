"""Queries: pruning of each host's events, cheapest bridges and ways between stages. Admission and ties are sequential, so there is no SQL; tests hold the operators against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import bridges as B
from trailgrain.operators import ordered as O
from trailgrain.operators import pruning as P
from trailgrain.operators import sessions as S
from trailgrain.operators.graph import cut
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, pois, rarity_escape, rounded_rarity

KEEP, WEEK = 0.2, 7 * 24 * HOUR


def scored(edges: DataFrame) -> DataFrame:
    return cut(rounded_rarity(edges).withColumn("score", F.col("rarity")))


def candidates(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their groups, runs of one dependency without a gap of more than a week, and the bridges to points of interest; a case is a host."""
    rated = scored(edges)
    keys = ["src", "dst", "relation"]
    bursts = cut(S.bounded_episodes(edges, keys, WEEK).select("edge_id", *keys, "start"))
    group = bursts.groupBy(*keys, "start").agg(F.min("edge_id").alias("group")).join(bursts, [*keys, "start"]).select("edge_id", "group")
    hosts = rated.select("edge_id", "host").withColumnRenamed("edge_id", "group")
    own = rated.join(group, "edge_id").join(hosts.withColumnRenamed("host", "case"), "group")  # a run is on the host of its first event
    goals = pois(edges).select("edge_id")
    own = own.join(goals.withColumn("mandatory", F.lit(True)), "edge_id", "left").join(rarity_escape(edges), "edge_id")
    events = own.select("case", "edge_id", "group", "score", "mandatory", F.lit(False).alias("previous"), "escape")
    return cut(events), cut(B.bridge_events(B.bridges(rated, goals)).select("edge_id", "bridge"))


def prune(edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """What stays and its account, without an earlier result or a quota."""
    return P.pruned(*candidates(edges), KEEP, mode)


def _events(edges: DataFrame, mode: str) -> DataFrame:
    return prune(edges, mode)[0].select("case", "edge_id", "reason", "bridge", "previous")


@edge_query(None)
def prune_ratio(edges: DataFrame) -> DataFrame:
    """What stays if admission ends at the first group that does not fit: (case, edge_id, reason, bridge, previous)."""
    return _events(edges, "ratio")


@edge_query(None)
def prune_adaptive(edges: DataFrame) -> DataFrame:
    """The same, ended by the widest gap between scores."""
    return _events(edges, "adaptive")


@edge_query(None)
def prune_guard(edges: DataFrame) -> DataFrame:
    """The same, passing over groups that do not fit."""
    return _events(edges, "rdp_guard")


@edge_query(None)
def prune_account(edges: DataFrame) -> DataFrame:
    """Budgets, sums and bounds of each host under the guard mode."""
    found = prune(edges, "rdp_guard")[1]
    return found.withColumns({c: F.round(c, 6) for c in ("threshold", "mass_share", "jaccard")})


@edge_query(None)
def cost_bridges(edges: DataFrame) -> DataFrame:
    """The cheapest later continuation of each event to a point of interest: (edge_id, cost, next)."""
    return B.bridges(scored(edges), pois(edges).select("edge_id")).withColumn("cost", F.round("cost", 6))


def stages(edges: DataFrame) -> DataFrame:
    """The points of interest of each host in time order, as one sequence: (sequence, position, edge_id)."""
    own = edges.join(pois(edges).select("edge_id"), "edge_id", "left_semi")
    return O.ranked(own, ["host"], ["timestamp_ns", "edge_id"]).select(F.col("host").alias("sequence"), "edge_id", (F.col("place") - 1).alias("position"))


@edge_query(None)
def stage_ways(edges: DataFrame) -> DataFrame:
    """The cheapest way between neighbouring points of interest of a host: (pair, position, edge_id), the events between."""
    return B.stage_paths(scored(edges), B.stage_pairs(stages(edges)))[1]


@edge_query(None)
def stage_certificates(edges: DataFrame) -> DataFrame:
    """Whether each host's points of interest and the ways between them outlast the guard mode: (case, expected, retained, pairs, status).

    The events of the ways are mandatory, as points of interest are.
    """
    rated, pairs = scored(edges), cut(B.stage_pairs(stages(edges)))
    before, ways = B.stage_paths(rated, pairs)
    events, links = candidates(edges)
    backbone = ways.select("edge_id").distinct().withColumn("way", F.lit(True))
    events = events.join(backbone, "edge_id", "left").withColumn("mandatory", F.coalesce("mandatory", "way")).drop("way")
    kept, account = P.pruned(events, links, KEEP, "rdp_guard")
    after, _ = B.stage_paths(rated.join(kept.select("edge_id"), "edge_id", "left_semi"), pairs)
    goals = edges.join(pois(edges).select("edge_id"), "edge_id", "left_semi").select(F.col("host").alias("case"), "edge_id")
    of = pairs.select("pair", "sequence", F.col("sequence").alias("case"))
    return P.certificates(account, goals, kept, before.join(of, "pair"), after.join(of, "pair"))
