"""Queries: a ledger written, loaded and checked. Each check reads the stored artifacts, in which faults are planted, and must find just those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ledger as L
from trailgrain.operators.graph import cut
from trailgrain.plans.metrics import CHAINS, DAY, own_chains
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import POI, POIS, pois, rounded_rarity

BUDGETS, CUTOFF, STEP = {"five": 0.05, "twenty": 0.2}, 0.1, 101

SCORES = f"""{POIS}, part AS (SELECT e.edge_id, p.edge_id AS poi, round(1 / (1 + abs(e.timestamp_ns - p.timestamp_ns) / CAST({DAY} AS DOUBLE)), 6) AS s FROM edges e JOIN pois p ON e.dst = p.src),
agg AS (SELECT edge_id, 1 - product(1 - s) AS score, count(*) AS support FROM part GROUP BY ALL),
led AS (SELECT e.edge_id, coalesce(score, 0) AS score, coalesce(support, 0) AS support, row_number() OVER (ORDER BY coalesce(score, 0) DESC, e.edge_id) AS rank, count(*) OVER () AS n FROM edges e LEFT JOIN agg USING (edge_id))"""


def contributions(edges: DataFrame) -> DataFrame:
    p = pois(edges).select(F.col("edge_id").alias("poi"), F.col("src").alias("dst"), F.col("timestamp_ns").alias("t"))
    return edges.join(p, "dst").select("edge_id", "poi", F.round(1 / (1 + F.abs(F.col("timestamp_ns") - F.col("t")) / float(DAY)), 6).alias("s"))


_LEDGERS: dict[tuple, str] = {}


def stored(edges: DataFrame) -> str:
    """The folder of the ledger of these events; an application writes it once."""
    context = edges.sparkSession.sparkContext
    name = (context.applicationId, *sorted(edges.inputFiles()))
    if name not in _LEDGERS:
        rated = cut(rounded_rarity(edges))
        given = cut(contributions(rated))
        rows = L.build(rated, given, pois(rated), BUDGETS, CUTOFF)
        _LEDGERS[name] = L.write(context.getCheckpointDir(), rows, given, own_chains(edges))
    return _LEDGERS[name]


def check(sql: str) -> Callable:
    """Register a check of a stored ledger: a function of (edges, load), load giving an artifact's rows."""
    def register(f: Callable) -> Callable:
        def run(edges: DataFrame) -> DataFrame:
            path = stored(edges)
            return f(edges, lambda artifact="ledger": L.load(edges.sparkSession, path, artifact), path)

        run.__name__ = f.__name__
        edge_query(sql)(run)
        return f

    return register


def planted(k: int, also: str = "") -> str:
    return f" SELECT edge_id FROM edges WHERE edge_id % {STEP} = {k}{also}"


def at(k: int, rows: DataFrame, name: str, value: object, also: str = "true") -> DataFrame:
    """rows with a fault in a column of every event of that remainder."""
    return rows.withColumn(name, F.when(F.expr(f"edge_id % {STEP} = {k} and {also}"), value).otherwise(F.col(name)))


@check(f", {SCORES} SELECT edge_id, rank, round(score, 6) AS score, support, round(CASE WHEN n > 1 THEN (n - rank) / (n - 1) ELSE 0 END, 9) AS percentile FROM led")
def ledger_rows(edges, load, path):  # noqa: ANN001, ANN201
    """What is loaded from the written ledger."""
    return load().select("edge_id", "rank", F.round("score", 6).alias("score"), "support", F.round("empirical_percentile", 9).alias("percentile"))


@check(" SELECT 'contributions' AS artifact, true AS changed UNION ALL SELECT 'ledger', false UNION ALL SELECT 'witnesses', false UNION ALL SELECT 'identity', false")
def ledger_files(edges, load, path):  # noqa: ANN001, ANN201
    """Artifacts with files that are not the manifest's; the manifest's digests of one artifact are falsified."""
    manifest = load("manifest").withColumn("sha256", F.when(F.col("artifact") == "contributions", F.reverse("sha256")).otherwise(F.col("sha256")))
    names = ["ledger", "contributions", "witnesses", "identity"]
    bad = L.changed_files(manifest, L.files(edges.sparkSession, path, names)).select("artifact", F.lit(True).alias("changed")).distinct()
    return edges.sparkSession.createDataFrame([(n,) for n in names], "artifact string").join(bad, "artifact", "left").fillna(False)


@check(planted(2))
def ledger_identity(edges, load, path):  # noqa: ANN001, ANN201
    rows = load("identity")
    return L.identity_faults(rows.unionByName(rows.where(f"edge_id % {STEP} = 2"))).select("edge_id")


@check(f", {SCORES} SELECT edge_id, poi FROM part WHERE edge_id % {STEP} = 3")
def ledger_contributions(edges, load, path):  # noqa: ANN001, ANN201
    return L.contribution_faults(at(3, load("contributions"), "s", F.lit(1.5)), load(), pois(edges))


@check(f", {SCORES} SELECT DISTINCT poi FROM part WHERE poi % {2 * POI} = 0")
def ledger_digests(edges, load, path):  # noqa: ANN001, ANN201
    stated = load("digests").withColumn("digest", F.when(F.col("poi") % (2 * POI) == 0, F.reverse("digest")).otherwise(F.col("digest")))
    return L.digest_faults(load("contributions"), stated)


@check(planted(5))
def ledger_aggregates(edges, load, path):  # noqa: ANN001, ANN201
    return L.aggregate_faults(at(5, load(), "score", F.col("score") + 0.001), load("contributions"))


@check(planted(6))
def ledger_schema(edges, load, path):  # noqa: ANN001, ANN201
    return L.schema_faults(at(6, load(), "components", F.map_filter("components", lambda k, _: k != "rarity")))


@check(planted(7))
def ledger_candidates(edges, load, path):  # noqa: ANN001, ANN201
    return L.candidate_faults(at(7, load(), "relation", F.lit("EVENT_OTHER")), edges)


@check(planted(8))
def ledger_order(edges, load, path):  # noqa: ANN001, ANN201
    return L.rank_faults(at(8, load(), "rank", F.col("rank") + 1))


@check(planted(9))
def ledger_poi_flags(edges, load, path):  # noqa: ANN001, ANN201
    return L.poi_faults(at(9, load(), "is_declared_poi", ~F.col("is_declared_poi")), pois(edges))


@check(planted(10))
def ledger_decisions(edges, load, path):  # noqa: ANN001, ANN201
    wrong = F.transform("decisions", lambda d: d.withField("kept", F.lit(True)).withField("reasons", F.array(F.lit("score"), F.lit("declared"))))
    return L.decision_faults(at(10, load(), "decisions", wrong), list(BUDGETS))


@check(planted(11))
def ledger_high_scores(edges, load, path):  # noqa: ANN001, ANN201
    return L.high_faults(at(11, load(), "high_score", ~F.col("high_score")), CUTOFF)


@check(f", {CHAINS} SELECT path FROM path GROUP BY ALL HAVING count(*) > 1 AND path % 2 = 0")
def ledger_witnesses(edges, load, path):  # noqa: ANN001, ANN201
    rows = load("witnesses").withColumn("position", F.expr("case when path % 2 = 0 then -position else position end"))
    return L.witness_faults(rows, edges)


@check(planted(13, f" AND edge_id % {POI} <> 0"))
def ledger_channels(edges, load, path):  # noqa: ANN001, ANN201
    wrong = F.col("channels").withField("verified", F.col("channels.verified") + 0.001)
    return L.channel_faults(at(13, load(), "channels", wrong, "not is_declared_poi"))


@check(planted(14))
def ledger_pruning(edges, load, path):  # noqa: ANN001, ANN201
    return L.pruning_faults(at(14, load(), "pruning", F.col("pruning").withField("raw_cost", F.lit(0))))


@check(" SELECT edge_id FROM edges WHERE edge_id < 0")
def ledger_violations(edges, load, path):  # noqa: ANN001, ANN201
    """What any check finds in the ledger as it was written: nothing. The queries above show that the checks see faults."""
    rows, given, p = cut(load()), cut(load("contributions")), pois(edges)
    found = [
        L.identity_faults(load("identity")).select("edge_id"), L.contribution_faults(given, rows, p).select("edge_id"), L.digest_faults(given, load("digests")).select(F.col("poi").alias("edge_id")),
        L.aggregate_faults(rows, given), L.schema_faults(rows), L.candidate_faults(rows, edges), L.rank_faults(rows), L.poi_faults(rows, p), L.decision_faults(rows, list(BUDGETS)),
        L.high_faults(rows, CUTOFF), L.witness_faults(load("witnesses"), edges).select(F.col("path").alias("edge_id")), L.channel_faults(rows), L.pruning_faults(rows),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()
