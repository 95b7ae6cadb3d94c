"""Score ledgers: rows of events with their score, rank and evidence, written as artifacts with a hashed manifest, and checks.

A check returns the rows that break a rule, so that an empty result is a pass and a broken ledger names its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators import scoring as S
from trailgrain.operators.graph import cut

VERSION, SEMANTICS = "trailgrain-ledger-1", "importance, not a probability"
IDENTITY = ("src", "dst", "src_type", "dst_type", "src_semantic", "dst_semantic", "relation", "timestamp_ns", "host", "data_size")
WEIGHTS = {"backward": 0.6, "forward": 0.7, "verification": 0.5}
ROW = (
    "edge_id long, src string, dst string, src_type string, dst_type string, src_semantic string, dst_semantic string, relation string, timestamp_ns long, host string, data_size long, "
    "schema_version string, score double, score_semantics string, rank long, empirical_percentile double, high_score boolean, is_declared_poi boolean, winner long, winner_score double, support long, "
    "components map<string,double>, channels struct<backward: double, forward: double, verification: double, relation_aware: double, verified: double>, "
    "pruning struct<kept: boolean, removal_allowed: boolean, removal_round: int, raw_cost: int>, decisions array<struct<budget_key: string, kept: boolean, reasons: array<string>>>"
)
CONTRIBUTION, WITNESS = "edge_id long, poi long, s double", "path long, position int, edge_id long"
RECORDS_A_FILE = 2_000_000  # so that no file is too large to be hashed as one value


def noisy_or(channels: dict[str, Column]) -> tuple[Column, Column]:
    """The weighted noisy-OR of both directions, and of it with the verification."""
    both = 1 - (1 - WEIGHTS["backward"] * channels["backward"]) * (1 - WEIGHTS["forward"] * channels["forward"])
    return both, both + (1 - both) * WEIGHTS["verification"] * channels["verification"]


def build(edges: DataFrame, contributions: DataFrame, pois: DataFrame, budgets: dict[str, float], cutoff: float, given: DataFrame | None = None) -> DataFrame:
    """Ledger rows of edges (with rarity) from contributions (edge_id, poi, s): aggregate, place, percentile, high scores with ties, decisions.

    given: (edge_id, backward, forward, verification) channels of a verification, 0 where absent; without them score and rarity stand for the channels.
    """
    total = S.noisy_or(contributions, "edge_id", "poi", "s").withColumnRenamed("aggregate", "score")
    own = pois.select("edge_id", F.lit(True).alias("is_declared_poi"))
    rows = edges.join(total, "edge_id", "left").join(own, "edge_id", "left").fillna({"score": 0.0, "winner_score": 0.0, "support": 0, "is_declared_poi": False})
    n = edges.count()
    placed = cut(O.ranked(rows, [], [F.desc("score"), "edge_id"], "rank"))
    level = placed.where(F.col("rank") == max(1, round(cutoff * n))).select(F.col("score").alias("level"))
    channels = {"backward": F.col("score"), "forward": F.col("rarity"), "verification": F.least("score", "rarity")}
    if given is not None:
        placed = placed.join(given.select("edge_id", *[F.col(c).alias(f"given_{c}") for c in WEIGHTS]), "edge_id", "left")
        channels = {c: F.coalesce(f"given_{c}", F.lit(0.0)) for c in WEIGHTS}
    both, verified = noisy_or(channels)
    poi = F.col("is_declared_poi")
    kept = lambda ratio: poi | (F.col("rank") <= max(1, int(n * ratio)))
    reasons = lambda ratio: F.array_compact(F.array(F.when(poi, "declared"), F.when(F.col("rank") <= max(1, int(n * ratio)), "score")))
    decisions = F.array(*[F.struct(F.lit(k).alias("budget_key"), kept(r).alias("kept"), reasons(r).alias("reasons")) for k, r in budgets.items()])
    first = kept(next(iter(budgets.values())))
    return placed.join(F.broadcast(level)).select(  # one row
        "edge_id", *IDENTITY, F.lit(VERSION).alias("schema_version"), "score", F.lit(SEMANTICS).alias("score_semantics"), "rank",
        (F.when(F.lit(n) > 1, (n - F.col("rank")) / max(1, n - 1)).otherwise(0.0)).alias("empirical_percentile"),
        ((F.col("score") >= F.col("level")) & (F.col("score") > 0)).alias("high_score"), "is_declared_poi", "winner", "winner_score", "support",
        F.create_map(F.lit("rarity"), F.col("rarity"), F.lit("score"), F.col("score")).alias("components"),
        F.struct(*[c.alias(k) for k, c in channels.items()], F.when(poi, 1.0).otherwise(both).alias("relation_aware"), F.when(poi, 1.0).otherwise(verified).alias("verified")).alias("channels"),
        F.struct(first.alias("kept"), (~first).alias("removal_allowed"), F.when(~first, 1).alias("removal_round"), F.lit(1).alias("raw_cost")).alias("pruning"), decisions.alias("decisions"),
    )


def digests(contributions: DataFrame) -> DataFrame:
    """A digest of each point of interest's contributions: (poi, digest)."""
    text = F.concat_ws(":", "edge_id", F.format_number("s", 9))
    parts = contributions.groupBy("poi", F.pmod(F.col("edge_id"), F.lit(1024)).alias("part")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(text))), 256).alias("d"))
    return parts.groupBy("poi").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("d"))), 256).alias("digest"))


def write(folder: str, ledger: DataFrame, contributions: DataFrame, witnesses: DataFrame) -> str:
    """Write the artifacts in their order, compressed, and then the manifest with the digest of each file and of each point of interest."""
    spark, path = ledger.sparkSession, f"{folder.rstrip('/')}/ledger-{uuid.uuid4().hex}"
    identity = ledger.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("edge_id"))
    identity = identity.unionByName(ledger.select(F.lit("edge").alias("kind"), F.lpad(F.col("edge_id").cast("string"), 20, "0").alias("id"), "edge_id"))
    artifacts = {
        "ledger": (ledger, ["rank"]), "contributions": (contributions, ["poi", "edge_id"]), "witnesses": (witnesses, ["path", "position"]),
        "identity": (identity.withColumn("order", F.concat(F.when(F.col("kind") == "node", "0").otherwise("1"), "id")), ["order"]),
    }
    for name, (rows, order) in artifacts.items():
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", RECORDS_A_FILE).json(f"{path}/{name}", compression="gzip")
    digests(contributions).write.json(f"{path}/digests")
    files(spark, path, list(artifacts)).write.json(f"{path}/manifest")
    return path


def files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Digest of each file of the artifacts: (artifact, file, sha256)."""
    found = None
    for name in names:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(f"{path}/{name}")
        rows = rows.select(F.lit(name).alias("artifact"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
        found = rows if found is None else found.unionByName(rows)
    return found


def load(spark: SparkSession, path: str, artifact: str = "ledger") -> DataFrame:
    """An artifact as aligned columns; what does not fit the schema fails."""
    schema = {"ledger": ROW, "contributions": CONTRIBUTION, "witnesses": WITNESS, "identity": "kind string, id string, edge_id long, order string", "digests": "poi long, digest string", "manifest": "artifact string, file string, sha256 string"}[artifact]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{artifact}")


def changed_files(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose digest is not the manifest's, or that only one side has."""
    a, b = manifest.withColumnRenamed("sha256", "stated"), now
    return a.join(b, ["artifact", "file"], "full").where(~F.col("stated").eqNullSafe(F.col("sha256"))).select("artifact", "file")


def identity_faults(identity: DataFrame) -> DataFrame:
    """Entries that occur more than once."""
    return identity.groupBy("kind", "id").agg(F.count("*").alias("n"), F.first("edge_id").alias("edge_id")).where("n > 1").select("kind", "edge_id")


def contribution_faults(contributions: DataFrame, ledger: DataFrame, pois: DataFrame) -> DataFrame:
    """Contributions out of (0, 1], twice for one pair, or of unknown events or points of interest."""
    rows = contributions.groupBy("edge_id", "poi").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"))
    known = ledger.select("edge_id", F.lit(True).alias("known"))
    declared = pois.select(F.col("edge_id").alias("poi"), F.lit(True).alias("declared"))
    rows = rows.join(known, "edge_id", "left").join(declared, "poi", "left")
    return rows.where("n > 1 or not (least > 0 and most <= 1) or known is null or declared is null").select("edge_id", "poi")


def digest_faults(contributions: DataFrame, stated: DataFrame) -> DataFrame:
    """Points of interest whose contributions do not give the stated digest."""
    now = digests(contributions).withColumnRenamed("digest", "now")
    return stated.join(now, "poi", "full").where(~F.col("digest").eqNullSafe(F.col("now"))).select("poi")


def aggregate_faults(ledger: DataFrame, contributions: DataFrame) -> DataFrame:
    """Rows whose score, winner, winner's score or support is not what the contributions give."""
    again = S.noisy_or(contributions, "edge_id", "poi", "s").select("edge_id", "aggregate", F.col("winner").alias("w"), F.col("winner_score").alias("ws"), F.col("support").alias("n"))
    rows = ledger.join(again, "edge_id", "left").fillna({"aggregate": 0.0, "ws": 0.0, "n": 0})
    bad = (F.abs(F.col("score") - F.col("aggregate")) > 1e-12) | ~F.col("winner").eqNullSafe(F.col("w")) | (F.abs(F.col("winner_score") - F.col("ws")) > 1e-12) | (F.col("support") != F.col("n"))
    return rows.where(bad).select("edge_id")


def schema_faults(ledger: DataFrame) -> DataFrame:
    """Rows whose evidence has other keys than most rows, or other versions."""
    keyed = ledger.withColumn("keys", F.array_join(F.sort_array(F.map_keys("components")), ","))
    usual = keyed.groupBy("keys").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keys").limit(1).select(F.col("keys").alias("usual"))
    return keyed.join(F.broadcast(usual)).where((F.col("keys") != F.col("usual")) | (F.col("schema_version") != VERSION) | (F.col("score_semantics") != SEMANTICS)).select("edge_id")  # one row


def candidate_faults(ledger: DataFrame, edges: DataFrame) -> DataFrame:
    """Events that only one side has, or that differ in a field."""
    a = ledger.select("edge_id", F.struct(*IDENTITY).alias("mine"))
    b = edges.select("edge_id", F.struct(*IDENTITY).alias("theirs"))
    return a.join(b, "edge_id", "full").where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("edge_id")


def rank_faults(ledger: DataFrame) -> DataFrame:
    """Rows whose score, place or percentile is not that of the order."""
    n = ledger.count()
    placed = O.ranked(ledger.select("edge_id", "score", "rank", "empirical_percentile"), [], [F.desc("score"), "edge_id"])
    percentile = F.when(F.lit(n) > 1, (n - F.col("place")) / max(1, n - 1)).otherwise(0.0)
    bad = ~F.col("score").between(0, 1) | (F.col("rank") != F.col("place")) | (F.abs(F.col("empirical_percentile") - percentile) > 1e-12)
    return placed.where(bad).select("edge_id")


def poi_faults(ledger: DataFrame, pois: DataFrame) -> DataFrame:
    """Rows whose flag is not whether the event is declared."""
    own = pois.select("edge_id", F.lit(True).alias("declared"))
    return ledger.join(own, "edge_id", "left").where(F.col("is_declared_poi") != F.coalesce("declared", F.lit(False))).select("edge_id")


def decision_faults(ledger: DataFrame, budgets: list[str]) -> DataFrame:
    """Rows without just one decision a budget, kept without sorted different reasons, or not kept with reasons."""
    reasons_bad = F.exists("decisions", lambda d: F.when(d.kept, (F.size(d.reasons) == 0) | (F.array_sort(F.array_distinct(d.reasons)) != d.reasons)).otherwise(F.size(d.reasons) > 0))
    keys = F.array_sort(F.transform("decisions", lambda d: d.budget_key))
    return ledger.where(reasons_bad | (keys != F.array(*[F.lit(b) for b in sorted(budgets)]))).select("edge_id")


def high_faults(ledger: DataFrame, cutoff: float) -> DataFrame:
    """Rows whose high-score flag is not that of the level at the cutoff's place, ties included."""
    place = max(1, round(cutoff * ledger.count()))
    level = ledger.where(F.col("rank") == place).agg(F.max("score").alias("level"))
    return ledger.join(F.broadcast(level)).where(F.col("high_score") != ((F.col("score") >= F.col("level")) & (F.col("score") > 0))).select("edge_id")  # one row


def witness_faults(witnesses: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths that repeat an event, name an unknown one, are not continuous or not strictly later at each step."""
    w = Window.partitionBy("path").orderBy("position")
    rows = witnesses.join(edges.select("edge_id", "src", "dst", "timestamp_ns"), "edge_id", "left")
    steps = rows.withColumn("to", F.lag("dst").over(w)).withColumn("before", F.lag("timestamp_ns").over(w)).withColumn("seen", F.count("*").over(Window.partitionBy("path", "edge_id")))
    bad = F.col("src").isNull() | (F.col("seen") > 1) | (F.col("before").isNotNull() & ((F.col("to") != F.col("src")) | (F.col("timestamp_ns") <= F.col("before"))))
    return steps.where(bad).select("path").distinct()


def channel_faults(ledger: DataFrame) -> DataFrame:
    """Rows whose combined channels are not the noisy-OR of the parts; a point of interest's are 1."""
    both, verified = noisy_or({k: F.col(f"channels.{k}") for k in WEIGHTS})
    poi = F.col("is_declared_poi")
    want = (F.when(poi, 1.0).otherwise(both), F.when(poi, 1.0).otherwise(verified))
    return ledger.where((F.abs(F.col("channels.relation_aware") - want[0]) > 1e-12) | (F.abs(F.col("channels.verified") - want[1]) > 1e-12)).select("edge_id")


def pruning_faults(ledger: DataFrame) -> DataFrame:
    """Rows that are kept though their removal was allowed, removed without that, or without a positive round or cost."""
    p = "pruning."
    bad = f"({p}kept and {p}removal_allowed) or (not {p}kept and not {p}removal_allowed) or ({p}removal_allowed and coalesce({p}removal_round, 0) < 1) or coalesce({p}raw_cost, 0) < 1"
    return ledger.where(bad).select("edge_id")
