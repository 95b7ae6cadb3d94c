"""Queries: what a selection keeps, misses and explains; set algebra over selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut
from trailgrain.plans.ranking import SCORED, STRATA, budget, stratified, tied, top_budget
from trailgrain.plans.registry import edge_query

TRUTH = 13  # every 13th event stands for a labelled one

FLAGS = f"""{SCORED}, {STRATA}, kept AS (SELECT edge_id FROM q ORDER BY turn, rarity DESC, tie LIMIT (SELECT b FROM size)),
top AS (SELECT edge_id FROM scored ORDER BY mandatory DESC, rarity DESC, tie LIMIT (SELECT b FROM size)),
flags AS (SELECT e.*, e.edge_id IN (SELECT edge_id FROM kept) AS kept, e.edge_id IN (SELECT edge_id FROM top) AS top, e.edge_id % {TRUTH} = 0 AS truth FROM edges e)"""


def flagged(edges: DataFrame) -> DataFrame:
    scored = cut(tied(edges))
    size = budget(scored)
    one = stratified(scored, size).select("edge_id", F.lit(True).alias("kept"))
    two = top_budget(scored, size).select("edge_id", F.lit(True).alias("top"))
    return edges.join(one, "edge_id", "left").join(two, "edge_id", "left").fillna(False, ["kept", "top"]).withColumn("truth", F.col("edge_id") % TRUTH == 0)


@edge_query(f""", {FLAGS} SELECT count(*) FILTER (WHERE truth AND kept) AS tp, count(*) FILTER (WHERE truth AND NOT kept) AS fn, count(*) FILTER (WHERE NOT truth AND kept) AS fp,
round(count(*) FILTER (WHERE truth AND kept) / count(*) FILTER (WHERE truth), 6) AS recall, round(count(*) FILTER (WHERE kept) / count(*), 6) AS retention FROM flags""")
def retention_metrics(edges: DataFrame) -> DataFrame:
    f = flagged(edges)
    tp, truth = F.count_if(F.col("truth") & F.col("kept")), F.count_if("truth")
    return f.agg(
        tp.alias("tp"), F.count_if(F.col("truth") & ~F.col("kept")).alias("fn"), F.count_if(~F.col("truth") & F.col("kept")).alias("fp"),
        F.round(tp / truth, 6).alias("recall"), F.round(F.count_if("kept") / F.count("*"), 6).alias("retention"),
    )


@edge_query(f", {FLAGS}, h AS (SELECT host, count(*) FILTER (WHERE truth AND kept) / nullif(count(*) FILTER (WHERE truth), 0) AS r FROM flags GROUP BY ALL) SELECT round(avg(r), 6) AS macro_recall, count(r) AS hosts FROM h")
def macro_recall(edges: DataFrame) -> DataFrame:
    by = flagged(edges).groupBy("host").agg((F.count_if(F.col("truth") & F.col("kept")) / F.nullif(F.count_if("truth"), F.lit(0))).alias("r"))
    return by.agg(F.round(F.avg("r"), 6).alias("macro_recall"), F.count("r").alias("hosts"))


@edge_query(f", {FLAGS} SELECT round(count(*) FILTER (WHERE kept AND top) / count(*) FILTER (WHERE kept OR top), 6) AS jaccard, count(*) FILTER (WHERE kept AND NOT top) AS added, count(*) FILTER (WHERE top AND NOT kept) AS removed FROM flags")
def selection_churn(edges: DataFrame) -> DataFrame:
    both, any_ = F.count_if(F.col("kept") & F.col("top")), F.count_if(F.col("kept") | F.col("top"))
    return flagged(edges).agg(F.round(both / any_, 6).alias("jaccard"), F.count_if(F.col("kept") & ~F.col("top")).alias("added"), F.count_if(F.col("top") & ~F.col("kept")).alias("removed"))


@edge_query(f", {FLAGS} SELECT edge_id FROM flags WHERE truth EXCEPT SELECT edge_id FROM kept")
def missed_truth(edges: DataFrame) -> DataFrame:
    f = flagged(edges)
    return f.where("truth").select("edge_id").subtract(f.where("kept").select("edge_id"))


@edge_query(f", {FLAGS} SELECT CASE WHEN NOT kept AND top THEN 'stratum' WHEN NOT kept THEN 'score' WHEN edge_id % 997 = 0 THEN 'mandatory' ELSE 'kept' END AS reason, count(*) AS events FROM flags GROUP BY ALL")
def decision_reasons(edges: DataFrame) -> DataFrame:
    reason = F.expr("case when not kept and top then 'stratum' when not kept then 'score' when edge_id % 997 = 0 then 'mandatory' else 'kept' end")
    return flagged(edges).groupBy(reason.alias("reason")).agg(F.count("*").alias("events"))


@edge_query(f", {FLAGS}, n AS (SELECT unnest([src, dst]) AS node, kept FROM flags) SELECT count(DISTINCT node) AS nodes, count(DISTINCT CASE WHEN kept THEN node END) AS kept_nodes, (SELECT count(*) FROM flags) AS events, (SELECT count(*) FROM flags WHERE kept) AS kept_events FROM n")
def compression(edges: DataFrame) -> DataFrame:
    f = flagged(edges)
    nodes = f.select(F.explode(F.array("src", "dst")).alias("node"), "kept").agg(F.countDistinct("node").alias("nodes"), F.countDistinct(F.when(F.col("kept"), F.col("node"))).alias("kept_nodes"))
    return nodes.join(f.agg(F.count("*").alias("events"), F.count_if("kept").alias("kept_events")))


@edge_query(f", {FLAGS}, p AS (SELECT src, dst, bool_and(kept) AS whole, count(*) AS events FROM flags WHERE truth GROUP BY ALL) SELECT count(*) AS paths, count(*) FILTER (WHERE whole) AS kept_paths FROM p")
def path_retention(edges: DataFrame) -> DataFrame:
    paths = flagged(edges).where("truth").groupBy("src", "dst").agg(F.bool_and("kept").alias("whole"))
    return paths.agg(F.count("*").alias("paths"), F.count_if("whole").alias("kept_paths"))


@edge_query(f", {FLAGS} SELECT src AS process, dst_type, count(*) AS events, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, count(DISTINCT dst) AS objects, arg_min(relation, timestamp_ns) AS first_relation FROM flags WHERE kept AND src_type = 'process' GROUP BY ALL")
def activity_story(edges: DataFrame) -> DataFrame:
    kept = flagged(edges).where("kept and src_type = 'process'")
    return kept.groupBy(F.col("src").alias("process"), "dst_type").agg(
        F.count("*").alias("events"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        F.countDistinct("dst").alias("objects"), F.min_by("relation", "timestamp_ns").alias("first_relation"),
    )


@edge_query(f", {SCORED} SELECT relation, count(*) AS n, count(*) FILTER (WHERE rarity > 0) AS nonzero, count(DISTINCT round(rarity, 4)) AS distinct_scores, min(rarity) AS least, max(rarity) AS most FROM scored GROUP BY ALL")
def score_distribution(edges: DataFrame) -> DataFrame:
    return tied(edges).groupBy("relation").agg(
        F.count("*").alias("n"), F.count_if(F.col("rarity") > 0).alias("nonzero"), F.countDistinct(F.round("rarity", 4)).alias("distinct_scores"),
        F.min("rarity").alias("least"), F.max("rarity").alias("most"),
    )
