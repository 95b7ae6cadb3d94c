"""Queries: paths, funnels, tri-state metrics, sweeps over budgets and prefixes, and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators import graph as G
from trailgrain.operators import ordered as O
from trailgrain.operators import paths as P
from trailgrain.operators import scoring as S
from trailgrain.plans.continuations import MARKED, STEP, marked
from trailgrain.plans.evaluation import FLAGS, TRUTH, flagged
from trailgrain.plans.graphs import seeds
from trailgrain.plans.profiles import CUTOFF
from trailgrain.plans.ranking import SCORED, keyed, tied
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POI, POIS, PROBABILITY, pois

DAY = 24 * HOUR
LENGTH = 3
RATIOS = (0.01, 0.05, 0.1, 0.2, 0.5)

NEXT = "nxt AS (SELECT e.edge_id, min(struct_pack(t := f.timestamp_ns, id := f.edge_id)).id AS next FROM edges e JOIN edges f ON f.src = e.dst AND f.timestamp_ns > e.timestamp_ns GROUP BY ALL)"
CHAINS = f"{MARKED}, {NEXT}, path AS (SELECT edge_id AS path, 0 AS position, edge_id FROM p UNION ALL SELECT path, position + 1, next FROM path JOIN nxt USING (edge_id) WHERE position < {LENGTH - 1})"


def own_chains(edges: DataFrame) -> DataFrame:
    return P.chains(edges, marked(edges), LENGTH)


@edge_query(f", {CHAINS} SELECT path, CAST(position AS INTEGER) AS position, edge_id FROM path")
def event_paths(edges: DataFrame) -> DataFrame:
    return own_chains(edges)


@edge_query(f", {FLAGS}, {CHAINS}, w AS (SELECT path, bool_and(kept) AS retained, arg_max(path.edge_id, position) % 2 = 0 AS chosen FROM path JOIN flags USING (edge_id) GROUP BY ALL) SELECT count(*) AS paths, count(*) FILTER (WHERE retained) AS retained, count(*) FILTER (WHERE retained AND chosen) AS chosen_retained, count(*) FILTER (WHERE retained AND NOT chosen) AS other_retained FROM w")
def path_metrics(edges: DataFrame) -> DataFrame:
    """Paths whose events are all kept, by whether their last event is a chosen one (here: of even id)."""
    paths = own_chains(edges)
    last = paths.groupBy("path").agg((F.max_by("edge_id", "position") % 2 == 0).alias("chosen"))
    found = P.whole(paths, flagged(edges).where("kept")).join(last, "path")
    return found.agg(F.count("*").alias("paths"), F.count_if("retained").alias("retained"), F.count_if(F.expr("retained and chosen")).alias("chosen_retained"), F.count_if(F.expr("retained and not chosen")).alias("other_retained"))


@edge_query(f", {SCORED}, {CHAINS}, w AS (SELECT path, list(scored.edge_id ORDER BY position) AS events, list(scored.dst ORDER BY position) AS nodes, round(avg(rarity), 6) AS score, min(rarity) AS least FROM path JOIN scored USING (edge_id) GROUP BY ALL) SELECT path, array_to_string(events, ',') AS events, array_to_string(nodes, ',') AS nodes, score FROM w WHERE least >= 0.008")
def reconstructed_paths(edges: DataFrame) -> DataFrame:
    """Paths of which everything is kept (here: rarity of 0.008 or more), with their events and nodes."""
    rows = own_chains(edges).join(tied(edges).select("edge_id", "dst", "rarity"), "edge_id")
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.col(c).cast("string").alias("x")))), lambda s: s.x), ",")
    found = rows.groupBy("path").agg(listed("edge_id").alias("events"), listed("dst").alias("nodes"), F.round(F.avg("rarity"), 6).alias("score"), F.min("rarity").alias("least"))
    return found.where("least >= 0.008").drop("least")


STABLE = f"""ends AS (SELECT src_semantic AS k, src_type AS t, 'out' AS d, day, timestamp_ns FROM edges UNION ALL SELECT dst_semantic, dst_type, 'in', day, timestamp_ns FROM edges),
types AS (SELECT k, min(t) AS t FROM ends GROUP BY ALL),
days AS (SELECT k, count(DISTINCT CASE WHEN d = 'in' THEN day END) AS i, count(DISTINCT CASE WHEN d = 'out' THEN day END) AS o FROM ends WHERE timestamp_ns < {CUTOFF} GROUP BY ALL),
span AS (SELECT max(day) - min(day) + 1 AS total FROM edges WHERE timestamp_ns < {CUTOFF}),
fix AS (SELECT types.k, coalesce(i, 0) AS i, coalesce(o, 0) AS o, total, CASE WHEN t = 'socket' THEN 0.5 WHEN t <> 'file' THEN NULL
  WHEN regexp_matches(lower(types.k), '\\.(exe|dll|so|sh|ps1|bat)$') THEN 0.1 WHEN coalesce(i, 0) > 0 AND coalesce(o, 0) = 0 THEN 1.0 ELSE 0.5 END AS fixed FROM types LEFT JOIN days USING (k), span),
stab AS (SELECT k, CAST(coalesce(fixed, 1 - i / total) AS DOUBLE) AS i, CAST(coalesce(fixed, 1 - o / total) AS DOUBLE) AS o FROM fix),
reg AS (SELECT edge_id, greatest(1e-6, greatest(0.05, a.i) * probability * greatest(0.05, b.o)) AS r FROM prob JOIN stab a ON a.k = src_semantic JOIN stab b ON b.k = dst_semantic),
pr AS (SELECT path, coalesce(least(1, exp(avg(CASE WHEN edge_id % 7 <> 0 THEN ln(r) END)) * 0.9), 1) AS v FROM path JOIN reg USING (edge_id) GROUP BY ALL)"""


def path_scores(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths and their regularity; every seventh event is excluded, as alerts are."""
    paths, stable = own_chains(edges), S.stability(edges, CUTOFF)
    side = lambda end, score: stable.select(F.col("semantic_key").alias(f"{end}_semantic"), F.greatest(F.lit(0.05), F.col(score)).alias(f"{end}_stable"))
    rows = S.transition_probability(edges, CUTOFF).join(side("src", "in_score"), "src_semantic").join(side("dst", "out_score"), "dst_semantic")
    values = rows.select("edge_id", F.greatest(F.lit(1e-6), F.col("src_stable") * F.col("probability") * F.col("dst_stable")).alias("regularity"))
    return paths, P.regularity(paths, values, F.col("edge_id") % 7 == 0, 0.9)


@edge_query(f", {PROBABILITY}, {CHAINS}, {STABLE} SELECT path, round(v, 6) AS regularity, round(1 - v, 6) AS anomaly FROM pr")
def path_regularity(edges: DataFrame) -> DataFrame:
    return path_scores(edges)[1].select("path", F.round("regularity", 6).alias("regularity"), F.round("anomaly", 6).alias("anomaly"))


@edge_query(f", {PROBABILITY}, {CHAINS}, {STABLE} SELECT edge_id, round(max(1 - v), 6) AS importance FROM path JOIN pr USING (path) GROUP BY ALL")
def path_importance(edges: DataFrame) -> DataFrame:
    """An event counts as much as its most anomalous path."""
    paths, scores = path_scores(edges)
    return paths.join(scores, "path").groupBy("edge_id").agg(F.round(F.max("anomaly"), 6).alias("importance"))


HOPS = f"""{POIS}, both_ AS (SELECT src AS node, dst AS next FROM edges UNION SELECT dst, src FROM edges), k AS (SELECT src AS node, 0 AS hop FROM pois UNION SELECT dst, 0 FROM pois UNION SELECT next, hop + 1 FROM k JOIN both_ USING (node) WHERE hop < 2),
near AS (SELECT node, min(hop) AS hop FROM k GROUP BY ALL)"""
FUNNEL = f"""{FLAGS}, {HOPS}, truth AS (SELECT edge_id FROM edges WHERE edge_id % {TRUTH} = 0 UNION ALL SELECT edge_id + 1000000000 FROM edges WHERE edge_id % 131 = 0),
stages AS (SELECT t.edge_id, e.edge_id IS NOT NULL AS in_database, coalesce(s.hop <= 1 AND d.hop <= 1 OR s.hop + d.hop <= 3, false) AS in_scope, coalesce(s.hop <= 1 AND d.hop <= 1, false) AS searched, coalesce(s.hop <= 1 AND d.hop <= 1 AND e.edge_id % 5 <> 0, false) AS candidate,
  coalesce(s.hop <= 1 AND d.hop <= 1 AND e.edge_id % 5 <> 0 AND e.kept, false) AS pruned FROM truth t LEFT JOIN flags e USING (edge_id) LEFT JOIN near s ON s.node = e.src LEFT JOIN near d ON d.node = e.dst)"""
STAGES = ("in_database", "in_scope", "searched", "candidate", "pruned")
LOSSES = ("not_in_database", "outside_scope", "not_searched", "lost_by_search", "lost_by_pruning")


def funnel(edges: DataFrame) -> DataFrame:
    """Labelled events with the stages that they get to; some labels are not in the table at all."""
    truth = edges.where(F.col("edge_id") % TRUTH == 0).select("edge_id").union(edges.where("edge_id % 131 = 0").select(F.col("edge_id") + 1_000_000_000))
    near = G.neighbourhood(edges, seeds(edges), 2)
    side = lambda end: near.select(F.col("node").alias(end), F.col("hop").alias(f"{end}_hop"))
    rows = truth.join(flagged(edges).select("edge_id", "src", "dst", "kept", F.lit(True).alias("there")), "edge_id", "left").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    no = lambda c: F.coalesce(F.expr(c), F.lit(False))
    close = "src_hop <= 1 and dst_hop <= 1"
    return G.cut(rows.select(
        "edge_id", no("there").alias("in_database"), no(f"{close} or src_hop + dst_hop <= 3").alias("in_scope"), no(close).alias("searched"),
        no(f"{close} and edge_id % 5 <> 0").alias("candidate"), no(f"{close} and edge_id % 5 <> 0 and kept").alias("pruned"),
    ))


@edge_query(f", {FUNNEL} SELECT count(*) AS truth, " + ", ".join(f"count(*) FILTER (WHERE {s}) AS {s}, round(count(*) FILTER (WHERE {s}) / count(*), 6) AS {s}_recall" for s in STAGES) + " FROM stages")
def coverage_funnel(edges: DataFrame) -> DataFrame:
    counts = [x for s in STAGES for x in (F.count_if(s).alias(s), F.round(F.count_if(s) / F.count("*"), 6).alias(f"{s}_recall"))]
    return funnel(edges).agg(F.count("*").alias("truth"), *counts)


def _loss() -> str:
    before = ("true", *STAGES[:-1])
    return "CASE " + " ".join(f"WHEN {b} AND NOT {s} THEN '{n}'" for b, s, n in zip(before, STAGES, LOSSES, strict=True)) + " END"


@edge_query(f", {FUNNEL} SELECT edge_id, {_loss()} AS loss FROM stages WHERE NOT pruned")
def loss_sets(edges: DataFrame) -> DataFrame:
    """The stage at which each labelled event is lost."""
    return funnel(edges).where("not pruned").select("edge_id", F.expr(_loss()).alias("loss"))


LABELS = f"""{FLAGS}, u AS (SELECT src AS node, kept FROM flags UNION ALL SELECT dst, kept FROM flags), n AS (SELECT node, bool_or(kept) AS predicted, CASE CAST(substr(node, 2) AS BIGINT) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS label FROM u GROUP BY node)"""


@edge_query(f""", {LABELS}, c AS (SELECT count(*) FILTER (WHERE predicted AND label) AS tp, count(*) FILTER (WHERE predicted AND NOT label) AS fp, count(*) FILTER (WHERE NOT predicted AND label) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT label) AS tn,
count(*) FILTER (WHERE label IS NULL) AS unknown, count(*) FILTER (WHERE predicted AND label IS NULL) AS unreviewed, count(*) FILTER (WHERE predicted) AS predicted FROM n)
SELECT *, round(tp / (tp + fn), 6) AS known_recall, round(CASE WHEN unreviewed = 0 THEN tp / predicted END, 6) AS precision, round(CASE WHEN unknown = 0 THEN tp / (tp + fn) END, 6) AS recall, round(tp / predicted, 6) AS least_precision, round((tp + unreviewed) / predicted, 6) AS most_precision FROM c""")
def node_metrics(edges: DataFrame) -> DataFrame:
    """An unknown label is not a negative one: precision and recall only where nothing is unknown, bounds otherwise."""
    ends = flagged(edges).select(F.explode(F.array("src", "dst")).alias("node"), "kept")
    label = F.expr("case cast(substr(node, 2) as bigint) % 4 when 0 then true when 1 then false end")
    n = ends.groupBy("node").agg(F.bool_or("kept").alias("predicted")).withColumn("label", label)
    count = lambda c: F.count_if(F.coalesce(F.expr(c), F.lit(False)))
    c = n.agg(
        count("predicted and label").alias("tp"), count("predicted and not label").alias("fp"), count("not predicted and label").alias("fn"), count("not predicted and not label").alias("tn"),
        count("label is null").alias("unknown"), count("predicted and label is null").alias("unreviewed"), count("predicted").alias("predicted"),
    )
    return c.select(
        "*", F.expr("round(tp / nullif(tp + fn, 0), 6)").alias("known_recall"), F.expr("round(case when unreviewed = 0 then tp / nullif(predicted, 0) end, 6)").alias("precision"),
        F.expr("round(case when unknown = 0 then tp / nullif(tp + fn, 0) end, 6)").alias("recall"), F.expr("round(tp / nullif(predicted, 0), 6)").alias("least_precision"), F.expr("round((tp + unreviewed) / nullif(predicted, 0), 6)").alias("most_precision"),
    )


@edge_query(f""", {FLAGS}, c AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE kept) AS output, count(*) FILTER (WHERE truth) AS positives, count(*) FILTER (WHERE truth AND kept) AS hits, count(*) FILTER (WHERE truth AND edge_id % {POI} = 0) AS pois, count(*) FILTER (WHERE truth AND kept AND edge_id % {POI} = 0) AS poi_hits FROM flags)
SELECT candidates, output, positives, hits, positives - hits AS misses, round(hits / positives, 6) AS observed_recall, round((hits - poi_hits) / nullif(positives - pois, 0), 6) AS other_recall, output - hits AS unreviewed, CAST(NULL AS BIGINT) AS fp, hits AS tp_if_exhaustive, round(hits / output, 6) AS precision_if_exhaustive, round((output - hits) / (candidates - positives), 6) AS false_positive_rate_if_exhaustive FROM c""")
def event_metrics(edges: DataFrame) -> DataFrame:
    """Decisions against known positives: what is not known is unreviewed, and false positives are withheld unless labels are exhaustive."""
    c = flagged(edges).agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("output"), F.count_if("truth").alias("positives"), F.count_if(F.expr("truth and kept")).alias("hits"),
        F.count_if(F.expr(f"truth and edge_id % {POI} = 0")).alias("pois"), F.count_if(F.expr(f"truth and kept and edge_id % {POI} = 0")).alias("poi_hits"),
    )
    return c.selectExpr(
        "candidates", "output", "positives", "hits", "positives - hits as misses", "round(hits / nullif(positives, 0), 6) as observed_recall", "round((hits - poi_hits) / nullif(positives - pois, 0), 6) as other_recall",
        "output - hits as unreviewed", "cast(null as bigint) as fp", "hits as tp_if_exhaustive", "round(hits / nullif(output, 0), 6) as precision_if_exhaustive", "round((output - hits) / nullif(candidates - positives, 0), 6) as false_positive_rate_if_exhaustive",
    )


@edge_query(f", {SCORED}, m AS (SELECT src, dst, max(rarity) AS top, min(edge_id) AS first FROM scored GROUP BY ALL) SELECT edge_id, top AS shared, first FROM scored JOIN m USING (src, dst)")
def shared_group_scores(edges: DataFrame) -> DataFrame:
    """Every event of a channel gets its channel's largest score and smallest id."""
    scored = tied(edges)
    top = scored.groupBy("src", "dst").agg(F.max("rarity").alias("shared"), F.min("edge_id").alias("first"))
    return scored.join(top, ["src", "dst"]).select("edge_id", "shared", "first")


SWEEP = f"""{SCORED}, {CHAINS}, n AS (SELECT count(*) AS n FROM edges), placed AS (
  SELECT 'rarity' AS method, edge_id, rarity AS s, row_number() OVER (ORDER BY mandatory DESC, rarity DESC, tie) AS place FROM scored
  UNION ALL SELECT 'random', edge_id, rarity, row_number() OVER (ORDER BY mandatory DESC, tie) FROM scored),
ratios AS (SELECT CAST(unnest([{", ".join(map(str, RATIOS))}]) AS DOUBLE) AS ratio), cut_ AS (SELECT ratio, greatest(1, CAST(floor(n * ratio + 1e-9) AS BIGINT)) AS b FROM ratios, n),
kept_ AS (SELECT method, ratio, edge_id, s, place <= b AS k FROM placed, cut_),
ev AS (SELECT method, ratio, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE k AND edge_id % {TRUTH} = 0) / count(*) FILTER (WHERE edge_id % {TRUTH} = 0) AS recall, sum(s) FILTER (WHERE k) / sum(s) AS mass FROM kept_ GROUP BY ALL),
wh AS (SELECT method, ratio, path, bool_and(k) AS whole FROM path JOIN kept_ USING (edge_id) GROUP BY ALL), pa AS (SELECT method, ratio, count(*) FILTER (WHERE whole) AS paths, count(*) AS all_paths FROM wh GROUP BY ALL),
sweep AS (SELECT method, ratio, kept, round(recall, 6) AS recall, round(mass, 6) AS mass, paths, all_paths FROM ev JOIN pa USING (method, ratio))"""


def sweep(edges: DataFrame) -> DataFrame:
    """What two orders keep at each ratio: one ranking for each order, whatever the number of ratios."""
    scored, n = G.cut(keyed(tied(edges))), edges.count()
    ratios = edges.sparkSession.createDataFrame([(r, max(1, int(n * r + 1e-9))) for r in RATIOS], "ratio double, b long")
    one = O.ranked(scored, [], ["key"]).select(F.lit("rarity").alias("method"), "edge_id", "rarity", "place")
    two = O.ranked(scored.withColumn("mixed", F.concat(F.substring("key", 1, 1), "tie")), [], ["mixed"]).select(F.lit("random").alias("method"), "edge_id", "rarity", "place")
    kept = one.union(two).join(F.broadcast(ratios)).withColumn("k", F.col("place") <= F.col("b"))  # five ratios
    truth = F.col("edge_id") % TRUTH == 0
    events = kept.groupBy("method", "ratio").agg(
        F.count_if("k").alias("kept"), F.round(F.count_if(F.col("k") & truth) / F.count_if(truth), 6).alias("recall"), F.round(F.sum(F.when(F.col("k"), F.col("rarity"))) / F.sum("rarity"), 6).alias("mass"),
    )
    whole = own_chains(edges).join(kept, "edge_id").groupBy("method", "ratio", "path").agg(F.bool_and("k").alias("whole"))
    paths = whole.groupBy("method", "ratio").agg(F.count_if("whole").alias("paths"), F.count("*").alias("all_paths"))
    return events.join(paths, ["method", "ratio"])


@edge_query(f", {SWEEP} SELECT * FROM sweep")
def ratio_sweep(edges: DataFrame) -> DataFrame:
    return sweep(edges)


@edge_query(f", {SWEEP} SELECT method, min(ratio) FILTER (WHERE paths = m) AS least_ratio, max(m) AS most_paths, bool_or(paths = all_paths) AS all_restored FROM (SELECT *, max(paths) OVER (PARTITION BY method) AS m FROM sweep) GROUP BY ALL")
def minimum_sufficient(edges: DataFrame) -> DataFrame:
    """The least ratio at which a method keeps as many whole paths as it ever does."""
    rows = sweep(edges)
    most = rows.groupBy("method").agg(F.max("paths").alias("m"))
    return rows.join(most, "method").groupBy("method").agg(F.min(F.when(F.col("paths") == F.col("m"), F.col("ratio"))).alias("least_ratio"), F.max("m").alias("most_paths"), F.bool_or(F.col("paths") == F.col("all_paths")).alias("all_restored"))


@edge_query(f", {SWEEP}, o AS (SELECT method, ratio, mass, mass >= 0.6 AS meets, row_number() OVER (PARTITION BY method ORDER BY CASE WHEN mass >= 0.6 THEN 0 ELSE 1 END, CASE WHEN mass >= 0.6 THEN ratio ELSE -mass END, ratio) AS k FROM sweep) SELECT method, ratio, mass, meets FROM o WHERE k = 1")
def operating_point(edges: DataFrame) -> DataFrame:
    """The least ratio that reaches a share of the score, or the one that comes nearest."""
    meets = F.col("mass") >= 0.6
    best = F.min_by(F.struct("ratio", "mass", meets.alias("meets")), F.struct(F.when(meets, 0).otherwise(1), F.when(meets, F.col("ratio")).otherwise(-F.col("mass")), "ratio"))
    return sweep(edges).groupBy("method").agg(best.alias("b")).select("method", "b.ratio", "b.mass", "b.meets")


@edge_query(f", {SWEEP}, l AS (SELECT method, ratio, paths - coalesce(lag(paths) OVER (PARTITION BY method ORDER BY ratio), 0) AS restored, recall - coalesce(lag(recall) OVER (PARTITION BY method ORDER BY ratio), 0) AS gain FROM sweep) SELECT method, ratio, restored, round(gain, 6) AS gain FROM l")
def marginal_gains(edges: DataFrame) -> DataFrame:
    """What each larger ratio adds."""
    w = Window.partitionBy("method").orderBy("ratio")  # a row a ratio
    less = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    return sweep(edges).select("method", "ratio", less("paths").alias("restored"), F.round(less("recall"), 6).alias("gain"))


@edge_query(f", {SWEEP} SELECT method, round(min(recall), 6) AS least_recall, round(avg(nullif(recall, 0)), 6) AS mean_recall, min(paths) AS least_paths, bool_and(kept > 0) AS all_feasible, count(*) AS runs FROM sweep GROUP BY ALL")
def sweep_summary(edges: DataFrame) -> DataFrame:
    return sweep(edges).groupBy("method").agg(F.min("recall").alias("least_recall"), F.round(F.avg(F.nullif("recall", F.lit(0.0))), 6).alias("mean_recall"), F.min("paths").alias("least_paths"), F.bool_and(F.col("kept") > 0).alias("all_feasible"), F.count("*").alias("runs"))


@edge_query(f", {SWEEP} SELECT method, ratio, (SELECT n FROM n) AS events_before, kept AS events_after, recall, round(paths / all_paths, 6) AS path_retention FROM sweep")
def publication_rows(edges: DataFrame) -> DataFrame:
    n = edges.count()
    return sweep(edges).select("method", "ratio", F.lit(n).cast("long").alias("events_before"), F.col("kept").alias("events_after"), "recall", F.round(F.col("paths") / F.col("all_paths"), 6).alias("path_retention"))


@edge_query(f", {SCORED} SELECT edge_id, place, rarity, rarity_share FROM (SELECT edge_id, rarity, round(rarity / sum(rarity) OVER (), 9) AS rarity_share, row_number() OVER (ORDER BY mandatory DESC, rarity DESC, tie) AS place FROM scored) WHERE place <= 100")
def top_scores(edges: DataFrame) -> DataFrame:
    """The hundred best with their share of the whole."""
    scored = G.cut(keyed(tied(edges)))
    total = scored.agg(F.sum("rarity")).first()[0] or 1.0
    best = scored.orderBy("key").limit(100)
    return best.select("edge_id", F.row_number().over(Window.orderBy("key")).cast("long").alias("place"), "rarity", F.round(F.col("rarity") / F.lit(total), 9).alias("rarity_share"))


MISS = "CASE WHEN e.edge_id IS NULL THEN 'absent' WHEN e.edge_id % 5 = 0 THEN 'excluded' WHEN s.hop IS NULL OR d.hop IS NULL THEN 'not_time_respecting' WHEN e.timestamp_ns > t0 THEN 'future' ELSE 'unreached' END"


@edge_query(f", {FLAGS}, {HOPS}, truth AS (SELECT edge_id FROM edges WHERE edge_id % {TRUTH} = 0 UNION ALL SELECT edge_id + 1000000000 FROM edges WHERE edge_id % 131 = 0), t0 AS (SELECT min(timestamp_ns) AS t0 FROM pois) SELECT {MISS} AS reason, count(*) AS events FROM truth t LEFT JOIN flags e USING (edge_id) LEFT JOIN near s ON s.node = e.src LEFT JOIN near d ON d.node = e.dst, t0 WHERE e.edge_id IS NULL OR NOT e.kept GROUP BY ALL".replace("t LEFT JOIN flags e USING (edge_id)", "t LEFT JOIN flags e ON e.edge_id = t.edge_id"))
def miss_reasons(edges: DataFrame) -> DataFrame:
    """Why labelled events are missed: the first reason that holds."""
    truth = edges.where(F.col("edge_id") % TRUTH == 0).select("edge_id").union(edges.where("edge_id % 131 = 0").select(F.col("edge_id") + 1_000_000_000))
    near = G.neighbourhood(edges, seeds(edges), 2)
    side = lambda end: near.select(F.col("node").alias(end), F.col("hop").alias(f"{end}_hop"))
    t0 = pois(edges).agg(F.min("timestamp_ns")).first()[0]
    rows = truth.join(flagged(edges).select("edge_id", "src", "dst", "timestamp_ns", "kept"), "edge_id", "left").where("kept is null or not kept").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    reason = F.when(F.col("kept").isNull(), "absent").when(F.col("edge_id") % 5 == 0, "excluded").when(F.expr("src_hop is null or dst_hop is null"), "not_time_respecting").when(F.col("timestamp_ns") > t0, "future").otherwise("unreached")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("events"))


@edge_query(f", {MARKED}, g AS (SELECT DISTINCT p.edge_id AS grp, e.edge_id FROM p JOIN edges e ON e.dst = p.dst AND abs(e.timestamp_ns - p.timestamp_ns) <= {5 * DAY}) SELECT edge_id, count(DISTINCT grp) AS groups FROM g GROUP BY ALL HAVING count(DISTINCT grp) > 1")
def duplicate_assignments(edges: DataFrame) -> DataFrame:
    """Events that belong to more than one alert group: the groups up to the end of an event's range less those before its start, both from running counts."""
    span, none = 5 * DAY, F.lit(None).cast("long")
    groups = marked(edges).select("dst", F.col("timestamp_ns").alias("t"), F.lit(1).alias("kind"), "edge_id", F.lit(1).cast("long").alias("one"))
    ask = lambda t, kind: edges.select("dst", t.alias("t"), F.lit(kind).alias("kind"), "edge_id", none.alias("one"))
    # Of one time: asks for what is strictly before, then groups, then asks for what is there.
    rows = groups.unionByName(ask(F.col("timestamp_ns") - span, 0)).unionByName(ask(F.col("timestamp_ns") + span, 2))
    seen = O.running(rows, ["dst"], ["t", "kind", "edge_id"], seen=F.col("one")).where("kind <> 1")
    counted = seen.groupBy("edge_id").agg(F.sum(F.when(F.col("kind") == 2, F.col("seen")).otherwise(-F.col("seen"))).alias("groups"))
    return counted.where("groups > 1")


@edge_query(f", {CHAINS}, l AS (SELECT path, count(*) AS n FROM path GROUP BY ALL) SELECT CASE WHEN n = {LENGTH} THEN 'length' ELSE 'no_later_event' END AS reason, count(*) AS paths, CAST(sum(n) AS BIGINT) AS events FROM l GROUP BY ALL")
def termination_reasons(edges: DataFrame) -> DataFrame:
    n = own_chains(edges).groupBy("path").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") == LENGTH, "length").otherwise("no_later_event").alias("reason")).agg(F.count("*").alias("paths"), F.sum("n").alias("events"))


PREFIX = f"""{POIS}, f AS (SELECT e.edge_id, p.edge_id AS poi, round(1 / (1 + abs(e.timestamp_ns - p.timestamp_ns) / CAST({DAY} AS DOUBLE)), 6) AS s FROM edges e JOIN pois p ON e.dst = p.src),
parts AS (SELECT edge_id, round(1 - product(1 - s) FILTER (WHERE poi % 1994 = 0), 6) AS half, round(1 - product(1 - s), 6) AS whole FROM f GROUP BY ALL),
noted AS (SELECT edge_id, CASE WHEN edge_id % 10 = 3 THEN coalesce(whole, 0) + 0.5 ELSE coalesce(half, 0) END AS prior, whole FROM parts)"""


def prefix_scores(edges: DataFrame) -> DataFrame:
    """Scores by half of the points of interest (prior) and by all; in every tenth event's prior a fault is planted."""
    p = pois(edges).select(F.col("edge_id").alias("poi"), F.col("src").alias("dst"), F.col("timestamp_ns").alias("poi_ns"))
    s = edges.join(p, "dst").withColumn("s", F.round(1 / (1 + F.abs(F.col("timestamp_ns") - F.col("poi_ns")) / float(DAY)), 6))
    both = s.groupBy("edge_id").agg(F.round(1 - F.product(F.when(F.col("poi") % (2 * POI) == 0, 1 - F.col("s"))), 6).alias("half"), F.round(1 - F.product(1 - F.col("s")), 6).alias("whole"))
    return both.withColumn("prior", F.when(F.col("edge_id") % 10 == 3, F.coalesce("whole", F.lit(0.0)) + 0.5).otherwise(F.coalesce("half", F.lit(0.0))))


@edge_query(f", {PREFIX} SELECT edge_id, prior, whole FROM noted WHERE whole + 1e-12 < prior")
def monotonicity_violations(edges: DataFrame) -> DataFrame:
    """Events whose score falls when points of interest are added: exactly the planted ones."""
    return prefix_scores(edges).where("whole + 1e-12 < prior").select("edge_id", "prior", "whole")


@edge_query(f", {POIS}, f AS (SELECT p.edge_id AS poi, sha256(array_to_string(list(CAST(e.edge_id AS VARCHAR) ORDER BY e.edge_id), ',')) AS digest FROM edges e JOIN pois p ON e.dst = p.src GROUP BY ALL), prior AS (SELECT poi, CASE WHEN poi % 1994 = 0 THEN 'rewritten' ELSE digest END AS digest FROM f) SELECT poi FROM f JOIN prior USING (poi) WHERE f.digest <> prior.digest")
def rewritten_digests(edges: DataFrame) -> DataFrame:
    """Points of interest whose stored digest is not that of their events: the planted ones."""
    p = pois(edges).select(F.col("edge_id").alias("poi"), F.col("src").alias("dst"))
    now = edges.join(p, "dst").groupBy("poi").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("edge_id")), lambda x: x.cast("string")), ","), 256).alias("digest"))
    prior = now.select("poi", F.when(F.col("poi") % (2 * POI) == 0, "rewritten").otherwise(F.col("digest")).alias("prior"))
    return now.join(prior, "poi").where("digest <> prior").select("poi")


@edge_query(f", {SWEEP} SELECT method, ratio, paths, CASE WHEN kept < b THEN 'budget' WHEN paths < before THEN 'paths' ELSE 'ok' END AS gate FROM (SELECT sweep.*, b, coalesce(lag(paths) OVER (PARTITION BY method ORDER BY ratio), 0) AS before FROM sweep JOIN cut_ USING (ratio))")
def completeness_gate(edges: DataFrame) -> DataFrame:
    """Whether each step fills its budget and loses no path that a smaller one kept."""
    n, w = edges.count(), Window.partitionBy("method").orderBy("ratio")
    rows = sweep(edges).withColumn("b", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("ratio") + 1e-9))).withColumn("before", F.coalesce(F.lag("paths").over(w), F.lit(0)))
    return rows.select("method", "ratio", "paths", F.when(F.col("kept") < F.col("b"), "budget").when(F.col("paths") < F.col("before"), "paths").otherwise("ok").alias("gate"))
