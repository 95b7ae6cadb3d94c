"""Queries: histories, priorities, neighbours, votes and features of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import mixtures as M
from trailgrain.operators import ordered as O
from trailgrain.operators import scoring as S
from trailgrain.operators import sessions
from trailgrain.operators.graph import cut
from trailgrain.plans.profiles import CUTOFF
from trailgrain.plans.ranking import SCORED, tied
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POIS, RARITY, dependency_features, pois, rounded_rarity

DAY, MINUTE = 24 * HOUR, HOUR // 60
CHANNEL = ("host", "relation", "src_type", "src_semantic", "dst_type", "dst_semantic")
LEAST, ALPHA = 8, 10.0

HISTORY = f"""fit AS (SELECT {", ".join(CHANNEL)}, count(DISTINCT timestamp_ns // {MINUTE}) AS c FROM edges WHERE timestamp_ns < {CUTOFF} GROUP BY ALL),
tot AS (SELECT host, relation, sum(c) AS total, count(DISTINCT dst_type || '|' || dst_semantic) AS v FROM fit GROUP BY ALL), so AS (SELECT host, relation, src_type, src_semantic, sum(c) AS s FROM fit GROUP BY ALL), de AS (SELECT host, relation, dst_type, dst_semantic, sum(c) AS d FROM fit GROUP BY ALL),
nov AS (SELECT x.*, coalesce(fit.c, 0) AS n, round(-ln(greatest((coalesce(fit.c, 0) + {ALPHA} * (coalesce(d, 0) + 1) / (coalesce(total, 0) + coalesce(v, 0) + 1)) / (coalesce(s, 0) + {ALPHA}), 1e-300)), 6) AS novelty, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT {", ".join(CHANNEL)} FROM edges) x LEFT JOIN fit USING ({", ".join(CHANNEL)}) LEFT JOIN tot USING (host, relation) LEFT JOIN so USING (host, relation, src_type, src_semantic) LEFT JOIN de USING (host, relation, dst_type, dst_semantic)),
dist AS (SELECT host, relation, novelty, sum(n) AS w FROM nov GROUP BY ALL), cum AS (SELECT host, relation, novelty, w, sum(w) OVER (PARTITION BY host, relation ORDER BY novelty) - w AS below, sum(w) OVER (PARTITION BY host, relation) AS whole FROM dist)"""


def history(edges: DataFrame) -> DataFrame:
    """Novelty of each channel by smoothed conditional frequency before the cutoff, and its percentile among what was seen."""
    past = edges.where(F.col("timestamp_ns") < CUTOFF)
    fit = past.groupBy(*CHANNEL).agg(F.countDistinct(F.expr(f"timestamp_ns div {MINUTE}")).alias("n"))
    total = fit.groupBy("host", "relation").agg(F.sum("n").alias("total"), F.countDistinct("dst_type", "dst_semantic").alias("v"))
    source = fit.groupBy("host", "relation", "src_type", "src_semantic").agg(F.sum("n").alias("s"))
    target = fit.groupBy("host", "relation", "dst_type", "dst_semantic").agg(F.sum("n").alias("d"))
    rows = edges.select(*CHANNEL).distinct().join(fit, [*CHANNEL], "left").join(total, ["host", "relation"], "left")
    rows = rows.join(source, ["host", "relation", "src_type", "src_semantic"], "left").join(target, ["host", "relation", "dst_type", "dst_semantic"], "left").fillna(0, ["n", "total", "v", "s", "d"])
    prior = (F.col("d") + 1) / (F.col("total") + F.col("v") + 1)
    rows = rows.withColumn("novelty", F.round(-F.log(F.greatest((F.col("n") + ALPHA * prior) / (F.col("s") + ALPHA), F.lit(1e-300))), 6))
    seen = rows.groupBy("host", "relation", "novelty").agg(F.sum("n").alias("w"))
    placed = O.running(seen, ["host", "relation"], ["novelty"], below=F.col("w")).join(seen.groupBy("host", "relation").agg(F.sum("w").alias("whole")), ["host", "relation"])
    return rows.join(placed, ["host", "relation", "novelty"]).withColumn("percentile", (F.col("below") + F.col("w") / 2 + 1) / (F.col("whole") + 2))


@edge_query(f", {HISTORY} SELECT {', '.join(CHANNEL)}, novelty, round((below + w / 2 + 1) / (whole + 2) + 1e-9, 6) AS percentile FROM nov JOIN cum USING (host, relation, novelty)")
def channel_history(edges: DataFrame) -> DataFrame:
    return history(edges).select(*CHANNEL, "novelty", F.round(F.col("percentile") + 1e-9, 6).alias("percentile"))


@edge_query(f", {RARITY}, {HISTORY} SELECT edge_id, round(CASE WHEN total >= {LEAST} AND whole >= {LEAST} THEN 0.5 * rarity + 0.5 * (below + w / 2 + 1) / (whole + 2) ELSE rarity END + 1e-9, 6) AS mixed FROM rarity JOIN nov USING ({', '.join(CHANNEL)}) JOIN cum USING (host, relation, novelty)")
def history_mixed_rarity(edges: DataFrame) -> DataFrame:
    """Rarity mixed with the history's percentile where there is enough history."""
    rows = rounded_rarity(edges).join(history(edges).select(*CHANNEL, "total", "whole", "percentile"), [*CHANNEL])
    mixed = F.when((F.col("total") >= LEAST) & (F.col("whole") >= LEAST), 0.5 * F.col("rarity") + 0.5 * F.col("percentile")).otherwise(F.col("rarity"))
    return rows.select("edge_id", F.round(mixed + 1e-9, 6).alias("mixed"))


NEAR = f"{RARITY}, {POIS}, near AS (SELECT edge_id, src, dst, rarity, min(abs(e.timestamp_ns - p.t)) AS delta FROM rarity e, (SELECT timestamp_ns AS t FROM pois) p GROUP BY ALL)"


@edge_query(f", {NEAR}, fan AS (SELECT dst, count(*) AS f FROM edges GROUP BY ALL) SELECT edge_id, round(0.5 * rarity + 0.3 * exp(-delta / CAST({HOUR} AS DOUBLE)) + 0.2 / (1 + ln(1 + f - 1)), 6) AS priority FROM near JOIN fan USING (dst)")
def search_priority(edges: DataFrame) -> DataFrame:
    """How soon a search should follow an event: rare, near in time, with little fan-out."""
    fan = edges.groupBy("dst").agg(F.count("*").alias("f"))
    rows = S.nearest_poi_ns(rounded_rarity(edges), pois(edges)).join(fan, "dst")
    value = 0.5 * F.col("rarity") + 0.3 * F.exp(-F.col("distance_ns") / float(HOUR)) + 0.2 / (1 + F.log1p(F.col("f") - 1))
    return rows.select("edge_id", F.round(value, 6).alias("priority"))


@edge_query(f", {NEAR}, t AS (SELECT src, sum(rarity) AS total FROM near GROUP BY ALL) SELECT edge_id, round(0.5 * rarity + 0.3 / (1 + delta / CAST({HOUR} AS DOUBLE)) + 0.2 * rarity / (total + 1e-12), 6) AS score FROM near JOIN t USING (src)")
def additive_fusion(edges: DataFrame) -> DataFrame:
    """Weighted sum of rarity, nearness and the share of the source."""
    rows = S.nearest_poi_ns(rounded_rarity(edges), pois(edges))
    total = rows.groupBy("src").agg(F.sum("rarity").alias("total"))
    value = 0.5 * F.col("rarity") + 0.3 * E.temporal_affinity(F.col("distance_ns"), HOUR) + 0.2 * F.col("rarity") / (F.col("total") + 1e-12)
    return rows.join(total, "src").select("edge_id", F.round(value, 6).alias("score"))


VIEWS = f"{SCORED}, v AS (SELECT src AS node, max(rarity) AS a, count(*) AS b, CAST(sum(coalesce(data_size, 0)) AS DOUBLE) AS c FROM scored GROUP BY ALL)"


def views(edges: DataFrame) -> DataFrame:
    return tied(edges).groupBy(F.col("src").alias("node")).agg(F.max("rarity").alias("a"), F.count("*").alias("b"), F.sum(F.coalesce("data_size", F.lit(0))).cast("double").alias("c"))


@edge_query(f""", {VIEWS}, p AS (SELECT node, 1 - (rank() OVER (ORDER BY a DESC) - 1 + count(*) OVER (PARTITION BY a) / 2) / count(*) OVER () AS a, 1 - (rank() OVER (ORDER BY b DESC) - 1 + count(*) OVER (PARTITION BY b) / 2) / count(*) OVER () AS b, 1 - (rank() OVER (ORDER BY c DESC) - 1 + count(*) OVER (PARTITION BY c) / 2) / count(*) OVER () AS c FROM v),
s AS (SELECT node, a, b, c, greatest(a, b, c) AS hi, least(a, b, c) AS lo, a + b + c - greatest(a, b, c) - least(a, b, c) AS mid FROM p),
d AS (SELECT node, [a, b, c, hi + mid, (hi + exp(5 * (mid - hi)) * mid) / (1 + exp(5 * (mid - hi))), a + b + c, (hi + exp(5 * (mid - hi)) * mid + exp(5 * (lo - hi)) * lo) / (1 + exp(5 * (mid - hi)) + exp(5 * (lo - hi)))] AS x FROM s),
q AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, round(quantile_cont(x[i], 0.9), 9) AS t FROM d, (SELECT unnest(range(1, 8)) AS i) GROUP BY i))
SELECT node, CAST(len(list_filter(range(1, 8), lambda i: round(x[i], 9) > t[i])) AS BIGINT) AS votes, len(list_filter(range(1, 8), lambda i: round(x[i], 9) > t[i])) >= 4 AS predicted FROM d, q""")
def vote_fusion(edges: DataFrame) -> DataFrame:
    """Seven dimensions of three views' percentiles vote, each above its own quantile; four votes decide."""
    rows = views(edges)
    n = rows.count()
    for c in "abc":
        rows = O.midranks(rows, [], c, f"m_{c}").withColumn(f"p_{c}", 1 - (F.col(f"m_{c}") - F.lit(0.5)) / n)
    a, b, c = (F.col(f"p_{x}") for x in "abc")
    hi, lo = F.greatest(a, b, c), F.least(a, b, c)
    mid = a + b + c - hi - lo
    e = lambda x: F.exp(5 * (x - hi))
    dims = [a, b, c, hi + mid, (hi + e(mid) * mid) / (1 + e(mid)), a + b + c, (hi + e(mid) * mid + e(lo) * lo) / (1 + e(mid) + e(lo))]
    rows = rows.select("node", *[d.alias(f"x{k}") for k, d in enumerate(dims)])
    cuts = rows.agg(*[F.round(F.percentile(f"x{k}", 0.9), 9).alias(f"t{k}") for k in range(7)])
    votes = sum(((F.round(F.col(f"x{k}"), 9) > F.col(f"t{k}")).cast("long") for k in range(1, 7)), (F.round(F.col("x0"), 9) > F.col("t0")).cast("long"))
    return rows.join(F.broadcast(cuts)).select("node", votes.alias("votes"), (votes >= 4).alias("predicted"))  # one row of cuts


@edge_query(f", {VIEWS}, r AS (SELECT * FROM v ORDER BY node LIMIT 20), d AS (SELECT v.node, sqrt(pow(v.a - r.a, 2) + pow(ln(1 + v.b) - ln(1 + r.b), 2) + pow(ln(1 + v.c) - ln(1 + r.c), 2)) AS x FROM v, r), k AS (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY x) AS k FROM d) SELECT node, round(avg(x), 5) AS distance FROM k WHERE k <= 5 GROUP BY ALL")
def neighbour_distance(edges: DataFrame) -> DataFrame:
    """Mean distance of each node's features to the five nearest of a reference set of twenty, which travels as one array."""
    rows = views(edges).select("node", F.array("a", F.log1p("b"), F.log1p("c")).alias("x"))
    known = rows.orderBy("node").limit(20).agg(F.collect_list("x").alias("known"))
    gaps = F.array_sort(F.transform("known", lambda r: F.sqrt(F.aggregate(F.zip_with("x", r, lambda p, q: F.pow(p - q, F.lit(2))), F.lit(0.0), lambda s, y: s + y))))
    nearest = F.slice(gaps, 1, 5)
    return rows.join(F.broadcast(known)).select("node", F.round(F.aggregate(nearest, F.lit(0.0), lambda s, y: s + y) / F.size(nearest), 5).alias("distance"))


@edge_query(f""", u AS (SELECT src AS node, timestamp_ns // {HOUR} AS slot, relation, 1 AS o, 0 AS i, dst AS other FROM edges UNION ALL SELECT dst, timestamp_ns // {HOUR}, relation, 0, 1, src FROM edges)
SELECT node, slot, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, count(DISTINCT other) AS neighbours, count(*) FILTER (WHERE relation = 'EVENT_READ') AS reads, count(*) FILTER (WHERE relation = 'EVENT_WRITE') AS writes, count(*) FILTER (WHERE relation = 'EVENT_SENDTO') AS sends FROM u GROUP BY ALL""")
def slot_features(edges: DataFrame) -> DataFrame:
    """Counts and degrees of each node in each slot of time."""
    slot = F.expr(f"timestamp_ns div {HOUR}").alias("slot")
    both = edges.select(F.col("src").alias("node"), slot, "relation", F.lit(1).alias("o"), F.col("dst").alias("other")).union(edges.select("dst", slot, "relation", F.lit(0), "src"))
    count = lambda r: F.count_if(F.col("relation") == r)
    return both.groupBy("node", "slot").agg(
        F.sum("o").alias("outgoing"), (F.count("*") - F.sum("o")).alias("incoming"), F.countDistinct("other").alias("neighbours"),
        count("EVENT_READ").alias("reads"), count("EVENT_WRITE").alias("writes"), count("EVENT_SENDTO").alias("sends"),
    )


@edge_query(f""", busy AS (SELECT file FROM (SELECT CASE WHEN relation = 'EVENT_WRITE' THEN dst ELSE src END AS file, CASE WHEN relation = 'EVENT_WRITE' THEN src ELSE dst END AS process, timestamp_ns FROM edges WHERE relation IN ('EVENT_READ', 'EVENT_WRITE')) GROUP BY file HAVING count(DISTINCT process) >= 60),
w AS (SELECT edge_id, src, timestamp_ns, max(CASE WHEN relation = 'EVENT_WRITE' THEN timestamp_ns END) OVER (PARTITION BY CASE WHEN relation = 'EVENT_WRITE' THEN dst ELSE src END ORDER BY timestamp_ns, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written, relation FROM edges WHERE relation IN ('EVENT_READ', 'EVENT_WRITE'))
SELECT edge_id, src AS file, timestamp_ns - written AS delay_ns FROM w WHERE relation = 'EVENT_READ' AND timestamp_ns - written <= {2 * DAY} AND src NOT IN (SELECT file FROM busy)""")
def context_reads(edges: DataFrame) -> DataFrame:
    """Reads soon after the latest write of their file, unless so many processes use it that it is a boundary."""
    own = edges.where("relation in ('EVENT_READ', 'EVENT_WRITE')")
    writes = F.col("relation") == "EVENT_WRITE"
    own = own.withColumn("file", F.when(writes, F.col("dst")).otherwise(F.col("src"))).withColumn("process", F.when(writes, F.col("src")).otherwise(F.col("dst")))
    busy = own.groupBy("file").agg(F.countDistinct("process").alias("c")).where("c >= 60").select("file")
    written = F.max(F.when(writes, F.col("timestamp_ns"))).over(sessions.running_before(("timestamp_ns", "edge_id"), "file"))
    found = own.withColumn("delay_ns", F.col("timestamp_ns") - written).where(F.expr(f"relation = 'EVENT_READ' and delay_ns <= {2 * DAY}"))
    return found.join(busy, "file", "left_anti").select("edge_id", "file", "delay_ns")


@edge_query(None)
def score_mixture(edges: DataFrame) -> DataFrame:
    """Membership of each event's rarity in the higher of two fitted components, 0 where one fits as well: (edge_id, membership)."""
    rated = cut(rounded_rarity(edges).select("edge_id", F.col("rarity").alias("score")))
    return M.membership(rated, M.fit_mixture(rated)).select("edge_id", F.round("membership", 6).alias("membership"))


@edge_query(None)
def projected_relevance(edges: DataFrame) -> DataFrame:
    """Size, time and rarity of what leads into points of interest, scaled and projected onto the direction that parts two clusters: (edge_id, poi, relevance)."""
    rows = cut(dependency_features(edges).join(rounded_rarity(edges).select("edge_id", "rarity"), "edge_id").withColumn("key", F.concat_ws("|", "edge_id", "poi")))
    names = ["flow", "near", "rarity"]
    points = cut(M.scaled(rows, names))
    weights = M.projection(points, names, "key")
    return points.select("edge_id", "poi", F.round(sum((F.col(n) * float(w) for n, w in zip(names, weights, strict=True)), F.lit(0.0)), 6).alias("relevance"))
