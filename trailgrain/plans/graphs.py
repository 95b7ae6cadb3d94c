"""Queries: neighbourhoods, reachability, routes and diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import graph as G
from trailgrain.operators import profiles as P
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POIS, pois

NODES = f"{POIS}, seeds AS (SELECT src AS node FROM pois UNION SELECT dst FROM pois)"
DAY = 24 * HOUR


def seeds(edges: DataFrame) -> DataFrame:
    return pois(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@edge_query(f""", {NODES}, both_ AS (SELECT src AS node, dst AS next FROM edges UNION SELECT dst, src FROM edges),
k AS (SELECT node, 0 AS hop FROM seeds UNION SELECT next, hop + 1 FROM k JOIN both_ USING (node) WHERE hop < 3) SELECT node, min(hop) AS hop FROM k GROUP BY ALL""")
def neighbourhood(edges: DataFrame) -> DataFrame:
    return G.neighbourhood(edges, seeds(edges), 3)


@edge_query(f""", {NODES}, steps AS (SELECT DISTINCT src AS node, dst AS next FROM edges), k AS (SELECT node FROM seeds UNION SELECT next FROM k JOIN steps USING (node)) SELECT node FROM k""")
def directed_reach(edges: DataFrame) -> DataFrame:
    return G.reachable(edges, seeds(edges)).select("node")


def _arrival(order: str, strict: str) -> str:
    return f""", {POIS}, start AS (SELECT dst AS node, min(timestamp_ns {order}) AS arrival FROM pois GROUP BY ALL),
r AS (SELECT node, arrival FROM start UNION SELECT e.dst, e.timestamp_ns {order} FROM r JOIN edges e ON e.src = r.node AND e.timestamp_ns {order} {strict} r.arrival) SELECT node, min(arrival) AS arrival FROM r GROUP BY ALL"""


def _starts(edges: DataFrame) -> DataFrame:
    return pois(edges).select(F.col("dst").alias("node"), F.col("timestamp_ns").alias("at"))


@edge_query(_arrival("", ">"))
def earliest_arrival(edges: DataFrame) -> DataFrame:
    return G.earliest_arrival(edges, _starts(edges)).withColumnRenamed("at", "arrival")


@edge_query(_arrival(f"// {HOUR}", ">="))
def earliest_arrival_hours(edges: DataFrame) -> DataFrame:
    """In whole hours, where equal times may chain."""
    hours = edges.withColumn("timestamp_ns", F.expr(f"timestamp_ns div {HOUR}"))
    return G.earliest_arrival(hours, _starts(hours), strict=False).withColumnRenamed("at", "arrival")


@edge_query(f""", {POIS}, start AS (SELECT src AS node, max(timestamp_ns) AS arrival FROM pois GROUP BY ALL),
r AS (SELECT node, arrival FROM start UNION SELECT e.src, e.timestamp_ns FROM r JOIN edges e ON e.dst = r.node AND e.timestamp_ns < r.arrival) SELECT node, max(arrival) AS arrival FROM r GROUP BY ALL""")
def latest_departure(edges: DataFrame) -> DataFrame:
    return G.latest_departure(edges, pois(edges).select(F.col("src").alias("node"), F.col("timestamp_ns").alias("at"))).withColumnRenamed("at", "arrival")


def _routes(near: str, far: str, sign: str) -> str:
    return f""", {POIS}, e AS (SELECT edge_id, {near} AS near, {far} AS far, {sign}(timestamp_ns // {HOUR}) AS t FROM edges),
level AS (SELECT e.edge_id, 0 AS depth, e.t, unnest([e.near, e.far]) AS node FROM e JOIN pois USING (edge_id)
  UNION SELECT e.edge_id, m.depth + 1, e.t, e.near FROM (SELECT node, depth, max(t) AS t FROM level WHERE depth < 4 GROUP BY ALL) m JOIN e ON e.far = m.node AND e.t < m.t WHERE e.edge_id % 997 <> 0)
SELECT edge_id, min(depth) AS depth FROM level GROUP BY ALL"""


def _hourly(edges: DataFrame) -> DataFrame:
    return edges.withColumn("timestamp_ns", F.expr(f"timestamp_ns div {HOUR}"))


@edge_query(_routes("src", "dst", ""))
def routes_backward(edges: DataFrame) -> DataFrame:
    """Fewest hops, four at most, over whole hours, so that equal times occur and may not chain."""
    return G.temporal_routes(_hourly(edges), pois(edges), True, rounds=4).select("edge_id", "depth")


@edge_query(_routes("dst", "src", "-"))
def routes_forward(edges: DataFrame) -> DataFrame:
    return G.temporal_routes(_hourly(edges), pois(edges), False, rounds=4).select("edge_id", "depth")


@edge_query(None)
def all_routes_backward(edges: DataFrame) -> DataFrame:
    """Fewest hops without a limit of depth, over whole hours."""
    return G.temporal_routes(_hourly(edges), pois(edges), True).select("edge_id", "depth")


@edge_query(None)
def all_routes_forward(edges: DataFrame) -> DataFrame:
    return G.temporal_routes(_hourly(edges), pois(edges), False).select("edge_id", "depth")


@edge_query(None)
def route_violations(edges: DataFrame) -> DataFrame:
    """Links of routes that are not strictly ordered, not continuous or not one hop shorter; there must be none."""
    hours = _hourly(edges)
    routes = G.temporal_routes(hours, pois(edges), True, rounds=4)
    ends = hours.select("edge_id", "src", "dst", "timestamp_ns").join(routes, "edge_id")
    up = ends.select(F.col("edge_id").alias("parent"), F.col("src").alias("p_src"), F.col("dst").alias("p_dst"), F.col("timestamp_ns").alias("p_t"), F.col("depth").alias("p_depth"))
    joined = ends.join(up, "parent")
    return joined.where("timestamp_ns >= p_t or depth <> p_depth + 1 or (dst <> p_src and not (p_depth = 0 and dst = p_dst))").select("edge_id", "parent")


WALK = f""", {NODES}, chan AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, CAST(1 AS DOUBLE) AS w FROM edges GROUP BY ALL),
both_ AS (SELECT a AS node, b AS next, w FROM chan UNION ALL SELECT b, a, w FROM chan), deg AS (SELECT node, sum(w) AS d FROM both_ GROUP BY ALL),
sh AS (SELECT node, next, sum(w / d) AS s FROM both_ JOIN deg USING (node) GROUP BY ALL), tele AS (SELECT deg.node, CASE WHEN seeds.node IS NULL THEN 0 ELSE 1.0 / (SELECT count(*) FROM seeds) END AS seed FROM deg LEFT JOIN seeds USING (node)),
p0 AS (SELECT node, CAST(seed AS DOUBLE) AS p FROM tele)"""


def _round(k: int) -> str:
    return f", p{k} AS (SELECT t.node, 0.15 * seed + 0.85 * coalesce(m, 0) AS p FROM tele t LEFT JOIN (SELECT next AS node, sum(s * p) AS m FROM sh JOIN p{k - 1} USING (node) GROUP BY ALL) USING (node))"


@edge_query(WALK + "".join(map(_round, range(1, 7))) + " SELECT node, round(p, 6) AS score FROM p6")
def channel_pagerank(edges: DataFrame) -> DataFrame:
    found = P.channels(edges.withColumn("one", F.lit(1.0)), "one")
    return G.channel_pagerank(found, seeds(edges), rounds=6).withColumn("score", F.round("score", 6))


def _impact(k: int) -> str:
    return f""", i{k} AS (SELECT node, CAST(1 AS DOUBLE) AS s FROM seeds UNION ALL SELECT src, least(CAST(1 AS DOUBLE), sum(w * s)) FROM flow JOIN i{k - 1} ON dst = node WHERE src NOT IN (SELECT node FROM seeds) GROUP BY src)"""


@edge_query(f""", {NODES}, t AS (SELECT src, count(*) AS c FROM edges GROUP BY ALL), flow AS (SELECT src, dst, sum(CAST(0.99 AS DOUBLE) / c) AS w FROM edges JOIN t USING (src) GROUP BY ALL), i0 AS (SELECT node, CAST(1 AS DOUBLE) AS s FROM seeds)"""
            + "".join(map(_impact, range(1, 6))) + " SELECT node, round(CAST(s AS DOUBLE), 6) AS score FROM i5")
def dependency_impact(edges: DataFrame) -> DataFrame:
    return G.dependency_impact(weighted(edges), pois(edges), "w", rounds=5).select("node", F.round("score", 6).alias("score"))


def weighted(edges: DataFrame) -> DataFrame:
    """Events with an equal share of their source's 0.99."""
    return edges.join(edges.groupBy("src").agg(F.count("*").alias("c")), "src").withColumn("w", 0.99 / F.col("c"))


@edge_query(None)
def dependency_impact_full(edges: DataFrame) -> DataFrame:
    """The same until no score changes by more than 1e-7."""
    return G.dependency_impact(weighted(edges), pois(edges), "w", rounds=5000, tolerance=1e-7).select("node", F.round("score", 5).alias("score"))


BIRTHS = "births AS (SELECT dst AS process, min(timestamp_ns) AS born, arg_min(src, timestamp_ns) AS parent FROM edges WHERE relation = 'EVENT_FORK' GROUP BY ALL)"


@edge_query(f""", {BIRTHS}, k AS (SELECT process AS root, process, 0 AS generation, born FROM births UNION SELECT k.root, b.process, generation + 1, b.born FROM k JOIN births b ON b.parent = k.process AND b.born > k.born WHERE generation < 4)
SELECT root, process, min(generation) AS generation FROM k GROUP BY ALL""")
def execution_lineage(edges: DataFrame) -> DataFrame:
    forks = edges.where("relation = 'EVENT_FORK'")
    births = forks.groupBy(F.col("dst").alias("process")).agg(F.min("timestamp_ns").alias("born"), F.min_by("src", "timestamp_ns").alias("parent"))
    return G.lineage(births, births.select("process", "born"), 4).select("root", "process", "generation")


def _reach(order: str) -> str:
    a, b, agg = ("src", "dst", "min") if order == "<=" else ("dst", "src", "max")
    return f"""SELECT node, {agg}(moment) AS moment FROM (WITH RECURSIVE r AS (SELECT unnest([src, dst]) AS node, timestamp_ns AS moment FROM pois UNION SELECT e.{b}, e.timestamp_ns FROM r JOIN truth e ON e.{a} = r.node AND r.moment {order} e.timestamp_ns) SELECT * FROM r) GROUP BY ALL"""


@edge_query(f", {POIS}, truth AS (SELECT * FROM edges WHERE edge_id % 5 = 0), fw AS ({_reach('<=')}), bw AS ({_reach('>=')}) SELECT e.edge_id FROM truth e LEFT JOIN fw ON fw.node = e.src LEFT JOIN bw ON bw.node = e.dst WHERE fw.moment <= e.timestamp_ns OR bw.moment >= e.timestamp_ns")
def truth_context(edges: DataFrame) -> DataFrame:
    """Labelled events (here every fifth) that time-ordered chains of labelled events join with a point of interest, either way."""
    truth = G.cut(edges.where("edge_id % 5 = 0"))
    ends = pois(edges).select(F.explode(F.array("src", "dst")).alias("node"), F.col("timestamp_ns").alias("at"))
    ahead = G.earliest_arrival(truth, ends, strict=False).select(F.col("node").alias("src"), F.col("at").alias("since"))
    back = G.latest_departure(truth, ends, strict=False).select(F.col("node").alias("dst"), F.col("at").alias("until"))
    return truth.join(ahead, "src", "left").join(back, "dst", "left").where("since <= timestamp_ns or until >= timestamp_ns").select("edge_id")


@edge_query(_routes("src", "dst", "").replace("FROM edges),", f"FROM edges WHERE EXISTS (SELECT 1 FROM pois p WHERE abs(edges.timestamp_ns - p.timestamp_ns) <= {DAY})),").replace("depth < 4", "depth < 3"))
def window_completion(edges: DataFrame) -> DataFrame:
    """What leads to the points of interest in three hops at most inside the windows of a day around any of them."""
    p = pois(edges).select((F.col("timestamp_ns") - DAY).alias("lo"), (F.col("timestamp_ns") + DAY).alias("hi"))
    p = p.withColumn("hour", F.explode(F.expr(f"sequence(lo div {HOUR}, hi div {HOUR})")))
    inside = edges.withColumn("hour", F.expr(f"timestamp_ns div {HOUR}")).join(p, "hour").where("timestamp_ns between lo and hi").select("edge_id").distinct()
    own = G.cut(edges.join(inside, "edge_id", "left_semi"))
    return G.temporal_routes(_hourly(own), pois(own), True, rounds=3).select("edge_id", "depth")
