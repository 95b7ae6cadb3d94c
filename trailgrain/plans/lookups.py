"""Queries: lookups, anchors, predicates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import profiles as P
from trailgrain.plans.registry import edge_query, table_query
from trailgrain.plans.scores import HOUR, POI, POIS, SIGNATURE, pois
from trailgrain.sources.driver_tables import graph_nodes

READS, ANCHORED = "('EVENT_READ')", "('EVENT_READ', 'EVENT_FORK')"


@edge_query("SELECT edge_id, src, dst, relation FROM edges WHERE edge_id IN (7, 42, 997)")
def events_by_id(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_id").isin(7, 42, 997)).select("edge_id", "src", "dst", "relation")


@edge_query("SELECT * FROM nodes")
def all_nodes(edges: DataFrame) -> DataFrame:
    return graph_nodes(edges)


@edge_query(f"SELECT edge_id, CASE WHEN relation IN {ANCHORED} THEN dst ELSE src END AS investigation, CASE WHEN relation IN {READS} THEN dst ELSE src END AS backward, CASE WHEN relation IN {ANCHORED} THEN dst ELSE src END AS forward FROM edges")
def anchors(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", E.investigation_anchor().alias("investigation"), E.backward_anchor().alias("backward"), E.forward_anchor().alias("forward"))


@edge_query("SELECT edge_id, CASE WHEN relation = 'EVENT_EXECUTE' THEN dst ELSE src END AS causal_src, CASE WHEN relation = 'EVENT_EXECUTE' THEN src ELSE dst END AS causal_dst FROM edges")
def causal_endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", E.causal_source().alias("causal_src"), E.causal_target().alias("causal_dst"))


@edge_query(f", s AS (SELECT {SIGNATURE} AS sig, timestamp_ns FROM edges) SELECT count(DISTINCT sig) AS signatures, count(*) AS events FROM s")
def signatures(edges: DataFrame) -> DataFrame:
    return edges.select(E.signature().alias("sig")).agg(F.countDistinct("sig").alias("signatures"), F.count("*").alias("events"))


@edge_query(f", {POIS}, r AS (SELECT p.edge_id AS poi, e.edge_id, row_number() OVER (PARTITION BY p.edge_id ORDER BY e.timestamp_ns DESC, e.edge_id DESC) AS k FROM pois p JOIN edges e ON e.dst = p.src AND e.timestamp_ns <= p.timestamp_ns AND e.timestamp_ns >= p.timestamp_ns - {48 * HOUR}) SELECT poi, edge_id FROM r WHERE k <= 5")
def incoming_before(edges: DataFrame) -> DataFrame:
    """The five latest events into each point of interest's source in the two days before it: a batch of bounded scans."""
    p = pois(edges).select(F.col("edge_id").alias("poi"), F.col("src").alias("dst"), F.col("timestamp_ns").alias("poi_ns"))
    near = edges.join(p, "dst").where((F.col("timestamp_ns") <= F.col("poi_ns")) & (F.col("timestamp_ns") >= F.col("poi_ns") - 48 * HOUR))
    w = Window.partitionBy("poi").orderBy(F.desc("timestamp_ns"), F.desc("edge_id"))
    return near.withColumn("k", F.row_number().over(w)).where("k <= 5").select("poi", "edge_id")


@edge_query(f", {POIS}, w AS (SELECT edge_id AS poi, timestamp_ns - {HOUR} AS lo, timestamp_ns + {HOUR} AS hi FROM pois) SELECT poi, count(*) AS events FROM w JOIN edges e ON e.timestamp_ns BETWEEN lo AND hi GROUP BY ALL")
def window_counts(edges: DataFrame) -> DataFrame:
    """Events in the window around each point of interest: a range join by the hours that a window touches."""
    p = pois(edges).select(F.col("edge_id").alias("poi"), (F.col("timestamp_ns") - HOUR).alias("lo"), (F.col("timestamp_ns") + HOUR).alias("hi"))
    p = p.withColumn("hour", F.explode(F.expr(f"sequence(lo div {HOUR}, hi div {HOUR})")))
    found = edges.withColumn("hour", F.expr(f"timestamp_ns div {HOUR}")).join(p, "hour").where("timestamp_ns between lo and hi")
    return found.groupBy("poi").agg(F.count("*").alias("events"))


@edge_query(", e AS (SELECT edge_id, src AS uuid FROM edges UNION SELECT edge_id, dst FROM edges), c AS (SELECT uuid, count(*) AS events FROM e GROUP BY ALL) SELECT n.uuid, n.node_type, n.semantic_key, events FROM nodes n JOIN c USING (uuid) WHERE n.semantic_key LIKE '%1%' ORDER BY CASE n.node_type WHEN 'process' THEN 0 ELSE 1 END, events DESC, n.uuid LIMIT 60")
def node_search(edges: DataFrame) -> DataFrame:
    """Nodes whose key holds a text, processes first, by their number of events; a page of 60."""
    counts = P.both_ends(edges, "edge_id").select("edge_id", "uuid", "node_type", "semantic_key").distinct().groupBy("uuid", "node_type", "semantic_key").agg(F.count("*").alias("events"))
    return counts.where(F.col("semantic_key").contains("1")).orderBy(F.when(F.col("node_type") == "process", 0).otherwise(1), F.desc("events"), "uuid").limit(60)


LIBRARIES = ("/doc1", "/doc2")  # in the place of "/lib/", "/lib64/", "/usr/lib/", which the table has not


@edge_query(""", lib AS (SELECT uuid FROM nodes WHERE node_type = 'file' AND (lower(semantic_key) LIKE '%/doc1%' OR lower(semantic_key) LIKE '%/doc2%')), p AS (SELECT dst AS uuid, bool_and(src IN (SELECT uuid FROM lib)) AS only_libraries FROM edges GROUP BY ALL)
SELECT n.uuid, n.node_type FROM nodes n LEFT JOIN p USING (uuid) WHERE n.node_type = 'socket' OR (n.node_type = 'file' AND only_libraries IS NULL AND n.uuid NOT IN (SELECT uuid FROM lib)) OR (n.node_type = 'process' AND coalesce(only_libraries, true))""")
def entry_candidates(edges: DataFrame) -> DataFrame:
    """Where an attack may enter: sockets, files that nothing leads to and that are no libraries, processes that only libraries lead to."""
    nodes = graph_nodes(edges)
    marked = [F.lower("semantic_key").contains(m) for m in LIBRARIES]
    library = (F.col("node_type") == "file") & (marked[0] | marked[1])
    named = nodes.select("uuid", "node_type", library.alias("library"))
    parents = edges.select("src", F.col("dst").alias("child")).distinct().join(named.select(F.col("uuid").alias("src"), "library"), "src").groupBy(F.col("child").alias("uuid")).agg(F.bool_and("library").alias("only_libraries"))
    found = named.join(parents, "uuid", "left")
    return found.where("node_type = 'socket' or (node_type = 'file' and only_libraries is null and not library) or (node_type = 'process' and coalesce(only_libraries, true))").select("uuid", "node_type")


@edge_query(", t AS (SELECT uuid FROM nodes WHERE hash(1) IS NOT NULL AND substr(sha256(uuid), 1, 1) < '8') SELECT edge_id FROM edges WHERE src IN (SELECT uuid FROM t) AND dst IN (SELECT uuid FROM t)")
def events_within(edges: DataFrame) -> DataFrame:
    """Events with both ends in a set of nodes (here those whose digest starts low): two semi-joins."""
    chosen = graph_nodes(edges).where("substr(sha2(uuid, 256), 1, 1) < '8'").select("uuid")
    return edges.join(chosen.withColumnRenamed("uuid", "src"), "src", "left_semi").join(chosen.withColumnRenamed("uuid", "dst"), "dst", "left_semi").select("edge_id")


@edge_query(f", {POIS} SELECT p.edge_id AS poi, count(e.edge_id) AS followers FROM pois p LEFT JOIN edges e ON e.src = p.dst AND e.timestamp_ns >= p.timestamp_ns GROUP BY ALL")
def temporal_adjacency(edges: DataFrame) -> DataFrame:
    p = pois(edges).select(F.col("edge_id").alias("poi"), F.col("dst").alias("node"), F.col("timestamp_ns").alias("poi_ns"))
    after = edges.select(F.col("src").alias("node"), "timestamp_ns")
    found = p.join(after, "node").where("timestamp_ns >= poi_ns").groupBy("poi").agg(F.count("*").alias("c"))
    return p.join(found, "poi", "left").select("poi", F.coalesce("c", F.lit(0)).alias("followers"))


@edge_query(f", {POIS} SELECT p.edge_id AS poi, max(e.timestamp_ns) AS before_ns FROM pois p LEFT JOIN edges e ON e.dst = p.dst AND e.timestamp_ns < p.timestamp_ns GROUP BY ALL")
def as_of_probe(edges: DataFrame) -> DataFrame:
    """The latest event at each point of interest's destination before it, over any gap: a window over the node's events."""
    w = Window.partitionBy("dst").orderBy("timestamp_ns").rangeBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("before_ns", F.max("timestamp_ns").over(w)).where(F.col("edge_id") % POI == 0).select(F.col("edge_id").alias("poi"), "before_ns")


@edge_query(f", {POIS} SELECT e.edge_id, p.edge_id AS poi FROM edges e JOIN pois p USING (src, dst, relation) WHERE e.edge_id <> p.edge_id AND e.timestamp_ns // {24 * HOUR * 10} = p.timestamp_ns // {24 * HOUR * 10}")
def dependency_instances(edges: DataFrame) -> DataFrame:
    """Other records of a point of interest's dependency at its time, which here is a stretch of ten days, as no times are equal."""
    slot = F.expr(f"timestamp_ns div {24 * HOUR * 10}").alias("slot")
    p = pois(edges).select("src", "dst", "relation", slot, F.col("edge_id").alias("poi"))
    return edges.withColumn("slot", slot).join(p, ["src", "dst", "relation", "slot"]).where("edge_id <> poi").select("edge_id", "poi")


@edge_query(f""", {POIS}, f AS (SELECT src AS node FROM pois UNION SELECT dst FROM pois) SELECT edge_id FROM edges WHERE src IN (SELECT node FROM f) OR dst IN (SELECT node FROM f)""")
def frontier_hop(edges: DataFrame) -> DataFrame:
    """Events at any node of a frontier: a union of two equi-joins rather than a join on either end."""
    f = pois(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    one = edges.join(f.withColumnRenamed("node", "src"), "src", "left_semi").select("edge_id")
    return one.union(edges.join(f.withColumnRenamed("node", "dst"), "dst", "left_semi").select("edge_id")).distinct()


@table_query("SELECT c_custkey, c_nationkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows from a fact and its dimensions, as events get the attributes of their ends."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, n, r = read("customer"), read("nation"), read("region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "c_nationkey", "n_name", "r_name")


@table_query("SELECT c_custkey, CASE WHEN regexp_matches(ltrim(v), '^[=+@\\t\\r-]') THEN '''' || v ELSE v END AS safe FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name WHEN c_custkey % 3 = 1 THEN ' -' || c_name ELSE c_name END AS v FROM customer)")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("case when c_custkey % 3 = 0 then concat('=', c_name) when c_custkey % 3 = 1 then concat(' -', c_name) else c_name end")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", E.csv_safe(v).alias("safe"))


@edge_query(f", {POIS}, w AS (SELECT timestamp_ns - {HOUR} AS lo, timestamp_ns + {HOUR} AS hi FROM pois), u AS (SELECT DISTINCT e.edge_id, e.src, e.dst FROM w JOIN edges e ON e.timestamp_ns BETWEEN lo AND hi), n AS (SELECT src AS node FROM u UNION SELECT dst FROM u) SELECT (SELECT count(*) FROM u) AS events, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM u) > 20 AS incomplete")
def window_union(edges: DataFrame) -> DataFrame:
    """Different events and nodes in all windows together, and whether that is more than an investigation takes (here 20 events)."""
    p = pois(edges).select((F.col("timestamp_ns") - HOUR).alias("lo"), (F.col("timestamp_ns") + HOUR).alias("hi"))
    p = p.withColumn("hour", F.explode(F.expr(f"sequence(lo div {HOUR}, hi div {HOUR})")))
    own = edges.withColumn("hour", F.expr(f"timestamp_ns div {HOUR}")).join(p, "hour").where("timestamp_ns between lo and hi").select("edge_id", "src", "dst").distinct()
    return own.agg(F.count("*").alias("events")).join(own.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("nodes"))).select("events", "nodes", (F.col("events") > 20).alias("incomplete"))  # a row each
