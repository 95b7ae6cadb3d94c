"""The event graph over the table `events`: one deterministic mapping from user events to directed information flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrain.schema import DAY_NS


def node_type(node: Column) -> Column:
    first = F.substring(node, 1, 1)
    return F.when(first == "p", "process").when(first == "f", "file").otherwise("socket")


def semantic_key(node: Column) -> Column:
    first, n = F.substring(node, 1, 1), F.substring(node, 2, 20).cast("long")
    return (
        F.when(first == "p", F.concat(F.lit("process:app"), (n % 10).cast("string")))
        .when(first == "f", F.concat(F.lit("file:/home/*/doc"), (n % 25).cast("string")))
        .otherwise(F.concat(F.lit("socket:10.0."), (n % 5).cast("string"), F.lit("."), n.cast("string"), F.lit(":443")))
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges with the types and semantic keys of their ends; events whose ends are the same node are left out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user = F.col("event_type"), F.concat(F.lit("p"), F.col("user_id").cast("string"))
    k = F.regexp_extract("props", "([0-9]+)", 1)
    object_ = F.concat(F.when(kind == "error", "s").when(kind == "signup", "p").otherwise("f"), k)
    relation = (
        F.when(kind == "view", "EVENT_READ").when(kind == "click", "EVENT_EXECUTE").when(kind == "purchase", "EVENT_WRITE")
        .when(kind == "error", "EVENT_SENDTO").otherwise("EVENT_FORK")
    )
    size = F.when(kind.isin("view", "purchase", "error"), F.round(F.col("value") * 100).cast("long"))
    edges = e.select(
        F.col("event_id").alias("edge_id"),
        F.when(kind == "view", object_).otherwise(user).alias("src"),
        F.when(kind == "view", user).otherwise(object_).alias("dst"),
        relation.alias("relation"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
        size.alias("data_size"),
    ).where("src <> dst")
    return edges.select(
        "*", node_type(F.col("src")).alias("src_type"), node_type(F.col("dst")).alias("dst_type"),
        semantic_key(F.col("src")).alias("src_semantic"), semantic_key(F.col("dst")).alias("dst_semantic"),
        F.expr(f"timestamp_ns div {DAY_NS}").alias("day"),
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """uuid, node_type and semantic_key of every node of the edges."""
    ends = edges.select(F.col("src").alias("uuid"), F.col("src_type").alias("node_type"), F.col("src_semantic").alias("semantic_key"))
    return ends.union(edges.select("dst", "dst_type", "dst_semantic")).distinct()


def _case(node: str) -> str:
    return f"CASE substr({node}, 1, 1) WHEN 'p' THEN 'process' WHEN 'f' THEN 'file' ELSE 'socket' END"


def _key(node: str) -> str:
    n = f"CAST(substr({node}, 2) AS BIGINT)"
    return f"CASE substr({node}, 1, 1) WHEN 'p' THEN 'process:app' || ({n} % 10) WHEN 'f' THEN 'file:/home/*/doc' || ({n} % 25) ELSE 'socket:10.0.' || ({n} % 5) || '.' || {n} || ':443' END"


#: The same mapping for the SQL side: common tables `edges` and `nodes`, to be followed by a query or by further tables.
EDGES_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT event_id, event_type, 'p' || user_id AS person, user_id, regexp_extract(props, '([0-9]+)', 1) AS k, epoch_us(ts) * 1000 AS timestamp_ns, value FROM events),
directed AS (
  SELECT event_id AS edge_id, CASE event_type WHEN 'view' THEN 'f' || k ELSE person END AS src,
    CASE event_type WHEN 'view' THEN person WHEN 'error' THEN 's' || k WHEN 'signup' THEN 'p' || k ELSE 'f' || k END AS dst,
    CASE event_type WHEN 'view' THEN 'EVENT_READ' WHEN 'click' THEN 'EVENT_EXECUTE' WHEN 'purchase' THEN 'EVENT_WRITE' WHEN 'error' THEN 'EVENT_SENDTO' ELSE 'EVENT_FORK' END AS relation,
    timestamp_ns, 'h' || (user_id % 3) AS host,
    CASE WHEN event_type IN ('view', 'purchase', 'error') THEN CAST(round(value * 100) AS BIGINT) END AS data_size
  FROM raw),
edges AS (
  SELECT *, {_case("src")} AS src_type, {_case("dst")} AS dst_type, {_key("src")} AS src_semantic, {_key("dst")} AS dst_semantic,
    timestamp_ns // {DAY_NS} AS day
  FROM directed WHERE src <> dst),
nodes AS (
  SELECT src AS uuid, src_type AS node_type, src_semantic AS semantic_key FROM edges UNION SELECT dst, dst_type, dst_semantic FROM edges)
"""
