"""Queries: similarity of consecutive objects and operations of a process, and clusters of behaviour around points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import behaviours as B
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POIS, pois

GAP_S = 6 * HOUR / B.SECOND

_label = "substr({0}_semantic, length({0}_type) + 2)"
SEQUENCES = f"""two AS (SELECT src AS process, edge_id, timestamp_ns AS t, relation, dst_type AS kind, {_label.format('dst')} AS label FROM edges WHERE src_type = 'process'
  UNION ALL SELECT dst, edge_id, timestamp_ns, relation, src_type, {_label.format('src')} FROM edges WHERE dst_type = 'process'),
seq AS (SELECT *, lag(t) OVER w AS pt, lag(label) OVER w AS pl, lag(relation) OVER w AS pr FROM two WINDOW w AS (PARTITION BY process ORDER BY t, edge_id))"""


def labelled(edges: DataFrame) -> DataFrame:
    label = lambda end: F.expr(_label.format(end)).alias(f"{end}_label")
    return edges.select("edge_id", "src", "dst", "src_type", "dst_type", label("src"), label("dst"), "relation", F.col("timestamp_ns").alias("t"))


@edge_query(f""", {SEQUENCES}, cut AS (SELECT *, list_filter(string_split_regex(lower(pl), '[/\\\\]+'), lambda p: p <> '') AS a, list_filter(string_split_regex(lower(label), '[/\\\\]+'), lambda p: p <> '') AS b,
  string_split(regexp_replace(pl, ':[0-9]+$', ''), '.') AS u, string_split(regexp_replace(label, ':[0-9]+$', ''), '.') AS v FROM seq WHERE kind IN ('file', 'socket') AND pt IS NOT NULL),
num AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS c, greatest(len(a), len(b)) AS m, CASE WHEN len(u) = 4 AND len(v) = 4 AND pl NOT LIKE '%/%'
  THEN xor(list_sum([CAST(u[i] AS BIGINT) * CAST(256 ** (4 - i) AS BIGINT) for i in [1, 2, 3, 4]])::BIGINT, list_sum([CAST(v[i] AS BIGINT) * CAST(256 ** (4 - i) AS BIGINT) for i in [1, 2, 3, 4]])::BIGINT) END AS x FROM cut)
SELECT process, edge_id, round(CASE WHEN kind = 'socket' THEN CASE WHEN x IS NULL THEN 0 WHEN x = 0 THEN 1 ELSE (31 - floor(log2(x))) / 32 END WHEN c > 0 AND c < m THEN least(1.0, c / greatest(1, m - 1)) ELSE c / m END, 6)::DOUBLE AS similarity,
  CASE WHEN (pr, relation) IN (('EVENT_READ', 'EVENT_WRITE'), ('EVENT_WRITE', 'EVENT_EXECUTE')) THEN 1.0 WHEN pr = relation THEN 0.5 ELSE 0.0 END::DOUBLE AS operation FROM num""")
def consecutive_similarity(edges: DataFrame) -> DataFrame:
    """How alike the file or socket of each event of a process is to the object before, and the two operations."""
    seq = B.sequences(labelled(edges)).where("prev is not null and kind in ('file', 'socket')")
    by_kind = F.when(F.col("kind") == "file", B.path_similarity(F.col("prev.label"), F.col("label"))).otherwise(B.address_similarity(F.col("prev.label"), F.col("label")))
    return seq.select("process", "edge_id", F.round(by_kind, 6).alias("similarity"), B.operation_similarity(F.col("prev.relation"), F.col("relation")).alias("operation"))


@edge_query(f""", {SEQUENCES}, {POIS}, n AS (SELECT process, edge_id, t, CASE WHEN pt IS NULL OR t - pt > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM seq),
g AS (SELECT edge_id, sum(new) OVER (ORDER BY process, t, edge_id) - 1 AS cluster FROM n), hot AS (SELECT DISTINCT cluster FROM g JOIN pois USING (edge_id))
SELECT e.edge_id, CAST(min(g.cluster) AS BIGINT) AS cluster, CASE WHEN e.edge_id % 997 = 0 OR coalesce(bool_or(hot.cluster IS NOT NULL), false) THEN 1.0 ELSE 0.0 END::DOUBLE AS importance
FROM edges e LEFT JOIN g USING (edge_id) LEFT JOIN hot ON hot.cluster = g.cluster GROUP BY e.edge_id""")
def behaviour_importance(edges: DataFrame) -> DataFrame:
    """The cluster of each event, and 1 for events that share one with a point of interest."""
    return B.importance(edges, B.clusters(B.sequences(labelled(edges)), GAP_S), pois(edges))


@edge_query(None)
def behaviour_features(edges: DataFrame) -> DataFrame:
    """Interval, distance of objects (processes by the vectors of their labels' tokens) and of operations. Token hashes have no SQL here; tests hold them against plain loops."""
    own = labelled(edges)
    known = own.select(F.col("src").alias("node"), F.col("src_label").alias("label")).union(own.select("dst", "dst_label")).distinct().select("label")
    found = B.features(B.sequences(own), known, GAP_S)
    return found.select("process", "edge_id", *[F.round(c, 6).alias(c) for c in ("interval", "object", "operation")])
