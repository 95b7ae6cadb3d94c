"""Queries: frequency cubes, profiles and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import profiles as P
from trailgrain.plans.registry import edge_query

CUTOFF = 1_705_276_800_000_000_000  # 2024-01-15, UTC
MINUTE = 60_000_000_000


def _cube(name: str):  # noqa: ANN202
    columns = ", ".join(P.CUBES[name])

    def query(edges: DataFrame) -> DataFrame:
        return P.daily_cube(edges, name)

    query.__name__ = f"cube_{name}"
    edge_query(f"SELECT {columns}, count(*) AS event_count FROM edges GROUP BY ALL")(query)


for _name in P.CUBES:
    _cube(_name)

ENDS = "ends AS (SELECT *, src AS uuid, src_type AS node_type, src_semantic AS semantic_key, 'out' AS direction FROM edges UNION ALL SELECT *, dst, dst_type, dst_semantic, 'in' FROM edges)"


@edge_query(f", {ENDS} SELECT day, host, semantic_key, node_type, direction, count(*) AS event_count FROM ends GROUP BY ALL")
def cube_entity(edges: DataFrame) -> DataFrame:
    return P.entity_cube(edges)


@edge_query(f", {ENDS}, firsts AS (SELECT uuid, node_type, min(day) AS first_day FROM ends GROUP BY ALL) SELECT first_day, node_type, count(*) AS node_count FROM firsts GROUP BY ALL")
def cube_node_type_first(edges: DataFrame) -> DataFrame:
    return P.first_seen_cohorts(edges)


def _host_days(name: str, *keys: str) -> None:
    def query(edges: DataFrame) -> DataFrame:
        return P.host_day_counts(edges, CUTOFF, *keys)

    query.__name__ = f"host_days_{name}"
    columns = ", ".join(keys)
    edge_query(f", seen AS (SELECT DISTINCT {columns}, host, day FROM edges WHERE timestamp_ns < {CUTOFF}) SELECT {columns}, count(*) AS host_days FROM seen GROUP BY ALL")(query)


_host_days("exact", "src_semantic", "dst_semantic", "relation")
_host_days("source", "src_semantic", "relation")
_host_days("types", "src_type", "dst_type", "relation")
_host_days("source_type", "src_type", "relation")


@edge_query(f", {ENDS} SELECT semantic_key, direction, count(DISTINCT day) AS active_days FROM ends WHERE timestamp_ns < {CUTOFF} GROUP BY ALL")
def active_days(edges: DataFrame) -> DataFrame:
    return P.active_days(edges, CUTOFF)


@edge_query(f", {ENDS}, cube AS (SELECT day, host, semantic_key, node_type, direction, count(*) AS c FROM ends WHERE day < {CUTOFF // P.DAY_NS} GROUP BY ALL) SELECT semantic_key, direction, count(*) AS active_host_days, CAST(sum(c) AS BIGINT) AS events FROM cube GROUP BY ALL")
def completed_day_counts(edges: DataFrame) -> DataFrame:
    return P.completed_day_counts(edges, CUTOFF)


@edge_query("SELECT max(day) - min(day) + 1 AS total_days FROM edges")
def day_span(edges: DataFrame) -> DataFrame:
    return edges.agg((F.max("day") - F.min("day") + 1).alias("total_days"))


@edge_query("SELECT semantic_key, min(node_type) AS node_type FROM nodes GROUP BY ALL")
def semantic_types(edges: DataFrame) -> DataFrame:
    return P.both_ends(edges).groupBy("semantic_key").agg(F.min("node_type").alias("node_type"))


@edge_query(f""", {ENDS} SELECT 'node_type' AS kind, node_type AS key, count(DISTINCT uuid) AS n FROM ends GROUP BY ALL
UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT 'pattern', src_type || '|' || relation || '|' || dst_type, count(*) FROM edges GROUP BY ALL""")
def type_frequencies(edges: DataFrame) -> DataFrame:
    return P.type_frequencies(edges)


@edge_query(f"SELECT host, src_type, src_semantic, relation, dst_type, dst_semantic, count(DISTINCT timestamp_ns // {MINUTE}) AS buckets FROM edges WHERE timestamp_ns >= {CUTOFF - 7 * P.DAY_NS} AND timestamp_ns < {CUTOFF} GROUP BY ALL")
def minute_occupancy(edges: DataFrame) -> DataFrame:
    return P.occupancy(edges, CUTOFF - 7 * P.DAY_NS, CUTOFF, MINUTE)


@edge_query(", o AS (SELECT src AS dst, count(*) AS c FROM edges GROUP BY ALL), i AS (SELECT dst, count(*) AS c FROM edges GROUP BY ALL) SELECT edge_id, round(coalesce(o.c, 0) / i.c, 6) AS concentration FROM edges JOIN i USING (dst) LEFT JOIN o USING (dst)")
def concentration_ratio(edges: DataFrame) -> DataFrame:
    return P.concentration(edges).select("edge_id", F.round("concentration", 6).alias("concentration"))


CHANNELS = "chan AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, CAST(max(coalesce(data_size, 1)) AS DOUBLE) AS weight FROM edges GROUP BY ALL)"


def sized(edges: DataFrame) -> DataFrame:
    return P.channels(edges.withColumn("w", F.coalesce("data_size", F.lit(1)).cast("double")), "w")


@edge_query(f", {CHANNELS} SELECT * FROM chan")
def interaction_channels(edges: DataFrame) -> DataFrame:
    return sized(edges)


@edge_query(f""", {CHANNELS}, e AS (SELECT a AS node, b AS other, relation, weight FROM chan UNION ALL SELECT b, a, relation, weight FROM chan),
t AS (SELECT node, relation, sum(weight) AS total FROM e GROUP BY ALL HAVING sum(weight) > 0), k AS (SELECT node, count(*) AS kinds FROM t GROUP BY ALL)
SELECT node, other, relation, round(weight / total / kinds, 6) AS share FROM e JOIN t USING (node, relation) JOIN k USING (node)""")
def relation_balance(edges: DataFrame) -> DataFrame:
    return P.relation_balanced(sized(edges)).withColumn("share", F.round("share", 6))


@edge_query(""", pairs AS (SELECT src AS process, dst_semantic AS object, relation FROM edges WHERE src_type = 'process' UNION ALL SELECT dst, src_semantic, relation FROM edges WHERE dst_type = 'process'),
rare AS (SELECT object, relation, 1 / log2(1 + count(DISTINCT process)) AS u FROM pairs GROUP BY ALL)
SELECT edge_id, round(least(CASE WHEN src_type = 'process' THEN d.u END, CASE WHEN dst_type = 'process' THEN s.u END), 6) AS uniqueness
FROM edges e LEFT JOIN rare d ON d.object = e.dst_semantic AND d.relation = e.relation LEFT JOIN rare s ON s.object = e.src_semantic AND s.relation = e.relation""")
def semantic_uniqueness(edges: DataFrame) -> DataFrame:
    return P.semantic_uniqueness(edges).select("edge_id", F.round("uniqueness", 6).alias("uniqueness"))


@edge_query(f"SELECT src, dst, relation, timestamp_ns // {60 * MINUTE} AS block, count(*) AS events, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, sha256(string_agg(CAST(edge_id AS VARCHAR), chr(10) ORDER BY edge_id)) AS bundle_id FROM edges GROUP BY ALL")
def hour_bundles(edges: DataFrame) -> DataFrame:
    return P.bundles(edges, 60 * MINUTE)
