"""Queries: sessions, episodes, running counts and as-of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators import graph as G
from trailgrain.operators import ordered as O
from trailgrain.operators import sessions as S
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POIS, pois

DAY = 24 * HOUR


@edge_query(f""", l AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= {DAY} THEN 0 ELSE 1 END AS n FROM edges WINDOW w AS (PARTITION BY src, dst, relation ORDER BY timestamp_ns, edge_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY src, dst, relation ORDER BY timestamp_ns, edge_id) AS grp FROM l)
SELECT src, dst, relation, arg_min(edge_id, timestamp_ns) AS edge_id, max(timestamp_ns) AS timestamp_ns, CAST(sum(data_size) AS BIGINT) AS data_size, count(*) AS members FROM g GROUP BY src, dst, relation, grp""")
def merged_dependencies(edges: DataFrame) -> DataFrame:
    return S.merged_dependencies(edges, DAY)


@edge_query(f""", p AS (SELECT *, CASE WHEN src_type = 'process' THEN src ELSE dst END AS process FROM edges WHERE src_type = 'process' OR dst_type = 'process'),
l AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= {HOUR} THEN 0 ELSE 1 END AS n FROM p WINDOW w AS (PARTITION BY process ORDER BY timestamp_ns, edge_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY process ORDER BY timestamp_ns, edge_id) AS grp FROM l)
SELECT process, CAST(grp AS BIGINT) AS behaviour, count(*) AS events, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM g GROUP BY process, grp""")
def process_behaviours(edges: DataFrame) -> DataFrame:
    own = edges.where("src_type = 'process' or dst_type = 'process'").withColumn("process", F.when(F.col("src_type") == "process", F.col("src")).otherwise(F.col("dst")))
    found = S.gap_groups(own, ["process"], HOUR)
    return found.groupBy("process", F.col("group").alias("behaviour")).agg(F.count("*").alias("events"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


@edge_query(f""", o AS (SELECT src, relation, edge_id, timestamp_ns, row_number() OVER (PARTITION BY src, relation ORDER BY timestamp_ns, edge_id) AS k FROM edges),
r AS (SELECT src, relation, edge_id, k, timestamp_ns AS start FROM o WHERE k = 1
  UNION ALL SELECT o.src, o.relation, o.edge_id, o.k, CASE WHEN o.timestamp_ns - r.start > {DAY} THEN o.timestamp_ns ELSE r.start END FROM r JOIN o ON o.src = r.src AND o.relation = r.relation AND o.k = r.k + 1)
SELECT src, relation, edge_id, start FROM r""")
def bounded_episodes(edges: DataFrame) -> DataFrame:
    return S.bounded_episodes(edges, ["src", "relation"], DAY)


@edge_query(f""", {POIS}, t AS (SELECT edge_id, (e.timestamp_ns - p.timestamp_ns) // {HOUR} AS slice_, e.dst, p.edge_id AS poi, abs(e.timestamp_ns - p.timestamp_ns) // {6 * HOUR} AS slice FROM edges e JOIN pois p USING (dst))
SELECT poi, dst, slice, count(*) AS events FROM t GROUP BY ALL""".replace("SELECT edge_id, (e", "SELECT e.edge_id, (e"))
def fan_out_slices(edges: DataFrame) -> DataFrame:
    """Events at each point of interest's destination in slices of time around it."""
    p = pois(edges).select(F.col("edge_id").alias("poi"), "dst", F.col("timestamp_ns").alias("poi_ns"))
    return edges.join(p, "dst").groupBy("poi", "dst", F.expr(f"abs(timestamp_ns - poi_ns) div {6 * HOUR}").alias("slice")).agg(F.count("*").alias("events"))


@edge_query(", r AS (SELECT src, dst, relation, edge_id, row_number() OVER (PARTITION BY src, dst, relation ORDER BY coalesce(data_size, 0) DESC, timestamp_ns, edge_id) AS k FROM edges) SELECT src, dst, relation, edge_id FROM r WHERE k = 1")
def dependency_representatives(edges: DataFrame) -> DataFrame:
    first = F.min_by("edge_id", F.struct(-F.coalesce("data_size", F.lit(0)), "timestamp_ns", "edge_id"))
    return edges.groupBy("src", "dst", "relation").agg(first.alias("edge_id"))


@edge_query(""", c AS (SELECT edge_id, count(*) OVER (PARTITION BY src_type, relation, dst_type ORDER BY timestamp_ns, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
row_number() OVER (ORDER BY timestamp_ns, edge_id) - 1 AS n FROM edges) SELECT edge_id, round(ln((n + 2) / (c + 1)) / ln(n + 2), 9) AS rarity FROM c""")
def prequential_rarity(edges: DataFrame) -> DataFrame:
    """Rarity of each event's pattern by the counts before it.

    The global count is a sum over minutes and a place within the minute, so that no window covers more than a minute's events.
    """
    order, key = ("timestamp_ns", "edge_id"), ("src_type", "relation", "dst_type")
    rows = edges.withColumn("slot", F.expr(f"timestamp_ns div {HOUR // 60}"))
    before = lambda *keys: F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    patterns = rows.groupBy(*key, "slot").agg(F.count("*").alias("c"))
    earlier = patterns.groupBy("slot").agg(F.sum("c").alias("c")).select("slot", before(F.lit(0)).alias("base"))  # a row a minute
    out = rows.join(earlier, "slot").join(patterns.select(*key, "slot", before(*key).alias("pattern_base")), [*key, "slot"])
    n = F.col("base") + F.row_number().over(Window.partitionBy("slot").orderBy(*order)) - 1
    c = F.col("pattern_base") + F.row_number().over(Window.partitionBy("slot", *key).orderBy(*order)) - 1
    return out.withColumn("n", n).withColumn("c", c).select("edge_id", F.round(F.log((F.col("n") + 2) / (F.col("c") + 1)) / F.log(F.col("n") + 2), 9).alias("rarity"))


@edge_query("SELECT host, count(*) FILTER (WHERE late) AS late, count(*) AS events FROM (SELECT host, timestamp_ns < max(timestamp_ns) OVER (PARTITION BY host ORDER BY hash_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM (SELECT *, sha256(CAST(edge_id AS VARCHAR)) AS hash_order FROM edges)) GROUP BY ALL")
def late_arrivals(edges: DataFrame) -> DataFrame:
    """Events of each host that arrive (here in the order of a hash) after a later one; they are counted, never dropped."""
    arrived = edges.select("host", "timestamp_ns", F.sha2(F.col("edge_id").cast("string"), 256).alias("arrival"))
    seen = O.running_max(arrived, ["host"], ["arrival"], F.col("timestamp_ns"), "latest")
    return seen.groupBy("host").agg(F.count_if(F.coalesce(F.col("timestamp_ns") < F.col("latest"), F.lit(False))).alias("late"), F.count("*").alias("events"))


@edge_query("SELECT host, edge_id FROM (SELECT host, edge_id, row_number() OVER (PARTITION BY host ORDER BY timestamp_ns DESC, edge_id DESC) AS k FROM edges) WHERE k <= 200")
def last_events(edges: DataFrame) -> DataFrame:
    """The last 200 events of each host: the state of an arrival-count window."""
    w = Window.partitionBy("host").orderBy(F.desc("timestamp_ns"), F.desc("edge_id"))
    return edges.withColumn("k", F.row_number().over(w)).where("k <= 200").select("host", "edge_id")


@edge_query(f", g AS (SELECT src, dst, relation, count(DISTINCT timestamp_ns // {HOUR}) AS d FROM edges GROUP BY ALL) SELECT edge_id, round(sqrt(d), 6) AS boost FROM edges JOIN g USING (src, dst, relation)")
def occupancy_boost(edges: DataFrame) -> DataFrame:
    by = edges.groupBy("src", "dst", "relation").agg(F.countDistinct(F.expr(f"timestamp_ns div {HOUR}")).alias("d"))
    return edges.join(by, ["src", "dst", "relation"]).select("edge_id", F.round(F.sqrt("d"), 6).alias("boost"))


@edge_query(f""", p AS (SELECT *, CASE WHEN src_type = 'process' THEN src ELSE dst END AS process FROM edges WHERE src_type = 'process' OR dst_type = 'process')
SELECT edge_id, process, CAST(coalesce(relation = lag(relation) OVER w, false) AS INTEGER) AS same_relation, timestamp_ns - lag(timestamp_ns) OVER w AS elapsed_ns FROM p WINDOW w AS (PARTITION BY process ORDER BY timestamp_ns, edge_id)""")
def consecutive_features(edges: DataFrame) -> DataFrame:
    own = edges.where("src_type = 'process' or dst_type = 'process'").withColumn("process", F.when(F.col("src_type") == "process", F.col("src")).otherwise(F.col("dst")))
    w = Window.partitionBy("process").orderBy("timestamp_ns", "edge_id")
    same = F.coalesce(F.col("relation") == F.lag("relation").over(w), F.lit(False)).cast("int")
    return own.select("edge_id", "process", same.alias("same_relation"), (F.col("timestamp_ns") - F.lag("timestamp_ns").over(w)).alias("elapsed_ns"))


@edge_query(f"SELECT edge_id, count(*) OVER (PARTITION BY src ORDER BY timestamp_ns // {HOUR} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM edges")
def strictly_earlier(edges: DataFrame) -> DataFrame:
    """Events of the source in strictly earlier hours; events of the same hour don't see each other."""
    w = Window.partitionBy("src").orderBy(F.expr(f"timestamp_ns div {HOUR}")).rangeBetween(Window.unboundedPreceding, -1)
    return edges.select("edge_id", F.count("*").over(w).alias("earlier"))


@edge_query(", b AS (SELECT dst AS process, min(timestamp_ns) AS born FROM edges WHERE relation = 'EVENT_FORK' GROUP BY ALL) SELECT process, born, arg_min(src, timestamp_ns) AS parent FROM b JOIN edges e ON e.dst = process AND e.relation = 'EVENT_FORK' GROUP BY ALL")
def process_births(edges: DataFrame) -> DataFrame:
    forks = edges.where("relation = 'EVENT_FORK'")
    return forks.groupBy(F.col("dst").alias("process")).agg(F.min("timestamp_ns").alias("born"), F.min_by("src", "timestamp_ns").alias("parent"))


@edge_query(f", {POIS}, r AS (SELECT p.edge_id AS poi, e.edge_id, row_number() OVER (PARTITION BY p.edge_id ORDER BY abs(e.timestamp_ns - p.timestamp_ns), e.edge_id) AS k FROM pois p JOIN edges e ON e.dst = p.dst AND e.edge_id <> p.edge_id) SELECT poi, edge_id, k FROM r WHERE k <= 3")
def nearest_events(edges: DataFrame) -> DataFrame:
    """The three events at each point of interest's destination that are nearest to it in time.

    They are among those of its own time and of the three times before and after it, so a hub's events are not paired with all its points.
    """
    same = Window.partitionBy("dst", "timestamp_ns").orderBy("edge_id")  # of one time four are enough, as one may be the point itself
    first = edges.select("dst", "timestamp_ns", "edge_id").withColumn("k", F.row_number().over(same)).where("k <= 4")
    times = G.cut(O.ranked(first.groupBy("dst", "timestamp_ns").agg(F.collect_list("edge_id").alias("ids")), ["dst"], ["timestamp_ns"]))
    p = pois(edges).select(F.col("edge_id").alias("poi"), "dst", "timestamp_ns").join(times.drop("ids"), ["dst", "timestamp_ns"])
    p = p.select("poi", "dst", F.col("timestamp_ns").alias("poi_ns"), F.explode(F.sequence(F.col("place") - 3, F.col("place") + 3)).alias("place"))
    near = times.join(p, ["dst", "place"]).select("poi", "poi_ns", "timestamp_ns", F.explode("ids").alias("edge_id")).where("edge_id <> poi")
    w = Window.partitionBy("poi").orderBy(F.abs(F.col("timestamp_ns") - F.col("poi_ns")), "edge_id")
    return near.withColumn("k", F.row_number().over(w)).where("k <= 3").select("poi", "edge_id", F.col("k").cast("long").alias("k"))


@edge_query(f", {POIS}, w AS (SELECT timestamp_ns - {2 * HOUR} AS s, timestamp_ns + {2 * HOUR} AS t FROM pois), o AS (SELECT *, CASE WHEN s <= max(t) OVER (ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM w), g AS (SELECT *, sum(n) OVER (ORDER BY s, t) AS g FROM o) SELECT min(s) AS start_ns, max(t) AS end_ns FROM g GROUP BY g")
def merged_windows(edges: DataFrame) -> DataFrame:
    """The union of the investigation windows around the points of interest."""
    w = pois(edges).select((F.col("timestamp_ns") - 2 * HOUR).alias("start_ns"), (F.col("timestamp_ns") + 2 * HOUR).alias("end_ns"))
    return S.interval_union(w.withColumn("all", F.lit(0)), "start_ns", "end_ns", "all").drop("all")


@edge_query(", w AS (SELECT edge_id, src, timestamp_ns, max(CASE WHEN relation = 'EVENT_WRITE' THEN timestamp_ns END) OVER (PARTITION BY CASE WHEN relation = 'EVENT_WRITE' THEN dst ELSE src END ORDER BY timestamp_ns, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written, relation FROM edges WHERE relation IN ('EVENT_READ', 'EVENT_WRITE')) SELECT edge_id, src AS file, timestamp_ns - written AS delay_ns FROM w WHERE relation = 'EVENT_READ' AND written IS NOT NULL")
def write_then_read(edges: DataFrame) -> DataFrame:
    """Each read with the time since the latest write of its file before it."""
    own = edges.where("relation in ('EVENT_READ', 'EVENT_WRITE')").withColumn("file", F.when(F.col("relation") == "EVENT_WRITE", F.col("dst")).otherwise(F.col("src")))
    written = F.max(F.when(F.col("relation") == "EVENT_WRITE", F.col("timestamp_ns"))).over(S.running_before(("timestamp_ns", "edge_id"), "file"))
    return own.withColumn("written", written).where("relation = 'EVENT_READ' and written is not null").select("edge_id", "file", (F.col("timestamp_ns") - F.col("written")).alias("delay_ns"))
