"""Queries: pages of events, predicates, matching of alerts and references, and artifacts that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.functions import events as E
from trailgrain.operators import graph as G
from trailgrain.operators import ordered as O
from trailgrain.operators import sessions as S
from trailgrain.plans.continuations import MARKED, STEP, marked
from trailgrain.plans.evaluation import FLAGS, flagged
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR, POI, POIS, RARITY, pois, rounded_rarity

DAY = 24 * HOUR
CONTROL = ("EVENT_CLONE", "EVENT_EXECUTE", "EVENT_EXIT", "EVENT_FORK")  # fixed values: relations that pass control, not data
PAGE = 50


@edge_query(f", k AS (SELECT timestamp_ns AS t, edge_id AS i FROM edges WHERE edge_id = {POI}) SELECT edge_id, timestamp_ns FROM edges, k WHERE timestamp_ns > t OR (timestamp_ns = t AND edge_id > i) ORDER BY timestamp_ns, edge_id LIMIT {PAGE}")
def events_page(edges: DataFrame) -> DataFrame:
    """The page of events after a key in time order."""
    k = edges.where(F.col("edge_id") == POI).select("timestamp_ns").first()
    after = (F.col("timestamp_ns") > k[0]) | ((F.col("timestamp_ns") == k[0]) & (F.col("edge_id") > POI))
    return edges.where(after).select("edge_id", "timestamp_ns").orderBy("timestamp_ns", "edge_id").limit(PAGE)


@edge_query(f", d AS (SELECT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node ORDER BY count(*) DESC, node LIMIT 1) SELECT edge_id, relation FROM edges, d WHERE src = node OR dst = node ORDER BY timestamp_ns DESC, edge_id DESC LIMIT 20 OFFSET 10")
def node_history(edges: DataFrame) -> DataFrame:
    """The second page of the events of the busiest node, newest first."""
    busy = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "node").limit(1).first()
    own = edges.where((F.col("src") == busy.node) | (F.col("dst") == busy.node))
    return own.orderBy(F.desc("timestamp_ns"), F.desc("edge_id")).offset(10).limit(20).select("edge_id", "relation")


@edge_query(f", {FLAGS} SELECT edge_id, relation, kept FROM flags WHERE NOT kept AND (src_semantic || ' ' || dst_semantic) ILIKE '%doc1%' ORDER BY edge_id LIMIT 30 OFFSET 5")
def decision_page(edges: DataFrame) -> DataFrame:
    """A page of removed events whose ends match a text."""
    found = flagged(edges).where(~F.col("kept") & F.concat_ws(" ", "src_semantic", "dst_semantic").ilike("%doc1%"))
    return found.orderBy("edge_id").offset(5).limit(30).select("edge_id", "relation", "kept")


@edge_query(f", s AS (SELECT edge_id, sha256('product-preview-v1' || chr(0) || edge_id) AS h FROM edges) SELECT edge_id FROM s ORDER BY h LIMIT 180")
def preview_sample(edges: DataFrame) -> DataFrame:
    """The 180 events of the smallest keyed hash."""
    return edges.orderBy(F.sha2(F.concat(F.lit("product-preview-v1\0"), F.col("edge_id").cast("string")), 256)).limit(180).select("edge_id")


@edge_query(", s AS (SELECT CAST(edge_id AS VARCHAR) AS id FROM edges) SELECT id, row_number() OVER (ORDER BY id) AS place FROM s")
def canonical_order(edges: DataFrame) -> DataFrame:
    """Events in the order of their ids as text."""
    return O.ranked(edges.select(F.col("edge_id").cast("string").alias("id")), [], ["id"])


@edge_query(f" SELECT edge_id, relation IN {CONTROL} AS control, relation IN ('EVENT_FORK', 'EVENT_READ', 'EVENT_WRITE', 'EVENT_SENDTO') AND src <> dst AS transfer FROM edges")
def dependency_kinds(edges: DataFrame) -> DataFrame:
    """Whether an event passes control, and whether it moves information between different nodes."""
    transfer = F.col("relation").isin("EVENT_FORK", "EVENT_READ", "EVENT_WRITE", "EVENT_SENDTO") & (F.col("src") != F.col("dst"))
    return edges.select("edge_id", F.col("relation").isin(*CONTROL).alias("control"), transfer.alias("transfer"))


def encoded_command(command: Column) -> Column:
    """Whether an option that abbreviates -EncodedCommand has a value."""
    words = F.split(F.lower(command), r"\s+")
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda k: (F.length(F.get(words, k)) >= 2) & F.lit("-encodedcommand").startswith(F.get(words, k)) & F.get(words, k).startswith("-e") & (F.coalesce(F.get(words, k + 1), F.lit("")) != ""))


def hidden_window(command: Column) -> Column:
    words = F.split(F.lower(command), r"\s+")
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda k: F.get(words, k).isin("-w", "-windowstyle") & F.coalesce(F.get(words, k + 1), F.lit("")).isin("hidden", "1"))


COMMANDS = ("powershell -enc QUJD", "powershell -W Hidden -File a", "powershell -encodedCommandX y", "powershell -e", "pwsh -windowstyle 1 -Enco ZZ", "powershell -ex bypass")


@edge_query(f", c AS (SELECT edge_id, list_extract({list(COMMANDS)}, CAST(edge_id % {len(COMMANDS)} AS INTEGER) + 1) AS command FROM edges) SELECT edge_id, regexp_matches(lower(command), '(^|\\s)-(e|en|enc|enco|encod|encode|encoded|encodedc|encodedco|encodedcom|encodedcomm|encodedcomma|encodedcomman|encodedcommand)\\s+\\S+') AS encoded, regexp_matches(lower(command), '(^|\\s)-(w|windowstyle)\\s+(hidden|1)(\\s|$)') AS hidden FROM c")
def command_signals(edges: DataFrame) -> DataFrame:
    """Signs of an encoded command and of a hidden window, on made-up command lines."""
    command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("edge_id") % len(COMMANDS)).cast("int") + 1)
    return edges.select("edge_id", encoded_command(command).alias("encoded"), hidden_window(command).alias("hidden"))


def window_bounds(name: Column, offset_hours: float = -4.0) -> tuple[Column, Column]:
    """Start and end in ns of a window that is named `start~end`, both local times with a fraction; a suffix .txt is ignored."""
    parts = F.split(F.regexp_replace(name, r"\.txt$", ""), "~")

    def ns(text: Column) -> Column:
        halves = F.split(text, r"\.")
        seconds = F.unix_seconds(F.to_timestamp(halves[0], "yyyy-MM-dd HH:mm:ss")) - int(offset_hours * 3600)
        return seconds * 1_000_000_000 + F.rpad(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), 9, "0").cast("long")

    return ns(parts[0]), ns(parts[1])


@edge_query(f", {POIS} SELECT edge_id, timestamp_ns - timestamp_ns % 1000 + {4 * HOUR} AS start_ns, timestamp_ns - timestamp_ns % 1000000000 + {5 * HOUR} AS end_ns FROM pois")
def window_names(edges: DataFrame) -> DataFrame:
    """Windows that are named by local times, four hours behind UTC, are read back."""
    text = lambda ns: F.date_format(F.timestamp_seconds(F.expr(f"({ns}) div 1000000000")), "yyyy-MM-dd HH:mm:ss")
    micros = F.lpad(F.expr("(timestamp_ns % 1000000000) div 1000").cast("string"), 6, "0")
    name = F.concat(text("timestamp_ns"), F.lit("."), micros, F.lit("~"), text(f"timestamp_ns + {HOUR}"), F.lit(".txt"))
    start, end = window_bounds(name)
    return pois(edges).select("edge_id", start.alias("start_ns"), end.alias("end_ns"))


@edge_query(f", {MARKED}, a AS (SELECT edge_id AS alert, timestamp_ns // {HOUR} AS h, relation, CASE WHEN relation = 'EVENT_READ' THEN dst_semantic ELSE src_semantic END AS a, CASE WHEN relation = 'EVENT_READ' THEN src_semantic ELSE dst_semantic END AS b FROM p), m AS (SELECT alert, count(e.edge_id) AS n FROM a LEFT JOIN edges e ON e.timestamp_ns // {HOUR} = h AND e.relation = a.relation AND ((e.src_semantic = a AND e.dst_semantic = b) OR (e.relation = 'EVENT_READ' AND e.src_semantic = b AND e.dst_semantic = a)) GROUP BY ALL) SELECT alert, n AS matches, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict FROM m")
def alert_matches(edges: DataFrame) -> DataFrame:
    """Alerts matched with events by time (here the hour) and relation and by their ends' meaning, swapped for reads."""
    reads = F.col("relation") == "EVENT_READ"
    hour = F.expr(f"timestamp_ns div {HOUR}").alias("h")
    alerts = marked(edges).select(F.col("edge_id").alias("alert"), hour, "relation", F.when(reads, F.col("dst_semantic")).otherwise(F.col("src_semantic")).alias("a"), F.when(reads, F.col("src_semantic")).otherwise(F.col("dst_semantic")).alias("b"))
    own = edges.select("edge_id", hour, "relation", "src_semantic", "dst_semantic")
    same = ((F.col("src_semantic") == F.col("a")) & (F.col("dst_semantic") == F.col("b"))) | (reads & (F.col("src_semantic") == F.col("b")) & (F.col("dst_semantic") == F.col("a")))
    n = alerts.join(own, ["h", "relation"]).where(same).groupBy("alert").agg(F.count("*").alias("matches"))
    out = alerts.select("alert").join(n, "alert", "left").select("alert", F.coalesce("matches", F.lit(0)).alias("matches"))
    return out.withColumn("verdict", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "unique").otherwise("ambiguous"))


@edge_query(f", {MARKED}, r AS (SELECT edge_id AS ref, host, day, src_semantic, timestamp_ns + {HOUR} AS t FROM p), m AS (SELECT ref, count(DISTINCT e.src) AS actors, min(e.src) AS actor FROM r JOIN edges e ON e.host = r.host AND e.day = r.day AND e.src_semantic = r.src_semantic AND abs(e.timestamp_ns - t) <= {4 * HOUR} GROUP BY ALL) SELECT ref, actor FROM m WHERE actors = 1")
def reference_actors(edges: DataFrame) -> DataFrame:
    """References by host, date and program near a time, where just one actor fits: no other acts between the first event of the time and the last.

    Each reference meets the last event before its end and the event at which that one's actor took over, so no pairs are made.
    """
    key, near = ["host", "day", "src_semantic"], 4 * HOUR
    events = edges.select(*key, F.col("timestamp_ns").alias("t"), F.lit(1).alias("kind"), F.col("edge_id").alias("id"), "src")
    ends = marked(edges).select(*key, (F.col("timestamp_ns") + HOUR + near).alias("t"), F.lit(2).alias("kind"), F.col("edge_id").alias("id"), F.lit(None).cast("string").alias("src"))
    last = O.running_max(events.unionByName(ends), key, ["t", "kind", "id"], F.when(F.col("kind") == 1, F.struct("t", "id", "src")), "last")
    takes_over = (F.col("kind") == 1) & (F.col("last").isNull() | (F.col("last.src") != F.col("src")))
    found = O.running_max(last, key, ["t", "kind", "id"], F.when(takes_over, F.struct("t", "id", "src", F.col("last.t").alias("before"))), "start").where("kind = 2")
    since = F.col("t") - 2 * near
    alone = (F.col("start.t") < since) | F.col("start.before").isNull() | (F.col("start.before") < since)
    return found.where((F.col("last.t") >= since) & alone).select(F.col("id").alias("ref"), F.col("start.src").alias("actor"))


@edge_query(f" SELECT edge_id, CASE WHEN edge_id % {STEP} = 1 THEN 'no_decision' WHEN edge_id % {STEP} = 2 THEN 'differs' ELSE 'no_candidate' END AS fault FROM (SELECT edge_id FROM edges WHERE edge_id % {STEP} IN (1, 2) UNION ALL SELECT edge_id + 3000000000 - (edge_id + 3000000000) % {STEP} + 3 FROM edges WHERE edge_id % {STEP} = 4)")
def identity_check(edges: DataFrame) -> DataFrame:
    """Candidates and decisions that are not one to one, or differ in a field: the planted ones."""
    k = F.col("edge_id") % STEP
    decisions = edges.where(k != 1).select("edge_id", F.when(k == 2, F.lit("other")).otherwise(F.col("src")).alias("d_src"), F.col("dst").alias("d_dst"))
    extra = F.col("edge_id") + F.lit(3_000_000_000)
    decisions = decisions.union(edges.where(k == 4).select(extra - extra % STEP + 3, "src", "dst"))
    both = edges.select("edge_id", "src", "dst", F.lit(True).alias("c")).join(decisions.withColumn("d", F.lit(True)), "edge_id", "full")
    fault = F.when(F.col("d").isNull(), "no_decision").when(F.col("c").isNull(), "no_candidate").when((F.col("src") != F.col("d_src")) | (F.col("dst") != F.col("d_dst")), "differs")
    return both.select("edge_id", fault.alias("fault")).where("fault is not null")


@edge_query(f", {POIS}, l AS (SELECT edge_id, timestamp_ns, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER (ORDER BY timestamp_ns, edge_id) <= {DAY} THEN 0 ELSE 1 END AS n FROM pois) SELECT edge_id, CAST(sum(n) OVER (ORDER BY timestamp_ns, edge_id) AS BIGINT) AS episode FROM l")
def poi_episodes(edges: DataFrame) -> DataFrame:
    """Points of interest in episodes without long gaps; people declare them, so they are few."""
    own = pois(edges).withColumn("all", F.lit(0))
    return S.gap_groups(own, ["all"], DAY).select("edge_id", F.col("group").cast("long").alias("episode"))


@edge_query(f""", o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, edge_id, timestamp_ns, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY timestamp_ns, edge_id) AS k FROM edges),
r AS (SELECT a, b, edge_id, k, timestamp_ns AS start FROM o WHERE k = 1 UNION ALL SELECT o.a, o.b, o.edge_id, o.k, CASE WHEN o.timestamp_ns - r.start > {5 * DAY} THEN o.timestamp_ns ELSE r.start END FROM r JOIN o ON o.a = r.a AND o.b = r.b AND o.k = r.k + 1) SELECT a, b, edge_id, start FROM r""")
def interaction_groups(edges: DataFrame) -> DataFrame:
    """Bounded episodes of pairs of nodes, whatever the direction."""
    return S.bounded_episodes(edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")), ["a", "b"], 5 * DAY)


def folder(edges: DataFrame, name: str) -> str:
    G.cut(edges.limit(0))  # sets the checkpoint folder where the session did not
    return f"{edges.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@edge_query(" SELECT day, host, relation, count(*) AS events FROM edges GROUP BY ALL")
def frequency_snapshot(edges: DataFrame) -> DataFrame:
    """A daily cube that is written with its version and read again; another version is refused."""
    path = folder(edges, "snapshot")
    cube = edges.groupBy("day", "host", "relation").agg(F.count("*").alias("events"))
    cube.write.parquet(f"{path}/cube")
    edges.sparkSession.createDataFrame([("1", cube.count())], "version string, rows long").write.json(f"{path}/manifest")
    return load_snapshot(edges, path)


def load_snapshot(edges: DataFrame, path: str, version: str = "1") -> DataFrame:
    stated = edges.sparkSession.read.schema("version string, rows long").json(f"{path}/manifest").first()
    if stated is None or stated.version != version:
        raise ValueError(f"the snapshot at {path} has version {stated and stated.version}, not {version}")
    return edges.sparkSession.read.parquet(f"{path}/cube")


@edge_query(f""", {POIS}, f0 AS (SELECT src AS node FROM pois UNION SELECT dst FROM pois), t AS (SELECT max(timestamp_ns) - {5 * DAY} AS t FROM edges), e1 AS (SELECT DISTINCT e.* FROM edges e, t WHERE e.timestamp_ns <= t AND (src IN (SELECT node FROM f0) OR dst IN (SELECT node FROM f0))),
f1 AS (SELECT src AS node FROM e1 UNION SELECT dst FROM e1 EXCEPT SELECT node FROM f0), e2 AS (SELECT DISTINCT e.* FROM edges e, t WHERE e.timestamp_ns <= t AND (src IN (SELECT node FROM f1) OR dst IN (SELECT node FROM f1))) SELECT edge_id FROM e1 UNION SELECT edge_id FROM e2""")
def archive_history(edges: DataFrame) -> DataFrame:
    """Events of two hops around the points of interest and before a time, from an archive that is partitioned by day."""
    path = folder(edges, "archive")
    edges.write.partitionBy("day").parquet(path)
    archive = edges.sparkSession.read.parquet(path)
    before = edges.agg(F.max("timestamp_ns")).first()[0] - 5 * DAY
    own = archive.where((F.col("day") <= before // DAY) & (F.col("timestamp_ns") <= before)).select("edge_id", "src", "dst")  # days after it are not read
    front = known = G.cut(pois(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    found = None
    for _ in range(2):
        near = lambda end: own.join(front.withColumnRenamed("node", end), end, "left_semi").select("edge_id", "src", "dst")  # noqa: B023, E731
        hop = G.cut(near("src").union(near("dst")).distinct())
        found = hop.select("edge_id") if found is None else found.union(hop.select("edge_id"))
        front = G.cut(hop.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node", "left_anti"))
        known = known.union(front)
    return found.distinct()


@edge_query(", t AS (SELECT edge_id, CASE edge_id % 5 WHEN 0 THEN '=sum(a)' WHEN 1 THEN ' +1' WHEN 2 THEN '-x' WHEN 3 THEN '@y' ELSE dst_semantic END AS label FROM edges) SELECT edge_id, CASE WHEN regexp_matches(ltrim(label), '^[=+@-]') THEN '''' || label ELSE label END AS label FROM t")
def csv_export(edges: DataFrame) -> DataFrame:
    """Labels that a spreadsheet would take for formulas, written to CSV behind a guard and read again."""
    label = F.expr("case edge_id % 5 when 0 then '=sum(a)' when 1 then ' +1' when 2 then '-x' when 3 then '@y' else dst_semantic end")
    path = folder(edges, "export")
    edges.select("edge_id", E.csv_safe(label).alias("label")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return edges.sparkSession.read.schema("edge_id long, label string").csv(path, header=True)


@edge_query(f""", {RARITY}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, edge_id, rarity, timestamp_ns, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY timestamp_ns, edge_id) AS k FROM rarity),
r AS (SELECT a, b, edge_id, k, timestamp_ns AS start FROM o WHERE k = 1 UNION ALL SELECT o.a, o.b, o.edge_id, o.k, CASE WHEN o.timestamp_ns - r.start > {5 * DAY} THEN o.timestamp_ns ELSE r.start END FROM r JOIN o ON o.a = r.a AND o.b = r.b AND o.k = r.k + 1),
base AS (SELECT edge_id FROM rarity ORDER BY rarity DESC, edge_id LIMIT 100), grp AS (SELECT DISTINCT a, b, start FROM r WHERE edge_id IN (SELECT edge_id FROM base)),
sib AS (SELECT edge_id, rarity FROM r JOIN grp USING (a, b, start) JOIN rarity USING (edge_id) WHERE edge_id NOT IN (SELECT edge_id FROM base) ORDER BY rarity DESC, edge_id LIMIT 150) SELECT edge_id, true AS anchor FROM base UNION ALL SELECT edge_id, false FROM sib""")
def sibling_pool(edges: DataFrame) -> DataFrame:
    """The hundred rarest events and at most 150 others of their interaction groups, the rarest first."""
    rated = G.cut(rounded_rarity(edges))
    groups = G.cut(interaction_groups(rated))
    base = G.cut(rated.orderBy(F.desc("rarity"), "edge_id").limit(100).select("edge_id"))
    own = groups.join(base, "edge_id", "left_semi").select("a", "b", "start").distinct()
    near = groups.join(own, ["a", "b", "start"], "left_semi").join(base, "edge_id", "left_anti").select("edge_id").join(rated.select("edge_id", "rarity"), "edge_id")
    return base.select("edge_id", F.lit(True).alias("anchor")).union(near.orderBy(F.desc("rarity"), "edge_id").limit(150).select("edge_id", F.lit(False)))
