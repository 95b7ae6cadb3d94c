"""Queries: semantic continuations of points of interest, components, closures and ledger checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import continuation as C
from trailgrain.operators import graph as G
from trailgrain.operators import ordered as O
from trailgrain.operators import paths as P
from trailgrain.plans.ranking import SCORED, tied
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import HOUR

DAY = 24 * HOUR
STEP = 97
MARKED = f"p AS (SELECT *, regexp_extract(dst_semantic, '([^/]*)$', 1) AS name FROM edges WHERE edge_id % {STEP} = 0)"


def marked(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_id") % STEP == 0)


def _ranked(inner: str, n: int, order: str = "e.timestamp_ns, e.edge_id") -> str:
    return f"SELECT edge_id FROM (SELECT e.edge_id, row_number() OVER (PARTITION BY p.edge_id ORDER BY {order}) AS k {inner}) WHERE k <= {n}"


@edge_query(f", {MARKED} SELECT DISTINCT edge_id FROM (" + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_EXECUTE' AND regexp_extract(e.dst_semantic, '([^/]*)$', 1) = p.name AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {2 * DAY} WHERE p.relation = 'EVENT_WRITE'", 1) + ")")
def executed_after_write(edges: DataFrame) -> DataFrame:
    return C.executed_after_write(edges, marked(edges), 2 * DAY)


@edge_query(f", {MARKED} SELECT DISTINCT e.edge_id FROM p JOIN edges e ON e.relation = 'EVENT_WRITE' AND e.dst = p.dst AND e.edge_id % {STEP} <> 0 AND abs(e.timestamp_ns - p.timestamp_ns) <= {DAY} WHERE p.relation = 'EVENT_WRITE'")
def adjacent_writes(edges: DataFrame) -> DataFrame:
    return C.adjacent_writes(edges, marked(edges), DAY)


@edge_query(f", {MARKED} SELECT DISTINCT edge_id FROM (" + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_WRITE' AND e.dst <> p.dst AND regexp_extract(e.dst_semantic, '([^/]*)$', 1) = p.name AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns - {DAY} AND p.timestamp_ns WHERE p.relation = 'EVENT_WRITE'", 2, "e.timestamp_ns DESC, e.edge_id")
            + " UNION ALL " + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_READ' AND regexp_extract(e.src_semantic, '([^/]*)$', 1) = p.name AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {DAY} WHERE p.relation = 'EVENT_WRITE'", 16) + ")")
def named_file_context(edges: DataFrame) -> DataFrame:
    return C.named_file_context(edges, marked(edges), DAY)


@edge_query(f""", {MARKED}, par AS (SELECT * FROM (SELECT p.edge_id AS poi, e.src AS process, e.edge_id AS fork, row_number() OVER (PARTITION BY p.edge_id ORDER BY e.timestamp_ns DESC, e.edge_id DESC) AS k
  FROM p JOIN edges e ON e.relation = 'EVENT_FORK' AND e.dst = p.src AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns - {10 * DAY} AND p.timestamp_ns WHERE p.relation = 'EVENT_WRITE') WHERE k = 1),
act AS (SELECT edge_id AS poi, src AS process FROM p WHERE relation = 'EVENT_WRITE' UNION SELECT poi, process FROM par),
con AS (SELECT act.poi, e.*, p.timestamp_ns AS pt FROM act JOIN p ON p.edge_id = act.poi JOIN edges e ON e.relation = 'EVENT_SENDTO' AND e.src = act.process AND e.host = p.host),
lat AS (SELECT * FROM con c WHERE timestamp_ns > pt AND timestamp_ns <= pt + {5 * DAY} AND NOT EXISTS (SELECT 1 FROM con u WHERE u.poi = c.poi AND u.dst = c.dst AND u.timestamp_ns >= u.pt - {10 * DAY} AND u.timestamp_ns < u.pt)),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY timestamp_ns, edge_id) AS k FROM lat) WHERE k = 1)
SELECT edge_id FROM fst UNION SELECT fork FROM fst JOIN par ON par.poi = fst.poi AND par.process = fst.src""")
def new_socket_after_write(edges: DataFrame) -> DataFrame:
    return C.new_socket_after_write(edges, marked(edges), 10 * DAY, 5 * DAY, "EVENT_SENDTO")


@edge_query(f", {MARKED} SELECT DISTINCT edge_id FROM (" + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_FORK' AND e.src = p.src AND e.dst_semantic IN ('process:app1', 'process:app2', 'process:app3') AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {5 * DAY}", 1) + ")")
def program_after(edges: DataFrame) -> DataFrame:
    return C.program_after(edges, marked(edges), ["app1", "app2", "app3"], 5 * DAY)


@edge_query(f", {MARKED} SELECT DISTINCT edge_id FROM (" + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_SENDTO' AND e.src = p.src AND e.edge_id <> p.edge_id AND e.timestamp_ns BETWEEN p.timestamp_ns - {5 * DAY} AND p.timestamp_ns WHERE p.relation = 'EVENT_SENDTO'", 8, "e.timestamp_ns DESC, e.edge_id DESC")
            + " UNION ALL " + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_SENDTO' AND e.dst = p.dst AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {DAY} WHERE p.relation = 'EVENT_SENDTO'", 1) + ")")
def network_episode(edges: DataFrame) -> DataFrame:
    return C.network_episode(edges, marked(edges), 5 * DAY, DAY, "EVENT_SENDTO")


@edge_query(f""", {MARKED}, t AS (SELECT src AS a, dst AS b FROM p UNION SELECT dst, src FROM p), k AS (SELECT a AS node, a AS label FROM t UNION SELECT t.b, k.label FROM k JOIN t ON t.a = k.node) SELECT node, min(label) AS component FROM k GROUP BY ALL""")
def truth_components(edges: DataFrame) -> DataFrame:
    """Weakly connected components of labelled events."""
    return G.components(marked(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@edge_query(f""", {MARKED}, nxt AS (SELECT e.edge_id, min(struct_pack(t := f.timestamp_ns, id := f.edge_id)) AS n FROM edges e JOIN edges f ON f.src = e.dst AND f.timestamp_ns > e.timestamp_ns GROUP BY ALL),
k AS (SELECT edge_id FROM p UNION SELECT n.id FROM k JOIN nxt USING (edge_id)) SELECT edge_id FROM k""")
def witness_closure(edges: DataFrame) -> DataFrame:
    """Points of interest with their chains of next events: each event points to the first one that leaves its target later."""
    return G.followed(marked(edges).select("edge_id"), P.next_events(edges))


@edge_query(f", {SCORED}, r AS (SELECT relation, edge_id, rarity, row_number() OVER (PARTITION BY relation ORDER BY rarity DESC, edge_id) AS rank, count(*) OVER (PARTITION BY relation) AS n FROM scored) SELECT relation, edge_id, rank, round(CASE WHEN n = 1 THEN 0 ELSE (n - rank) / (n - 1) END, 6) AS percentile FROM r")
def ledger_ranks(edges: DataFrame) -> DataFrame:
    """Rank and percentile as a score ledger holds them; a single row has percentile 0."""
    scored = tied(edges).select("relation", "edge_id", "rarity")
    n = scored.groupBy("relation").agg(F.count("*").alias("n"))
    placed = O.ranked(scored, ["relation"], [F.desc("rarity"), "edge_id"], "rank").join(n, "relation")
    return placed.select("relation", "edge_id", "rank", F.round(F.when(F.col("n") == 1, 0.0).otherwise((F.col("n") - F.col("rank")) / (F.col("n") - 1)), 6).alias("percentile"))


RUN = f"""{MARKED}, pw AS (SELECT * FROM p WHERE relation = 'EVENT_WRITE'),
kid AS (SELECT DISTINCT p.edge_id AS poi, f.dst AS child FROM pw p JOIN edges f ON f.relation = 'EVENT_FORK' AND f.src = p.src AND f.host = p.host AND f.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {20 * DAY}),
cand AS (SELECT p.edge_id AS poi, p.src AS p_src, p.dst AS p_dst, p.timestamp_ns AS pt, p.host AS ph, e.edge_id, e.src, e.timestamp_ns FROM pw p JOIN kid ON kid.poi = p.edge_id
  JOIN edges e ON e.relation = 'EVENT_EXECUTE' AND e.src = kid.child AND e.host = p.host AND regexp_extract(e.dst_semantic, '([^/]*)$', 1) = p.name AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {20 * DAY}),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY timestamp_ns, edge_id) AS k FROM cand) WHERE k = 1),
led AS (SELECT edge_id FROM (SELECT f.edge_id, row_number() OVER (PARTITION BY poi ORDER BY f.timestamp_ns DESC, f.edge_id DESC) AS k FROM run JOIN edges f ON f.relation = 'EVENT_FORK' AND f.dst = run.src AND f.host = ph AND f.timestamp_ns BETWEEN pt AND run.timestamp_ns) WHERE k <= 3),
wr AS (SELECT poi, e.edge_id, e.timestamp_ns, row_number() OVER (PARTITION BY poi, e.dst ORDER BY e.timestamp_ns DESC, e.edge_id) AS k FROM run JOIN edges e ON e.relation = 'EVENT_WRITE' AND e.src = p_src AND e.dst <> p_dst AND e.host = ph AND e.timestamp_ns BETWEEN pt - {10 * DAY} AND pt),
net AS (SELECT poi, e.edge_id, e.timestamp_ns, row_number() OVER (PARTITION BY poi, regexp_extract(e.dst_semantic, '^socket:([0-9]+[.][0-9]+[.][0-9]+)', 1) ORDER BY e.timestamp_ns, e.edge_id) AS k, e.dst_semantic FROM run JOIN edges e ON e.relation = 'EVENT_SENDTO' AND e.src = run.src AND e.host = ph AND e.timestamp_ns BETWEEN run.timestamp_ns AND pt + {30 * DAY})"""


@edge_query(f""", {RUN} SELECT edge_id FROM run UNION SELECT edge_id FROM led
UNION SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY poi ORDER BY timestamp_ns DESC, edge_id) AS k FROM wr WHERE k = 1) WHERE k = 1
UNION SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY poi ORDER BY timestamp_ns, edge_id) AS k FROM net WHERE k = 1) WHERE k <= 3""")
def forward_execution(edges: DataFrame) -> DataFrame:
    return C.forward_execution(edges, marked(edges), 20 * DAY, 30 * DAY, 10 * DAY, "EVENT_SENDTO")


@edge_query(f""", {MARKED}, pw AS (SELECT * FROM p WHERE relation = 'EVENT_WRITE'),
par AS (SELECT * FROM (SELECT p.edge_id AS poi, f.src AS process, f.edge_id AS fork, row_number() OVER (PARTITION BY p.edge_id ORDER BY f.timestamp_ns DESC, f.edge_id DESC) AS k FROM pw p JOIN edges f ON f.relation = 'EVENT_FORK' AND f.dst = p.src AND f.host = p.host AND f.timestamp_ns BETWEEN p.timestamp_ns - {10 * DAY} AND p.timestamp_ns) WHERE k = 1),
act AS (SELECT edge_id AS poi, src AS process FROM pw UNION SELECT poi, process FROM par),
got AS (SELECT act.poi, e.src AS sock, e.edge_id, e.timestamp_ns, greatest(0, coalesce(e.data_size, 0)) AS b FROM act JOIN p ON p.edge_id = act.poi JOIN edges e ON e.relation = 'EVENT_READ' AND e.dst = act.process AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns - {10 * DAY} AND p.timestamp_ns + {10 * DAY}),
best AS (SELECT poi, max(struct_pack(b := b, c := c, s := sock)).s AS sock FROM (SELECT poi, sock, sum(b) AS b, count(*) AS c FROM got GROUP BY ALL) GROUP BY ALL),
rd AS (SELECT edge_id, row_number() OVER (PARTITION BY poi ORDER BY b DESC, timestamp_ns, edge_id) AS k FROM got JOIN best USING (poi, sock)),
nr AS (SELECT e.edge_id, row_number() OVER (PARTITION BY act.poi ORDER BY abs(e.timestamp_ns - p.timestamp_ns), e.edge_id) AS k FROM act JOIN best ON best.poi = act.poi JOIN p ON p.edge_id = act.poi JOIN edges e ON e.relation = 'EVENT_WRITE' AND e.src = act.process AND e.dst = best.sock AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns - {10 * DAY} AND p.timestamp_ns + {10 * DAY})
SELECT edge_id FROM rd WHERE k <= 3 UNION SELECT fork FROM par JOIN best USING (poi) UNION SELECT edge_id FROM nr WHERE k = 1""")
def dominant_origin(edges: DataFrame) -> DataFrame:
    """The rule for the socket that gave a writer most bytes, here for files, which the table's reads come from."""
    as_sockets = edges.withColumn("src_type", F.when(F.col("relation") == "EVENT_READ", "socket").otherwise(F.col("src_type")))
    return C.socket_origin(as_sockets, marked(edges), 10 * DAY, 10 * DAY, "EVENT_WRITE", most=3)


@edge_query(f""", {MARKED}, c AS (SELECT * FROM p WHERE relation = 'EVENT_SENDTO'), w AS (SELECT * FROM p WHERE relation = 'EVENT_WRITE'),
fk AS (SELECT * FROM (SELECT c.edge_id AS c, f.dst AS process, f.edge_id AS fork, f.timestamp_ns AS ft, row_number() OVER (PARTITION BY c.edge_id, f.dst ORDER BY f.timestamp_ns DESC, f.edge_id DESC) AS k FROM c JOIN edges f ON f.relation = 'EVENT_FORK' AND f.src = c.src AND f.host = c.host AND abs(f.timestamp_ns - c.timestamp_ns) <= {10 * DAY}) WHERE k = 1),
act AS (SELECT edge_id AS c, src AS process, NULL::BIGINT AS ft, true AS own FROM c UNION ALL SELECT c, fk.process, ft, false FROM fk WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.edge_id = fk.c AND x.src = fk.process)),
op AS (SELECT act.c, e.dst AS file, e.edge_id AS open, act.process, abs(e.timestamp_ns - c.timestamp_ns) AS gap FROM act JOIN c ON c.edge_id = act.c JOIN edges e ON e.relation = 'EVENT_EXECUTE' AND e.src = act.process AND e.host = c.host AND abs(e.timestamp_ns - c.timestamp_ns) <= {10 * DAY} AND (own OR ft <= e.timestamp_ns)),
rd AS (SELECT w.edge_id AS w, e.src AS file, e.edge_id AS read, e.timestamp_ns AS rt FROM w JOIN edges e ON e.relation = 'EVENT_READ' AND e.dst = w.src AND e.host = w.host AND e.timestamp_ns BETWEEN w.timestamp_ns - {10 * DAY} AND w.timestamp_ns),
sh AS (SELECT * FROM (SELECT o.c, r.w, o.file, row_number() OVER (PARTITION BY o.c, r.w ORDER BY r.last DESC, o.file) AS k FROM (SELECT DISTINCT c, file FROM op) o JOIN (SELECT w, file, max(rt) AS last FROM rd GROUP BY ALL) r ON r.file = o.file
  JOIN c ON c.edge_id = o.c JOIN w ON w.edge_id = r.w AND w.host = c.host AND w.timestamp_ns BETWEEN c.timestamp_ns AND c.timestamp_ns + {30 * DAY}) WHERE k <= 2),
tk AS (SELECT read, row_number() OVER (PARTITION BY c, w, file ORDER BY rt DESC, read DESC) AS k FROM sh JOIN rd USING (w, file)),
gv AS (SELECT c, process, open, row_number() OVER (PARTITION BY c, w, file ORDER BY gap, open) AS k FROM sh JOIN op USING (c, file))
SELECT read AS edge_id FROM tk WHERE k <= 4 UNION SELECT open FROM gv WHERE k <= 2 UNION SELECT fork FROM gv JOIN fk USING (c, process) WHERE gv.k <= 2""")
def shared_file_bridge(edges: DataFrame) -> DataFrame:
    """Sends stand for connections and executions for opens."""
    return C.shared_file_bridge(edges, marked(edges), 10 * DAY, 30 * DAY, "EVENT_SENDTO", opened="EVENT_EXECUTE")


@edge_query(f", {MARKED} SELECT DISTINCT edge_id FROM (" + _ranked(f"FROM p JOIN edges e ON e.relation = 'EVENT_EXECUTE' AND e.dst_semantic LIKE '%/' || p.name AND e.host = p.host AND e.timestamp_ns BETWEEN p.timestamp_ns AND p.timestamp_ns + {10 * DAY} WHERE p.relation = 'EVENT_WRITE'", 2) + ")")
def command_line_executions(edges: DataFrame) -> DataFrame:
    """Command lines are made from what is executed."""
    runs = edges.where("relation = 'EVENT_EXECUTE'").select("edge_id", "timestamp_ns", "host", F.concat(F.lit("sh -c '"), F.substring("dst_semantic", 6, 1000), F.lit("' -x")).alias("command"))
    return C.command_line_executions(marked(edges), runs, 10 * DAY)


@edge_query(None)
def all_continuations(edges: DataFrame) -> DataFrame:
    """What any rule keeps; sends stand for connections. The shell rule starts from connections that other rules kept too."""
    p = marked(edges)
    rules = [
        executed_after_write(edges), adjacent_writes(edges), network_episode(edges), shared_file_bridge(edges), dominant_origin(edges),
        forward_execution(edges), new_socket_after_write(edges), named_file_context(edges),
    ]
    kept = G.cut(rules[0].union(rules[1]).union(rules[2]).union(rules[3]).union(rules[4]).union(rules[5]).union(rules[6]).union(rules[7]).distinct())
    starts = edges.where("relation = 'EVENT_SENDTO'").join(kept.union(p.select("edge_id")).distinct(), "edge_id", "left_semi")
    return kept.union(C.program_after(edges, starts, ["app1", "app2", "app3"], 5 * DAY)).distinct()
