"""Queries: traces written in their formats from the event table, read by the sources, ingested, joined and streamed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import store
from trailgrain.operators.graph import cut
from trailgrain.plans.pages import folder
from trailgrain.plans.registry import edge_query
from trailgrain.sources import avro, cdm, ecar, sysdig
from trailgrain.streaming.arrivals import Arrivals


LINES_A_FILE = 50_000  # a file that is gzipped is one task's work


def reads() -> Column:
    return F.col("relation") == "EVENT_READ"


def written_lines(lines: DataFrame, name: str) -> str:
    path = folder(lines, name)
    lines.write.option("maxRecordsPerFile", LINES_A_FILE).text(path, compression="gzip")
    return path


def cdm_lines(edges: DataFrame) -> DataFrame:
    """The events and nodes as CDM records; every thirtieth event has no size of its own but one in its properties, and some lines are broken."""
    ref = lambda c: F.struct(c.alias("com.bbn.UUID"))
    subject, obj = F.when(reads(), F.col("dst")).otherwise(F.col("src")), F.when(reads(), F.col("src")).otherwise(F.col("dst"))
    inner = F.col("edge_id") % 30 == 0
    event = F.struct(
        F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("uuid"), F.col("relation").alias("type"), ref(subject).alias("subject"), ref(obj).alias("predicateObject"), F.col("timestamp_ns").alias("timestampNanos"),
        F.when(~inner & F.col("data_size").isNotNull(), F.struct(F.col("data_size").alias("long"))).alias("size"), F.col("host").alias("hostId"),
        F.when(inner & F.col("data_size").isNotNull(), F.struct(F.struct(F.col("data_size").cast("string").alias("bytesRead")).alias("map"))).alias("properties"),
    )
    events = edges.select(F.to_json(F.struct(F.struct(event.alias("com.bbn.tc.schema.Event")).alias("datum"))).alias("value"))
    ends = edges.select(F.col("src").alias("u"), F.col("src_type").alias("t"), "host").union(edges.select("dst", "dst_type", "host")).groupBy("u", "t").agg(F.min("host").alias("host"))
    n = F.substring("u", 2, 20)
    record = lambda kind, *fields: F.to_json(F.struct(F.struct(F.struct(F.col("u").alias("uuid"), F.col("host").alias("hostId"), *fields).alias(f"x.{kind}")).alias("datum")))
    node = (
        F.when(F.col("t") == "process", record("Subject", F.struct(F.concat(F.lit("app"), n).alias("string")).alias("cmdLine")))
        .when(F.col("t") == "file", record("FileObject", F.struct(F.struct(F.struct(F.concat(F.lit("/home/u"), n, F.lit("/doc"), n).alias("path")).alias("map")).alias("properties")).alias("baseObject")))
        .otherwise(record("NetFlowObject", F.concat(F.lit("10.0.0."), n).alias("remoteAddress"), F.lit(443).alias("remotePort")))
    )
    broken = edges.where("edge_id % 50 = 0").select(F.lit("{broken").alias("value"))
    return events.union(ends.select(node.alias("value"))).union(broken)


def cdm_records(edges: DataFrame) -> DataFrame:
    return cdm.records(cdm.read_lines(edges.sparkSession, written_lines(cdm_lines(edges), "cdm")))


@edge_query(" SELECT 'e' || edge_id AS event_id, src, dst, relation, timestamp_ns, host, data_size FROM edges")
def cdm_edges(edges: DataFrame) -> DataFrame:
    return cdm.edges(cdm_records(edges))


AVRO = {
    "type": "record", "name": "Datum", "namespace": "com.bbn.tc.schema", "fields": [{"name": "datum", "type": [
        {"type": "record", "name": "Event", "fields": [
            {"name": "uuid", "type": "string"}, {"name": "type", "type": "string"}, {"name": "subject", "type": "string"}, {"name": "predicateObject", "type": "string"},
            {"name": "timestampNanos", "type": "long"}, {"name": "size", "type": ["null", "long"]}, {"name": "hostId", "type": "string"},
        ]},
        {"type": "record", "name": "Subject", "fields": [{"name": "uuid", "type": "string"}, {"name": "hostId", "type": "string"}, {"name": "cmdLine", "type": ["null", "string"]}]},
    ]}],
}


@edge_query(" SELECT 'e' || edge_id AS event_id, src, dst, relation, timestamp_ns, host, data_size FROM edges")
def avro_edges(edges: DataFrame) -> DataFrame:
    """The events and their processes as CDM records in Avro containers, read in splits of 100,000 bytes."""
    subject, obj = F.when(reads(), F.col("dst")).otherwise(F.col("src")), F.when(reads(), F.col("src")).otherwise(F.col("dst"))
    event = F.struct(
        F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("uuid"), F.col("relation").alias("type"), subject.alias("subject"), obj.alias("predicateObject"),
        F.col("timestamp_ns").alias("timestampNanos"), F.col("data_size").alias("size"), F.col("host").alias("hostId"),
    )
    process = edges.where("src_type = 'process'").select(F.col("src").alias("uuid"), F.lit("h").alias("hostId"), F.concat(F.lit("run "), "src").alias("cmdLine")).distinct()
    line = lambda kind, body: F.to_json(F.struct(F.struct(body.alias(f"com.bbn.tc.schema.{kind}")).alias("datum"))).alias("value")
    lines = edges.select(line("Event", event)).union(process.select(line("Subject", F.struct("uuid", "hostId", "cmdLine"))))
    path = folder(edges, "avro")
    avro.write_avro(lines, path, json.dumps(AVRO))
    return cdm.edges(cdm.records(avro.read_avro(edges.sparkSession, path, split_bytes=100_000)))


CDM_NODES = """n AS (SELECT uuid, node_type, substr(uuid, 2) AS k FROM nodes),
cdm AS (SELECT uuid, node_type, CASE node_type WHEN 'process' THEN 'app' || k WHEN 'file' THEN '/home/u' || k || '/doc' || k ELSE '10.0.0.' || k || ':443' END AS label, CASE node_type WHEN 'process' THEN 'process:app' || k WHEN 'file' THEN 'file:/home/*/doc' || k ELSE 'socket:10.0.0.' || k || ':443' END AS semantic_key FROM n)"""


@edge_query(f", {CDM_NODES} SELECT * FROM cdm")
def cdm_nodes(edges: DataFrame) -> DataFrame:
    return cdm.nodes(cdm_records(edges)).select("uuid", "node_type", "label", "semantic_key")


@edge_query(" SELECT (SELECT count(*) FROM edges) + (SELECT count(*) FROM nodes) AS records, (SELECT count(*) FROM edges WHERE edge_id % 50 = 0) AS malformed")
def cdm_malformed(edges: DataFrame) -> DataFrame:
    lines = cdm.read_lines(edges.sparkSession, written_lines(cdm_lines(edges), "cdm"))
    return cdm.malformed(lines).agg(F.sum("records").alias("records"), F.sum("malformed").alias("malformed"))


@edge_query(f", {CDM_NODES}, d AS (SELECT * FROM cdm WHERE CAST(substr(uuid, 2) AS BIGINT) % 3 <> 0 OR node_type = 'process') SELECT 'e' || edge_id AS event_id, src, dst, coalesce(a.node_type, 'unknown') AS src_type, coalesce(a.semantic_key, src) AS src_semantic, coalesce(b.node_type, 'unknown') AS dst_type, coalesce(b.semantic_key, dst) AS dst_semantic FROM edges LEFT JOIN d a ON a.uuid = src LEFT JOIN d b ON b.uuid = dst")
def ingested_edges(edges: DataFrame) -> DataFrame:
    """Records ingested: nodes of which a third is not declared, events that come twice; the wide view over them.

    Lines are parsed once; what several steps need is cut, as each would parse them again.
    """
    recs = cut(cdm_records(edges))
    nodes = cdm.nodes(recs).where("cast(substr(uuid, 2) as bigint) % 3 <> 0 or node_type = 'process'")
    own = cut(cdm.edges(recs))
    once = cut(store.deduplicated(own.union(own)))
    whole = cut(store.with_placeholders(cut(store.upserted(nodes.withColumn("n", F.lit(1)), "n")), once))
    return store.wide(once, whole).select("event_id", "src", "dst", "src_type", "src_semantic", "dst_type", "dst_semantic")


def sysdig_lines(edges: DataFrame) -> DataFrame:
    """Each event as an entry and an exit line of its actor's thread; every tenth call fails."""
    actor = F.substring(F.when(reads(), F.col("dst")).otherwise(F.col("src")), 2, 20)
    other = F.substring(F.when(reads(), F.col("src")).otherwise(F.col("dst")), 2, 20)
    call = F.expr("case relation when 'EVENT_READ' then 'read' when 'EVENT_WRITE' then 'pwrite' when 'EVENT_SENDTO' then 'sendto' when 'EVENT_EXECUTE' then 'execve' else 'clone' end")
    about = F.expr("case when relation in ('EVENT_READ', 'EVENT_WRITE') then concat('fd=3(<f>/srv/f', o, ') size=1') when relation = 'EVENT_SENDTO' then concat('fd=4(<4t>1.1.1.1:1->10.0.0.', o, ':443)') else '' end")
    failed = F.col("edge_id") % 10 == 0
    result = F.when(failed, F.lit("-1")).when(F.col("relation") == "EVENT_FORK", F.concat(F.lit("9"), "o")).otherwise(F.coalesce("data_size", F.lit(0)).cast("string"))
    more = F.when(F.col("relation") == "EVENT_EXECUTE", F.concat(F.lit(" exe=bin/f"), "o", F.lit(" cwd=/opt"))).otherwise("")
    rows = edges.withColumn("a", actor).withColumn("o", other).withColumn("call", call).withColumn("about", about)
    line = lambda number, sign, details: F.concat_ws(" ", number.cast("string"), F.concat(F.expr("timestamp_ns div 1000000000").cast("string"), F.lit("."), F.lpad(F.expr("timestamp_ns % 1000000000").cast("string"), 9, "0")), F.lit("0 1 my app"), F.concat(F.lit("("), "a", F.lit(")")), F.lit(sign), "call", details)
    both = rows.select(F.explode(F.array(line(2 * F.col("edge_id"), ">", F.col("about")), line(2 * F.col("edge_id") + 1, "<", F.concat(F.lit("res="), result, more)))).alias("value"))
    return both.union(edges.where("edge_id % 70 = 0").select(F.lit("noise").alias("value")))


def sysdig_trace(edges: DataFrame) -> DataFrame:
    return sysdig.sysdig_events(sysdig.read_sysdig(edges.sparkSession, written_lines(sysdig_lines(edges), "sysdig")), "h")


SYSDIG = """sys AS (SELECT 'sysdig:' || (2 * edge_id + 1) AS event_id, relation, timestamp_ns, CASE WHEN relation IN ('EVENT_READ', 'EVENT_WRITE', 'EVENT_SENDTO') THEN data_size END AS data_size,
CASE relation WHEN 'EVENT_READ' THEN '/srv/f' || substr(src, 2) WHEN 'EVENT_WRITE' THEN '/srv/f' || substr(dst, 2) WHEN 'EVENT_EXECUTE' THEN '/opt/bin/f' || substr(dst, 2) WHEN 'EVENT_SENDTO' THEN '1.1.1.1:1->10.0.0.' || substr(dst, 2) || ':443' ELSE '9' || substr(dst, 2) END AS label, relation = 'EVENT_READ' AS inward FROM edges WHERE edge_id % 10 <> 0)"""


@edge_query(f", {SYSDIG} SELECT event_id, relation, timestamp_ns, data_size, CASE WHEN inward THEN label ELSE 'my app' END AS src_label, CASE WHEN inward THEN 'my app' ELSE label END AS dst_label FROM sys")
def sysdig_events(edges: DataFrame) -> DataFrame:
    return sysdig_trace(edges).select("event_id", "relation", "timestamp_ns", "data_size", "src_label", "dst_label")


@edge_query(f", {SYSDIG} SELECT event_id FROM sys WHERE relation = 'EVENT_WRITE' AND label = '/srv/f7' ORDER BY timestamp_ns DESC, event_id DESC LIMIT 1")
def latest_write(edges: DataFrame) -> DataFrame:
    """The latest write of a path, as no write has the size that is asked for."""
    return sysdig.latest_write(sysdig_trace(edges), "/srv/f7", -5).select("event_id")


@edge_query(""", c AS (SELECT edge_id, src, dst, host, timestamp_ns FROM edges WHERE relation = 'EVENT_WRITE' AND host = 'h1') SELECT CAST(edge_id AS VARCHAR) AS id, src AS source, dst AS target, timestamp_ns - timestamp_ns % 1000 AS timestamp_ns FROM c""")
def ecar_corpus(edges: DataFrame) -> DataFrame:
    """File writes as eCAR records, each twice, and one host of them as a corpus."""
    stamp = F.date_format(F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    record = F.struct(
        F.col("edge_id").cast("string").alias("id"), F.col("src").alias("actorID"), F.col("dst").alias("objectID"), F.col("host").alias("hostname"), F.lit(1).alias("pid"), F.lit("FILE").alias("object"), F.lit("WRITE").alias("action"),
        stamp.alias("timestamp"), F.struct(F.col("dst_semantic").alias("file_path"), F.lit("app.exe").alias("image_path")).alias("properties"),
    )
    lines = edges.where("relation = 'EVENT_WRITE'").select(F.to_json(record).alias("value"))
    read = ecar.ecar_edges(ecar.read_ecar(edges.sparkSession, written_lines(lines.union(lines), "ecar")))
    return ecar.corpus(read, "h1", 1 << 62).select("id", "source", "target", "timestamp_ns")


@edge_query(""", s AS (SELECT edge_id AS seq, timestamp_ns, row_number() OVER (ORDER BY edge_id) - 1 AS n, count(*) OVER (PARTITION BY src_type, relation, dst_type ORDER BY edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
max(timestamp_ns) OVER (ORDER BY edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM edges) SELECT seq, round(ln((n + 2) / (c + 1)) / ln(n + 2), 6) AS rarity, coalesce(timestamp_ns < latest, false) AS late FROM s""")
def streamed_rarity(edges: DataFrame) -> DataFrame:
    """The events as a stream of three micro-batches: rarity by the counts before each one, and whether it is late."""
    path = folder(edges, "stream")
    rows = edges.select(F.col("edge_id").alias("seq"), F.concat(F.lit("e"), F.col("edge_id").cast("string")).alias("event_id"), "src_type", "relation", "dst_type", "timestamp_ns")
    bounds = rows.agg(F.min("seq"), F.max("seq")).first()
    step = (bounds[1] - bounds[0]) // 3 + 1
    for k in range(3):
        rows.where(F.expr(f"(seq - {bounds[0]}) div {step} = {k}")).coalesce(1).write.parquet(f"{path}/in/{k}")
    stream = edges.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    arrivals = Arrivals(edges.sparkSession, f"{path}/state", window=1 << 30)
    arrivals.run(stream, f"{path}/checkpoint").awaitTermination()
    return arrivals.scored().select("seq", F.round("rarity", 6).alias("rarity"), "late")
