"""CDM records in JSON lines: node and edge tables, with unions unwrapped and information flow oriented.

Lines are parsed to VARIANT; a record's kind is the last part of the only key of its datum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrain.functions.events import masked_home
from trailgrain.schema import READ_LIKE

# Record kinds and the node types that they declare; fields that are copied to the properties, and labels in order of preference.
NODE_TYPES = {
    "FileObject": "file", "MemoryObject": "memory", "NetFlowObject": "socket", "Principal": "principal", "RegistryKeyObject": "registry",
    "SrcSinkObject": "srcsink", "Subject": "process", "UnnamedPipeObject": "pipe",
}
PROPERTY_FIELDS = ("cmdLine", "path", "filename", "name", "gid", "localAddress", "localPort", "remoteAddress", "remotePort")
LABEL_FIELDS = ("cmdLine", "path", "filename", "url", "name", "localAddress", "remoteAddress")
SIZE_FIELDS = ("size", "bytes", "byteCount", "bytesRead", "bytesWritten")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the parsed record (null where a line is not JSON); .gz files are read as such."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", F.expr("try_parse_json(value)").alias("v"))


def malformed(lines: DataFrame) -> DataFrame:
    """How many lines of each file are records and how many are not."""
    return lines.groupBy("file").agg(F.count("v").alias("records"), F.count_if(F.col("v").isNull()).alias("malformed"))


def scalar(field: str, body: str = "body") -> Column:
    """A field as text: itself, or the value inside a union such as {"string": "x"}. Null for nested values."""
    inner = f"map_values(try_variant_get({body}, '$.{field}', 'map<string,variant>'))[0]"
    return F.expr(f"case when try_variant_get({body}, '$.{field}', 'map<string,variant>') is not null then try_variant_get({inner}, '$', 'string') else try_variant_get({body}, '$.{field}', 'string') end")


def records(lines: DataFrame) -> DataFrame:
    """kind and body of each record that has them: the only entry of the datum, or the datum itself where the record names its type."""
    datum = F.expr("coalesce(try_variant_get(v, '$.datum', 'map<string,variant>'), try_variant_get(v, '$', 'map<string,variant>'))")
    whole = F.expr("coalesce(try_variant_get(v, '$.datum', 'variant'), v)")
    named = F.expr("coalesce(try_variant_get(v, '$.datumType', 'string'), try_variant_get(v, '$.typeName', 'string'))")
    # Filters do not move below the explode, where they would parse each line again for every use of v.
    rows = lines.select(F.explode(F.array(F.struct(datum.alias("datum"), named.alias("named"), whole.alias("whole")))).alias("r")).select("r.*")
    nested = F.expr("size(datum) = 1 and try_variant_get(map_values(datum)[0], '$', 'map<string,variant>') is not null")
    kind = F.when(nested, F.map_keys("datum")[0]).otherwise(F.col("named"))
    body = F.when(nested, F.map_values("datum")[0]).otherwise(F.col("whole"))
    return rows.where(F.expr("size(datum) > 0")).select(F.element_at(F.split(kind, r"\."), -1).alias("kind"), body.alias("body")).where("kind is not null")


def property_maps() -> tuple[Column, Column]:
    """The record's own property map and that of its base object."""
    return tuple(F.coalesce(F.expr(f"try_variant_get(body, '$.{at}properties.map', 'map<string,string>')"), F.expr(f"try_variant_get(body, '$.{at}properties', 'map<string,string>')")) for at in ("", "baseObject."))


def properties(fields: tuple[str, ...] = PROPERTY_FIELDS) -> Column:
    """Merged property map; named fields win over properties of the base object, and those over the record's own map."""
    maps = [*property_maps()]
    if fields:
        maps.append(F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), scalar(f).alias("value")) for f in fields]), lambda e: e.value.isNotNull() & (e.value != ""))))
    empty = F.expr("map()").cast("map<string,string>")
    entries = F.concat(*[F.map_entries(F.coalesce(m, empty)) for m in maps])
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es) + 1), lambda x: x.key == e.key) & (e.value != ""))
    return F.map_from_entries(F.transform(F.array(entries), last)[0])  # bound once; the lambda would evaluate them for each entry


def semantic_key(node_type: Column, label: Column) -> Column:
    label = F.trim(label)
    return F.concat(node_type, F.lit(":"), F.when(node_type == "file", masked_home(label)).otherwise(label))


def nodes(recs: DataFrame) -> DataFrame:
    """Declared nodes in the schema of NODES."""
    kinds = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    found = recs.where(F.col("kind").isin(*NODE_TYPES)).select(
        "kind", "body", scalar("uuid").alias("uuid"), scalar("hostId").alias("host"), kinds[F.col("kind")].alias("node_type"), properties().alias("properties"),
    ).where("uuid <> ''")
    candidates = []
    for f in LABEL_FIELDS:
        value = F.coalesce(F.nullif(scalar(f), F.lit("")), F.nullif(F.col("properties")[f], F.lit("")))
        port = {"localAddress": "localPort", "remoteAddress": "remotePort"}.get(f)
        candidates.append(F.when((F.col("kind") == "NetFlowObject") & value.isNotNull(), F.concat_ws(":", value, F.nullif(scalar(port), F.lit("")))).otherwise(value) if port else value)
    p = F.col("properties")
    address, port = F.coalesce(p["remoteAddress"], p["localAddress"]), F.coalesce(p["remotePort"], p["localPort"])
    labelled = found.withColumn("label", F.coalesce(*candidates, F.col("uuid")))
    key = F.when((F.col("kind") == "NetFlowObject") & address.isNotNull(), F.concat(F.lit("socket:"), F.concat_ws(":", address, port))).otherwise(semantic_key(F.col("node_type"), F.col("label")))
    declared = labelled.select("uuid", "node_type", "label", F.coalesce("host", F.lit("")).alias("host"), key.alias("semantic_key"), "properties")
    return declared.unionByName(mentioned(recs))


def mentioned(recs: DataFrame) -> DataFrame:
    """Nodes that events describe: the subject by the program or command in its properties, and objects by their paths."""
    own, base = property_maps()
    told = own.isNotNull() | base.isNotNull() | (scalar("predicateObjectPath") != "") | (scalar("predicateObject2Path") != "")  # most events describe none
    events = recs.where((F.col("kind") == "Event") & told).select(
        "body", scalar("subject").alias("subject"), F.coalesce(scalar("hostId"), F.lit("")).alias("host"), properties().alias("p"),
        *[scalar(f).alias(f) for f in ("predicateObject", "predicateObject2", "predicateObjectPath", "predicateObject2Path")],
    )
    program = F.coalesce(F.col("p")["exec"], F.col("p")["command"])
    process = F.struct(F.col("subject").alias("uuid"), F.lit("process").alias("node_type"), program.alias("label"), F.map_filter("p", lambda k, _: k.isin("exec", "command", "cmdLine", "gid")).alias("properties"))
    file = lambda f: F.struct(F.col(f).alias("uuid"), F.lit("file").alias("node_type"), F.col(f"{f}Path").alias("label"), F.create_map(F.lit("path"), F.col(f"{f}Path")).alias("properties"))
    found = [F.when(F.expr("subject <> ''") & (program != ""), process)]
    found += [F.when(F.expr(f"subject <> '' and {f} <> '' and {f}Path <> ''"), file(f)) for f in ("predicateObject", "predicateObject2")]
    rows = events.select("host", F.explode(F.array(*found)).alias("n")).where("n is not null").select("host", "n.*")
    return rows.select("uuid", "node_type", "label", "host", semantic_key(F.col("node_type"), F.col("label")).alias("semantic_key"), "properties")


def edges(recs: DataFrame) -> DataFrame:
    """Events as directed flow, one edge for each object (the second with the suffix :2), and the lineage of subjects."""
    valid = lambda f: F.when(F.expr(f"try_cast(x_{f} as bigint)") >= 0, F.expr(f"try_cast(x_{f} as bigint)"))
    size = F.coalesce(*[valid(f) for f in SIZE_FIELDS])
    own = recs.where("kind = 'Event'").withColumn("p", properties(())).withColumns({f"x_{f}": F.coalesce(scalar(f), F.col("p")[f]) for f in SIZE_FIELDS})
    events = own.select(
        scalar("uuid").alias("event_id"), scalar("subject").alias("subject"), F.coalesce(scalar("type"), F.lit("EVENT_UNKNOWN")).alias("relation"),
        F.coalesce(F.expr("try_variant_get(body, '$.timestampNanos', 'bigint')"), scalar("timestampNanos").cast("long"), F.lit(0)).alias("timestamp_ns"),
        F.coalesce(scalar("hostId"), F.lit("")).alias("host"), size.alias("data_size"),
        F.array(F.struct(scalar("predicateObject").alias("object"), F.lit("").alias("suffix")), F.struct(scalar("predicateObject2").alias("object"), F.lit(":2").alias("suffix"))).alias("objects"),
    )
    flat = events.withColumn("o", F.explode("objects")).where("subject <> '' and o.object <> ''")
    reads = F.col("relation").isin(*READ_LIKE)
    flows = flat.select(
        F.concat("event_id", "o.suffix").alias("event_id"), F.when(reads, F.col("o.object")).otherwise(F.col("subject")).alias("src"),
        F.when(reads, F.col("subject")).otherwise(F.col("o.object")).alias("dst"), "relation", "timestamp_ns", "host", "data_size",
    )
    born = recs.where("kind = 'Subject'").select(
        scalar("uuid").alias("uuid"), scalar("parentSubject").alias("parent"), F.coalesce(scalar("hostId"), F.lit("")).alias("host"),
        F.coalesce(scalar("startTimestampNanos").cast("long"), scalar("startTimestamp").cast("long"), F.lit(0)).alias("at"),
    ).where("parent <> '' and parent <> uuid")
    lineage = born.select(F.concat(F.lit("LINEAGE:"), "uuid").alias("event_id"), F.col("parent").alias("src"), F.col("uuid").alias("dst"), F.lit("EVENT_FORK").alias("relation"), F.col("at").alias("timestamp_ns"), "host", F.lit(None).cast("long").alias("data_size"))
    return flows.unionByName(lineage)
