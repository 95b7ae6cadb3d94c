"""eCAR records in JSON lines: file, process and flow events as directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("image_path", "file_path", "direction", "src_ip", "src_port", "dest_ip", "dest_port", "l4protocol", "command_line", "parent_image_path", "target_image_path")
SCHEMA = (
    "id string, actorID string, objectID string, hostname string, pid bigint, object string, action string, timestamp string, "
    f"properties struct<{', '.join(f'{f}: string' for f in FIELDS)}>"
)


def read_ecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def ecar_edges(raw: DataFrame) -> DataFrame:
    """id, ends with labels and types, relation, time in ns and host. File reads and inbound flows run from the object to the actor."""
    p = lambda f: F.nullif(F.col(f"properties.{f}"), F.lit(""))
    shown = lambda f: F.coalesce(F.col(f"properties.{f}"), F.lit("?"))
    created = (F.col("object") == "PROCESS") & (F.col("action") == "CREATE") & p("parent_image_path").isNotNull()
    # The words of these labels, which enter signatures.
    actor = F.when(created, p("parent_image_path")).otherwise(F.coalesce(p("image_path"), F.concat(F.lit("进程 PID "), F.coalesce(F.col("pid").cast("string"), F.lit("?")))))
    flow = F.concat(shown("src_ip"), F.lit(":"), shown("src_port"), F.lit(" → "), shown("dest_ip"), F.lit(":"), shown("dest_port"))
    target = (
        F.when(F.col("object") == "FILE", F.coalesce(p("file_path"), "objectID")).when(F.col("object") == "FLOW", flow)
        .when(created, F.coalesce(p("image_path"), "objectID")).otherwise(F.coalesce(p("target_image_path"), "objectID"))
    )
    back = ((F.col("object") == "FILE") & (F.col("action") == "READ")) | ((F.col("object") == "FLOW") & (F.lower(F.col("properties.direction")) == "inbound"))
    turn = lambda a, b: (F.when(F.coalesce(back, F.lit(False)), b).otherwise(a), F.when(F.coalesce(back, F.lit(False)), a).otherwise(b))
    ends, labels, types = turn(F.col("actorID"), F.col("objectID")), turn(actor, target), turn(F.lit("process"), F.lower("object"))
    return raw.where(F.col("object").isin("FILE", "PROCESS", "FLOW")).select(
        "id", ends[0].alias("source"), ends[1].alias("target"), labels[0].alias("source_label"), labels[1].alias("target_label"),
        types[0].alias("source_type"), types[1].alias("target_type"), F.concat_ws("_", "object", "action").alias("relation"), "timestamp",
        (F.unix_micros(F.to_timestamp("timestamp")) * 1000).alias("timestamp_ns"), F.col("hostname").alias("host"), "properties",
    )


def corpus(edges: DataFrame, host: str, end_ns: int) -> DataFrame:
    """A host's events before the end, each id once: the first in time, equal times by their content."""
    own = edges.where((F.col("host") == host) & (F.col("timestamp_ns") < end_ns))
    first = own.groupBy("id").agg(F.min_by(F.struct(*[c for c in own.columns if c != "id"]), F.struct("timestamp_ns", F.xxhash64(*own.columns))).alias("r"))
    return first.select("id", "r.*")


def conflicts(edges: DataFrame) -> DataFrame:
    """Ids that stand for different events."""
    named = edges.withColumn("print", F.sha2(F.to_json(F.struct(*[c for c in edges.columns if c != "id"])), 256))
    return named.groupBy("id").agg(F.countDistinct("print").alias("versions")).where("versions > 1")
