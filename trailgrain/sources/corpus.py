"""Raw lines with where they stand, checks of imported records, and labels by exact id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number (from 1).

    A file's blocks are read by several tasks; a line's number is its place in its block after the lines of the blocks before.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("i"))
    return lines.withColumn("place", place).join(blocks.select("file", "block", before.alias("base")), ["file", "block"]).select("file", (F.col("base") + F.col("place")).alias("line"), "value")


def conflicting(records: DataFrame, key: str) -> DataFrame:
    """Keys that stand for records of different content: (key, versions)."""
    print_ = F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != key])), 256)
    return records.groupBy(key).agg(F.countDistinct(print_).alias("versions")).where("versions > 1")


def checked(records: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Records once each. A missing required field or a key with different records stops the import."""
    empty = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in required]
    counts = records.agg(*[F.count_if(e).alias(c) for c, e in zip(required, empty, strict=True)]).first()
    missing = {c: n for c, n in counts.asDict().items() if n}
    if missing:
        raise ValueError(f"records without required fields: {missing}")
    bad = conflicting(records, key).limit(3).collect()
    if bad:
        raise ValueError(f"ids with different records, such as {[r[0] for r in bad]}")
    return records.dropDuplicates([key])


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes (uuid, label) with the first label that a line (file, line, uuid, name) gives their very uuid; others keep theirs."""
    first = labels.groupBy("uuid").agg(F.min_by("name", F.struct("file", "line")).alias("name"))
    return nodes.join(first, "uuid", "left").withColumn("label", F.coalesce("name", "label")).drop("name")
