"""Sessions, episodes, ranks and running counts over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_groups(edges: DataFrame, keys: list[str], gap_ns: int, order: tuple[str, ...] = ("timestamp_ns", "edge_id")) -> DataFrame:
    """Number the groups of each key: a new one where the time since the previous event exceeds the gap (an equal one joins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) <= gap_ns, 0).otherwise(1)
    return edges.withColumn("new_", new).withColumn("group", F.sum("new_").over(w)).drop("new_")


def merged_dependencies(edges: DataFrame, gap_ns: int) -> DataFrame:
    """Parallel events of a dependency merged by gap: the first represents, the last gives the time, known sizes add up."""
    grouped = gap_groups(edges, ["src", "dst", "relation"], gap_ns)
    return grouped.groupBy("src", "dst", "relation", "group").agg(
        F.min_by("edge_id", F.struct("timestamp_ns", "edge_id")).alias("edge_id"), F.max("timestamp_ns").alias("timestamp_ns"),
        F.sum("data_size").alias("data_size"), F.count("*").alias("members"),
    ).drop("group")


def bounded_episodes(edges: DataFrame, keys: list[str], span_ns: int) -> DataFrame:
    """Greedy episodes no longer than span, from each one's first event: keys, edge_id and the episode's start.

    A gap above the span always begins an episode, so the stretches between such gaps are folded in different tasks, each in
    time order with nothing in memory but the episode's start.
    """
    import numpy as np
    import pyarrow as pa

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for b in batches:
            names, times, starts = b.column("stretch_").to_pylist(), b.column("timestamp_ns").to_pylist(), np.zeros(b.num_rows, np.int64)
            for k, (name, t) in enumerate(zip(names, times, strict=True)):
                if name != last or t - start > span_ns:
                    start = t
                last = name
                starts[k] = start
            yield pa.record_batch([*(b.column(c) for c in [*keys, "edge_id"]), pa.array(starts)], [*keys, "edge_id", "start"])

    w = Window.partitionBy(*keys).orderBy("timestamp_ns", "edge_id")
    gap = F.when(F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) <= span_ns, 0).otherwise(1)
    rows = edges.withColumn("gap_", gap).withColumn("number_", F.sum("gap_").over(w))
    rows = rows.withColumn("stretch_", F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys], F.col("number_").cast("string")))
    rows = rows.repartition("stretch_").sortWithinPartitions("stretch_", "timestamp_ns", "edge_id").select(*keys, "edge_id", "timestamp_ns", "stretch_")
    schema = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(fold, f"{schema}, edge_id long, start long")


def running_before(order: tuple[str, ...], *partition: str) -> object:
    """The frame of all earlier rows of a partition."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def interval_union(windows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Overlapping or touching intervals of a key merged."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("new_", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("g_", F.sum("new_").over(w))
    return marked.groupBy(*keys, "g_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("g_")
