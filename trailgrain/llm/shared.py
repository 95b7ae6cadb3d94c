"""Shared folder, stored tables and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session, whose driver is the executor, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailgrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Recent:
    """A cache of bounded size for the words of texts, in a young and an old part; what is met again becomes young.

    learn: gives (key, value) for new keys. A part holds about `size` keys, and those of one call at most beyond.
    """

    def __init__(self, learn: Callable[[list], Iterable[tuple]], size: int) -> None:
        self.learn, self.size = learn, size
        self.young: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def find(self, rows: list[list]) -> list[list]:
        """The values of each row's keys."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        found = [list(map(self.young.get, keys)) for keys in rows]
        missing = [list(_gaps(values)) for values in found]
        new = {keys[k] for keys, places in zip(rows, missing, strict=True) for k in places}
        for key in new & self.old.keys():
            self.young[key] = self.old[key]
        self.young.update(self.learn(list(new - self.young.keys())))
        for keys, values, places in zip(rows, found, missing, strict=True):
            for k in places:
                values[k] = self.young[keys[k]]
        return found


def _gaps(values: list) -> Iterator[int]:
    """Where a list holds None."""
    k = -1
    try:
        while True:
            k = values.index(None, k + 1)
            yield k
    except ValueError:
        return


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the Arrow batches that go to Python by bytes, so that long texts do not make them large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new folder under the shared one and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    spark, path = df.sparkSession, df.stored_path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which block counts scale."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component being the smallest node reachable.

    Alternating large-star and small-star steps; a step is a grouped minimum and a join, so that no group is held in
    one task, and each round's links are stored. Nodes without a link do not appear. Null ends are ignored.
    """
    now = stored(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    for _ in range(rounds):
        if _stars(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        near = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        new = near.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b").where("a <> b").distinct()
        new = stored(new, "links")
        dropped(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node has one smaller node at most, which has none itself: then the links name the components."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(links.select("b", F.lit(0), F.lit(1)))
    state = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return state.where("c > 1 or (c > 0 and p > 0)").limit(1).count() == 0
