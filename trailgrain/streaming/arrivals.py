"""Micro-batch scoring of an event stream: in-window deduplication, counts before each event, late events, last N as window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COLUMNS = "seq bigint, event_id string, src_type string, relation string, dst_type string, timestamp_ns bigint"
PATTERN = ("src_type", "relation", "dst_type")


class Arrivals:
    """State lives in folders named by batch, so that a batch that runs again writes the same rows again."""

    def __init__(self, spark: SparkSession, folder: str, window: int = 20_000) -> None:
        self.spark, self.folder, self.window = spark, folder, window

    def _state(self, name: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={batch}") if batch >= 0 else self.spark.createDataFrame([], schema)

    def step(self, rows: DataFrame, batch: int) -> None:
        """Score one micro-batch; events keep the order of seq, late ones are counted and never dropped."""
        rows = rows.select(*[F.expr(c.rsplit(" ", 1)[0].strip()) for c in COLUMNS.split(",")])
        before = self._state("window", batch - 1, COLUMNS)
        counts = self._state("counts", batch - 1, "src_type string, relation string, dst_type string, c bigint")
        seen = self._state("clock", batch - 1, "n bigint, latest bigint").first()
        n0, latest0 = (seen.n, seen.latest) if seen else (0, None)
        first = Window.partitionBy("event_id").orderBy("seq")
        new = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").join(before.select("event_id"), "event_id", "left_anti")
        order = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a micro-batch is of bounded size
        own = Window.partitionBy(*PATTERN).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        scored = new.join(counts, [*PATTERN], "left").withColumn("earlier", F.coalesce("c", F.lit(0)) + F.count("*").over(own)).withColumn("n", F.lit(n0) + F.count("*").over(order))
        late = F.coalesce(F.col("timestamp_ns") < F.greatest(F.max("timestamp_ns").over(order), F.lit(latest0).cast("long")), F.lit(False))
        scored = scored.withColumn("rarity", F.log((F.col("n") + 2) / (F.col("earlier") + 1)) / F.log(F.col("n") + 2)).withColumn("late", late).drop("c", "earlier", "n")
        scored.write.mode("overwrite").parquet(f"{self.folder}/scored/batch={batch}")
        done = self.spark.read.parquet(f"{self.folder}/scored/batch={batch}")
        names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
        before.union(done.select(*names)).orderBy(F.desc("seq")).limit(self.window).write.mode("overwrite").parquet(f"{self.folder}/window/batch={batch}")
        more = counts.union(done.groupBy(*PATTERN).agg(F.count("*").alias("c"))).groupBy(*PATTERN).agg(F.sum("c").alias("c"))
        more.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")
        clock = done.agg((F.lit(n0) + F.count("*")).alias("n"), F.greatest(F.max("timestamp_ns"), F.lit(latest0).cast("long")).alias("latest"))
        clock.write.mode("overwrite").parquet(f"{self.folder}/clock/batch={batch}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Score what the stream has now, micro-batch by micro-batch."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def scored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scored")
