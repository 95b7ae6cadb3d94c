"""Snapshots of an event stream: types as declared so far, rarity before each event, PageRank kept under edits, and a choice under a cap.

After each micro-batch the window's channels are compared with those before; only changed weights reach the rank. Endpoints of
alerts outlive the window and can bring back their history. State lives in folders named by batch, so a batch that runs again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailgrain.functions import events as E
from trailgrain.operators import bundles as B
from trailgrain.operators import dynamic as D
from trailgrain.operators.graph import cut
from trailgrain.streaming.arrivals import Arrivals

ROWS = "seq bigint, kind string, uuid string, node_type string, event_id string, src string, dst string, relation string, timestamp_ns bigint"
EVENTS = "seq bigint, event_id string, src string, dst string, relation string, timestamp_ns bigint, rarity double"
DECISIONS = "seq bigint, event_id string, src string, dst string, relation string, timestamp_ns bigint, rarity double, score double, retained boolean, status string"
UNKNOWN = "unknown"


class Snapshots:
    """A stream of ROWS: kind `node` declares the type of uuid for events that come later, kind `edge` is an event.

    pois: (event_id) of alerts. window: the last so many events are active; budget: the share of them that a choice may keep.
    hops: how far history of alert endpoints is brought back from events that left the window (0: not at all).
    """

    def __init__(self, spark: SparkSession, folder: str, pois: DataFrame, window: int = 20_000, budget: float = 0.2, hops: int = 0, restart: float = 0.15, tolerance: float = 1e-4, rounds: int = 1000) -> None:
        if window < 1 or not 0 < budget <= 1:
            raise ValueError("window must be positive and budget in (0, 1]")
        self.spark, self.folder, self.pois = spark, folder, pois.select("event_id").distinct()
        self.budget, self.hops, self.restart, self.tolerance, self.rounds = budget, hops, restart, tolerance, rounds
        self.arrivals = Arrivals(spark, f"{folder}/arrivals", window)

    def _read(self, name: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={batch}") if batch >= 0 else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def typed(self, rows: DataFrame, batch: int) -> DataFrame:
        """The batch's events with the types that their ends had been given before them."""
        known = self._read("types", batch - 1, "uuid string, node_type string")
        declared = rows.where("kind = 'node'").select("uuid", "seq", "node_type").unionByName(known.withColumn("seq", F.lit(-(1 << 62)).cast("long")))
        last = declared.groupBy("uuid").agg(F.max_by("node_type", "seq").alias("node_type"))
        self._write(last, "types", batch)
        events = rows.where("kind = 'edge'")
        for end in ("src", "dst"):
            ask = events.select(F.col(end).alias("uuid"), "seq", F.lit(None).cast("string").alias("node_type"), F.lit(True).alias("asks"))
            both = ask.unionByName(declared.withColumn("asks", F.lit(False)))
            before = Window.partitionBy("uuid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
            seen = both.withColumn("t", F.last("node_type", ignorenulls=True).over(before)).where("asks").select("seq", F.coalesce("t", F.lit(UNKNOWN)).alias(f"{end}_type"))
            events = events.join(seen.distinct(), "seq")
        return events

    def step(self, rows: DataFrame, batch: int) -> None:
        rows = cut(rows.select(*[c.strip().split(" ")[0] for c in ROWS.split(",")]))
        events = cut(self.typed(rows, batch))
        self.arrivals.step(events.select("seq", "event_id", "src_type", "relation", "dst_type", "timestamp_ns"), batch)
        scored = self.spark.read.parquet(f"{self.folder}/arrivals/scored/batch={batch}")
        self._write(scored.select("seq", "rarity").join(events.select("seq", "event_id", "src", "dst", "relation", "timestamp_ns"), "seq"), "events", batch)
        ends = self._read("endpoints", batch - 1, "node string").unionByName(self._read("events", batch, EVENTS).join(self.pois, "event_id", "left_semi").select(F.explode(F.array("src", "dst")).alias("node")))
        self._write(ends.distinct(), "endpoints", batch)
        self.snapshot(batch)

    def active(self, batch: int) -> tuple[DataFrame, int]:
        """The window's events and, with hops, those of the history around alert endpoints; and how many are in the window."""
        every = self.spark.read.schema(EVENTS + ", batch int").parquet(f"{self.folder}/events").where(F.col("batch") <= batch).drop("batch")
        window = cut(every.join(self.spark.read.parquet(f"{self.folder}/arrivals/window/batch={batch}").select("seq"), "seq", "left_semi"))
        out = window
        if self.hops:
            front = self._read("endpoints", batch, "node string")
            for _ in range(self.hops):
                near = cut(every.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(*every.columns).unionByName(every.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*every.columns)))
                out = out.unionByName(near)
                front = near.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            out = out.dropDuplicates(["event_id"]) if self.hops else out
        return cut(out), window.count()

    def snapshot(self, batch: int) -> None:
        """Write the decisions and the report of the state after a batch."""
        events, hot = self.active(batch)
        rank = self._ranked(events, batch)
        flow = events.withColumns({"a": E.causal_source(), "b": E.causal_target()}).join(self.pois.withColumn("poi", F.lit(True)), "event_id", "left").fillna(False, ["poi"])
        flow = cut(flow)
        given = flow.where("poi").select(F.explode(F.array("a", "b")).alias("node"), F.lit(1.0).alias("mass"))
        n_poi, cap, bound, status = flow.where("poi").count(), int(hot * self.budget), None, "waiting for an alert"
        scores = flow.withColumn("score", F.lit(0.0))
        kept = None
        if n_poi:
            rank, bound, _ = D.solved(D.with_seeds(rank, given), self.tolerance, self.rounds)
            scores = cut(self._scores(flow, rank))
            status = "provisional: not converged" if bound > self.tolerance else "infeasible: more alerts than the budget" if n_poi > cap else "ready"
            kept = self._kept(scores, cap) if status == "ready" else None
        for name in ("weights", "values", "seeds"):
            self._write(getattr(rank, name), f"rank/{name}", batch)
        retained: Column = F.lit(None).cast("boolean") if kept is None else F.coalesce("kept", F.lit(False))
        if kept is not None:
            scores = scores.join(kept.select(F.col("edge_id").alias("seq"), F.lit(True).alias("kept")), "seq", "left")
        rows = scores.withColumn("retained", retained).withColumn("status", F.lit(status))
        self._write(rows.select(*[c.strip().split(" ")[0] for c in DECISIONS.split(",")]), "decisions", batch)
        clock = self.spark.read.parquet(f"{self.folder}/arrivals/clock/batch={batch}")
        late = self.spark.read.option("basePath", f"{self.folder}/arrivals/scored").parquet(f"{self.folder}/arrivals/scored").where(F.col("batch") <= batch).where("late").agg(F.count("*").alias("late"))
        done = self._read("decisions", batch, DECISIONS).agg(F.count("*").alias("active"), F.count(F.when(F.col("retained"), 1)).alias("kept"))
        report = clock.select(F.col("n").alias("seen")).crossJoin(late).crossJoin(done)  # one row each
        self._write(report.select(F.lit(status).alias("status"), "seen", F.lit(hot).alias("hot"), "active", "late", F.lit(n_poi).alias("alerts"), F.lit(cap).alias("cap"), "kept", F.lit(bound).cast("double").alias("bound")), "reports", batch)

    def _ranked(self, events: DataFrame, batch: int) -> D.Rank:
        """The rank of the batch before, with the weights of pairs that the window changed."""
        old = [self._read(f"rank/{n}", batch - 1, s) for n, s in (("weights", D.WEIGHTS), ("values", D.VALUES), ("seeds", D.SEEDS))]
        before = old[0].where("node <= next").select(F.col("node").alias("a"), F.col("next").alias("b"), F.col("weight").alias("was"))
        channels = events.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").agg(F.max(0.2 + 0.8 * F.col("rarity")).alias("w"))
        pairs = channels.groupBy("a", "b").agg(F.sum("w").alias("w"))
        edits = before.join(pairs, ["a", "b"], "full").where("was is null or w is null or abs(was - w) > 1e-12").select("a", "b", F.coalesce("w", F.lit(0.0)).alias("weight"))
        return D.with_edits(D.Rank(*old, self.restart), cut(edits))

    def _scores(self, flow: DataFrame, rank: D.Rank) -> DataFrame:
        """Rarity times the geometric mean of both ends' lift over what their degrees would give, relative to the largest; alerts have 1."""
        degree = rank.weights.groupBy("node").agg(F.sum("weight").alias("d"))
        volume = degree.agg(F.sum("d")).first()[0] or 1.0
        lift = rank.values.join(degree, "node", "left").select("node", F.log1p(F.greatest(F.lit(0.0), F.col("estimate") / F.greatest(F.coalesce("d", F.lit(0.0)) / volume, F.lit(1e-15)) - 1)).alias("lift"))
        rows = flow.join(lift.select(F.col("node").alias("a"), F.col("lift").alias("la")), "a", "left").join(lift.select(F.col("node").alias("b"), F.col("lift").alias("lb")), "b", "left")
        rows = cut(rows.withColumn("score", (0.2 + 0.8 * F.col("rarity")) * F.sqrt(F.coalesce("la", F.lit(0.0)) * F.coalesce("lb", F.lit(0.0)))))
        top = rows.agg(F.max("score")).first()[0] or 1.0
        return rows.withColumn("score", F.when(F.col("poi"), 1.0).otherwise(F.col("score") / top)).drop("la", "lb")

    def _kept(self, scores: DataFrame, cap: int) -> DataFrame:
        from trailgrain.plans.diffusion import forked

        costs = cut(scores.select(F.col("seq").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("timestamp_ns").alias("t"), F.lit(1.0).alias("cf"), F.lit(1.0).alias("cb"), "poi"))
        pointers = cut(forked(costs.drop("poi"), costs.where("poi"), None))
        own = scores.select(F.col("seq").alias("edge_id"), F.round("score", 6).alias("score"), F.col("poi").alias("mandatory")).join(pointers, "edge_id").withColumn("case", F.lit("window"))
        own = cut(B.eligible(own))
        return B.packed(own, B.members(own.select("edge_id"), pointers), self.spark.createDataFrame([("window", cap)], "case string, budget long"))

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """A snapshot after each micro-batch of what the stream has now."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/reports")

    def decisions(self, batch: int) -> DataFrame:
        return self._read("decisions", batch, DECISIONS)
