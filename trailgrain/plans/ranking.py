"""Queries: ranks, fusion and budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import cut
from trailgrain.plans.registry import edge_query
from trailgrain.plans.scores import POI, RARITY, rounded_rarity

TIE = "substr(sha256(CAST(edge_id AS VARCHAR)), 1, 16)"


def tied(edges: DataFrame) -> DataFrame:
    """Edges with rarity, a keyed tie and whether they are mandatory."""
    found = rounded_rarity(edges)
    return found.withColumn("tie", F.substring(F.sha2(F.col("edge_id").cast("string"), 256), 1, 16)).withColumn("mandatory", F.col("edge_id") % POI == 0)


SCORED = f"{RARITY}, scored AS (SELECT *, {TIE} AS tie, edge_id % {POI} = 0 AS mandatory FROM rarity), size AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS b FROM edges)"


def budget(edges: DataFrame, ratio: float = 0.05) -> int:
    return max(1, int(edges.count() * ratio))


def keyed(scored: DataFrame) -> DataFrame:
    """With a key that sorts mandatory events first, then the best score, then the tie."""
    return scored.withColumn("key", F.concat(F.when(F.col("mandatory"), "0").otherwise("1"), O.descending(F.col("rarity")), "tie"))


def top_budget(scored: DataFrame, size: int) -> DataFrame:
    """Mandatory events, then the best by score; ties by the key."""
    sizes = scored.sparkSession.createDataFrame([(0, size)], "group_ int, size long")
    return O.smallest(keyed(scored), "key", sizes)


def stratified(scored: DataFrame, size: int) -> DataFrame:
    """Round robin over relations: the next event comes from the relation with the fewest so far, mandatory ones included.

    An event's turn is its place in its relation's queue, after the relation's mandatory ones. The turn at which the budget
    ends follows from the relations' counts; relations give their best up to it, and at the next turn the best of the heads.
    """
    counts = {r.relation: (r.n, r.m) for r in scored.groupBy("relation").agg(F.count("*").alias("n"), F.count_if("mandatory").alias("m")).collect()}  # a row a relation
    mandatory = sum(m for _, m in counts.values())
    given = lambda turn: {r: min(n - m, max(0, turn - m)) for r, (n, m) in counts.items()}  # noqa: E731  # those with turns below
    if mandatory >= size:
        return top_budget(scored, size)
    low, high = 0, max(n for n, _ in counts.values()) + 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if mandatory + sum(given(middle).values()) <= size else (low, middle - 1)
    take, more = given(low), given(low + 1)
    rest = size - mandatory - sum(take.values())
    table = scored.sparkSession.createDataFrame([(r, counts[r][1] + more[r], counts[r][1] + take[r]) for r in counts], "relation string, size long, sure long")
    own = O.smallest(keyed(scored), "key", table.select("relation", "size"), "relation")
    last = own.groupBy("relation").agg(F.max("key").alias("last"), F.count("*").alias("n")).join(F.broadcast(table), "relation")
    marked = own.join(F.broadcast(last.select("relation", "last", (F.col("n") > F.col("sure")).alias("one_more"))), "relation")
    is_last = F.col("one_more") & (F.col("key") == F.col("last"))
    heads = marked.where(is_last).orderBy("key").limit(rest)  # one a relation at most
    return marked.where(~is_last).unionByName(heads).drop("last", "one_more")


@edge_query(f", {SCORED} SELECT edge_id, rarity, mandatory FROM scored ORDER BY mandatory DESC, rarity DESC, tie LIMIT (SELECT b FROM size)")
def select_top(edges: DataFrame) -> DataFrame:
    scored = cut(tied(edges))
    return top_budget(scored, budget(scored)).select("edge_id", "rarity", "mandatory")


STRATA = """q AS (SELECT *, CASE WHEN mandatory THEN -1 ELSE row_number() OVER (PARTITION BY relation, mandatory ORDER BY rarity DESC, tie) - 1
  + count(*) FILTER (WHERE mandatory) OVER (PARTITION BY relation) END AS turn FROM scored)"""


@edge_query(f", {SCORED}, {STRATA} SELECT edge_id, relation, rarity FROM q ORDER BY turn, rarity DESC, tie LIMIT (SELECT b FROM size)")
def select_stratified(edges: DataFrame) -> DataFrame:
    scored = cut(tied(edges))
    return stratified(scored, budget(scored)).select("edge_id", "relation", "rarity")


@edge_query(f""", {SCORED}, first AS (SELECT edge_id FROM scored ORDER BY mandatory DESC, rarity DESC, tie LIMIT (SELECT b // 2 FROM size)),
again AS (SELECT * REPLACE (edge_id IN (SELECT edge_id FROM first) AS mandatory) FROM scored), q AS (SELECT *, CASE WHEN mandatory THEN -1 ELSE row_number() OVER (PARTITION BY relation, mandatory ORDER BY rarity DESC, tie) - 1
  + count(*) FILTER (WHERE mandatory) OVER (PARTITION BY relation) END AS turn FROM again) SELECT edge_id FROM q ORDER BY turn, rarity DESC, tie LIMIT (SELECT b FROM size)""")
def select_portfolio(edges: DataFrame) -> DataFrame:
    """Half of the budget to the best overall, the rest by strata on top of them."""
    scored = cut(tied(edges))
    size = budget(scored)
    first = top_budget(scored, size // 2).select("edge_id", F.lit(True).alias("in_first"))
    again = scored.join(first, "edge_id", "left").withColumn("mandatory", F.coalesce("in_first", F.lit(False)))
    return stratified(again, size).select("edge_id")


@edge_query(f""", {SCORED}, c AS (SELECT *, coalesce(sum(CAST(round(rarity * 1000000) AS BIGINT)) OVER (PARTITION BY relation ORDER BY rarity DESC, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
sum(CAST(round(rarity * 1000000) AS BIGINT)) OVER (PARTITION BY relation) AS total FROM scored) SELECT edge_id, relation FROM c WHERE 10 * before < 3 * total""")
def select_mass(edges: DataFrame) -> DataFrame:
    """The fewest events of each relation that hold 30 % of its rarity."""
    whole = tied(edges).withColumn("parts", F.round(F.col("rarity") * 1_000_000).cast("long"))
    total = whole.groupBy("relation").agg(F.sum("parts").alias("total"))
    before = O.running(whole, ["relation"], [F.desc("rarity"), "tie"], before=F.col("parts"))
    return before.join(total, "relation").where("10 * before < 3 * total").select("edge_id", "relation")


NODE_SCORES = f"{SCORED}, n AS (SELECT src AS node, src_type AS kind, max(rarity) AS best, count(*) AS events FROM scored GROUP BY ALL)"


def node_scores(edges: DataFrame) -> DataFrame:
    return tied(edges).groupBy(F.col("src").alias("node"), F.col("src_type").alias("kind")).agg(F.max("rarity").alias("best"), F.count("*").alias("events"))


@edge_query(f", {NODE_SCORES} SELECT node, kind, rank() OVER (PARTITION BY kind ORDER BY best DESC) + (count(*) OVER (PARTITION BY kind, best) - 1) / 2 AS midrank FROM n")
def node_midranks(edges: DataFrame) -> DataFrame:
    return O.midranks(node_scores(edges), ["kind"], "best").select("node", "kind", "midrank")


@edge_query(f""", {NODE_SCORES}, r AS (SELECT node, rank() OVER (PARTITION BY kind ORDER BY best DESC) + (count(*) OVER (PARTITION BY kind, best) - 1) / 2 AS a,
rank() OVER (PARTITION BY kind ORDER BY events DESC) + (count(*) OVER (PARTITION BY kind, events) - 1) / 2 AS b, best FROM n) SELECT node, round((CASE WHEN best > 0 THEN 1 / (60 + a) ELSE 0 END) + 1 / (60 + b), 9) AS fused FROM r""")
def rank_fusion(edges: DataFrame) -> DataFrame:
    """Reciprocal ranks of two channels added; ties share their average rank and zeros abstain."""
    ranked = O.midranks(O.midranks(node_scores(edges), ["kind"], "best", "a"), ["kind"], "events", "b")
    return ranked.select("node", F.round(F.when(F.col("best") > 0, 1 / (60 + F.col("a"))).otherwise(0) + 1 / (60 + F.col("b")), 9).alias("fused"))


@edge_query(f", {NODE_SCORES}, r AS (SELECT node, kind, row_number() OVER (PARTITION BY kind ORDER BY best DESC, node) AS a, row_number() OVER (PARTITION BY kind ORDER BY events DESC, node) AS b FROM n) SELECT node, kind, row_number() OVER (PARTITION BY kind ORDER BY least(a, b), CASE WHEN a <= b THEN 0 ELSE 1 END) AS place FROM r")
def round_robin(edges: DataFrame) -> DataFrame:
    """Two views take turns; an item has the turn of its better place, the first view before the second."""
    views = O.ranked(O.ranked(node_scores(edges), ["kind"], [F.desc("best"), "node"], "a"), ["kind"], [F.desc("events"), "node"], "b")
    turns = views.select("node", "kind", F.least("a", "b").alias("turn"), F.when(F.col("a") <= F.col("b"), 0).otherwise(1).alias("view"))
    return O.ranked(turns, ["kind"], ["turn", "view"]).select("node", "kind", "place")


@edge_query(f", {NODE_SCORES} SELECT node, kind, round(1 - percent_rank() OVER (PARTITION BY kind ORDER BY best DESC, node), 6) AS percentile FROM n")
def empirical_percentile(edges: DataFrame) -> DataFrame:
    found = node_scores(edges)
    n = found.groupBy("kind").agg(F.count("*").alias("n"))
    placed = O.ranked(found, ["kind"], [F.desc("best"), "node"]).join(n, "kind")
    return placed.select("node", "kind", F.round(F.when(F.col("n") == 1, 1.0).otherwise(1 - (F.col("place") - 1) / (F.col("n") - 1)), 6).alias("percentile"))


@edge_query(", s AS (SELECT host, src, count(*) AS c, CAST(sum(coalesce(data_size, 0)) AS DOUBLE) AS v FROM edges GROUP BY ALL), m AS (SELECT host, min(v) AS lo, max(v) AS hi FROM s GROUP BY ALL) SELECT host, src, round(CASE WHEN hi = lo THEN 0.5 ELSE (v - lo) / (hi - lo) END, 6) AS scaled FROM s JOIN m USING (host)")
def min_max_scaled(edges: DataFrame) -> DataFrame:
    """Bytes of each source scaled within its host; a constant gives 0.5."""
    s = edges.groupBy("host", "src").agg(F.sum(F.coalesce("data_size", F.lit(0))).cast("double").alias("v"))
    m = s.groupBy("host").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return s.join(m, "host").select("host", "src", F.round(F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled"))


@edge_query(f", {SCORED}, t AS (SELECT src, sum(rarity) AS total FROM scored GROUP BY ALL) SELECT edge_id, round(0.99 * rarity / (total + 1e-12), 6) AS share FROM scored JOIN t USING (src)")
def source_shares(edges: DataFrame) -> DataFrame:
    """Weights of a source's events that sum to 0.99, so that backpropagation contracts."""
    scored = tied(edges)
    total = scored.groupBy("src").agg(F.sum("rarity").alias("total"))
    return scored.join(total, "src").select("edge_id", F.round(0.99 * F.col("rarity") / (F.col("total") + 1e-12), 6).alias("share"))


@edge_query(f", {SCORED}, e AS (SELECT rarity AS v, count(*) AS c FROM scored GROUP BY ALL), k AS (SELECT v, sum(c) OVER (ORDER BY v) - c / 2 AS below, sum(c) OVER () AS n FROM e) SELECT v AS rarity, round(below / n, 6) AS percentile FROM k")
def mid_ecdf(edges: DataFrame) -> DataFrame:
    """Share of events with less rarity, half of the equal ones included; there is a row for each distinct value."""
    values = tied(edges).groupBy(F.col("rarity")).agg(F.count("*").alias("c"))
    n = values.agg(F.sum("c")).first()[0] or 1
    return O.running(values, [], ["rarity"], below=F.col("c")).select("rarity", F.round((F.col("below") + F.col("c") / 2) / n, 6).alias("percentile"))


@edge_query(f", {SCORED}, r AS (SELECT rarity, row_number() OVER (ORDER BY rarity, edge_id) AS k, count(*) OVER () AS n FROM scored WHERE rarity > 0) SELECT q.q, rarity AS value FROM r, (VALUES (0.5), (0.9), (0.99)) q(q) WHERE k = greatest(1, CAST(ceil(q.q * n) AS BIGINT))".replace("SELECT q.q, rarity", "SELECT CAST(q.q AS DOUBLE) AS q, rarity"))
def positive_quantiles(edges: DataFrame) -> DataFrame:
    scored = tied(edges).where("rarity > 0")
    cuts = [F.struct(F.lit(q).alias("q"), F.expr(f"percentile_disc({q}) within group (order by rarity)").alias("value")) for q in (0.5, 0.9, 0.99)]
    return scored.agg(F.array(*cuts).alias("x")).select(F.explode("x").alias("x")).select("x.q", "x.value")


@edge_query(f", {SCORED} SELECT relation, round(quantile_cont(rarity, 0.25), 6) AS p25, round(quantile_cont(rarity, 0.75), 6) AS p75 FROM scored GROUP BY ALL")
def interpolated_quantiles(edges: DataFrame) -> DataFrame:
    return tied(edges).groupBy("relation").agg(F.round(F.percentile("rarity", 0.25), 6).alias("p25"), F.round(F.percentile("rarity", 0.75), 6).alias("p75"))


@edge_query(f", {SCORED}, d AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rarity DESC, tie) AS k FROM scored) SELECT edge_id, dst FROM d WHERE k = 1 ORDER BY rarity DESC, tie LIMIT 25")
def diverse_pois(edges: DataFrame) -> DataFrame:
    """The 25 best events of different destinations."""
    first = Window.partitionBy("dst").orderBy(F.desc("rarity"), "tie")
    return tied(edges).withColumn("k", F.row_number().over(first)).where("k = 1").orderBy(F.desc("rarity"), "tie").limit(25).select("edge_id", "dst")


@edge_query(f", {NODE_SCORES}, r AS (SELECT node, kind, row_number() OVER (PARTITION BY kind ORDER BY best DESC, node) AS a, row_number() OVER (PARTITION BY kind ORDER BY events DESC, node) AS b FROM n) SELECT node, kind, round(1 / (60 + a) + 1 / (60 + b), 9) AS fused, a AS main FROM r")
def fused_views(edges: DataFrame) -> DataFrame:
    """Two views' places fused by reciprocal ranks without ties, and the place in the main view."""
    views = O.ranked(O.ranked(node_scores(edges), ["kind"], [F.desc("best"), "node"], "a"), ["kind"], [F.desc("events"), "node"], "b")
    return views.select("node", "kind", F.round(1 / (60 + F.col("a")) + 1 / (60 + F.col("b")), 9).alias("fused"), F.col("a").alias("main"))


@edge_query(f", {SCORED}, r AS (SELECT relation, rarity * (edge_id % 7) AS v, row_number() OVER (PARTITION BY relation ORDER BY rarity * (edge_id % 7), edge_id) AS k, count(*) OVER (PARTITION BY relation) AS n FROM scored) SELECT relation, CAST(q AS DOUBLE) AS q, round(v, 6) AS value FROM r, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) AS q) WHERE k = 1 + CAST(floor(q * (n - 1) + 0.5) AS BIGINT)")
def index_quantiles(edges: DataFrame) -> DataFrame:
    """Values at the places nearest to fractions of the order, half upwards."""
    own = tied(edges).select("relation", "edge_id", (F.col("rarity") * (F.col("edge_id") % 7)).alias("v"))
    n = own.groupBy("relation").agg(F.count("*").alias("n"))
    wanted = n.select("relation", F.explode(F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"), "n").withColumn("place", 1 + F.floor(F.col("q") * (F.col("n") - 1) + 0.5))
    return O.ranked(own, ["relation"], ["v", "edge_id"]).join(wanted, ["relation", "place"]).select("relation", "q", F.round("v", 6).alias("value"))
