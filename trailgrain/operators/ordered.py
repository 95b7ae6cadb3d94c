"""Orders over many rows without one task: selection by digits of a key, and running totals by parts of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators.graph import cut

DIGITS, FEW = 3, 100_000  # characters of the key a round; rows of a group among which the last ones are ordered
LAST = "~"  # sorts after the characters of keys: all that begins so far is below the border


def descending(score: Column) -> Column:
    """A score in [0, 1] of six decimals as text that sorts the largest first."""
    return F.lpad((1_000_000 - F.round(score * 1_000_000)).cast("long").cast("string"), 7, "0")


def smallest(rows: DataFrame, key: str, sizes: DataFrame, group: str = "group_") -> DataFrame:
    """Of each group the rows with the smallest keys (unique text of one length), as many as `sizes` (group, size) says.

    Rounds count the next characters of the key in the range where a group's border lies, and keep what is below, until so
    few rows are left at the border that they can be ordered. Groups must be of a bounded number, such as relations.
    """
    own = rows if group in rows.columns else rows.withColumn(group, F.lit(0))
    state = {r[group]: ["", int(r["size"])] for r in sizes.collect() if r["size"] > 0}  # the border's prefix and how many to take there
    counts = {r[group]: r["n"] for r in own.groupBy(group).agg(F.count("*").alias("n")).collect()}
    state = {g: [p, n] if n < counts.get(g, 0) else [LAST, 0] for g, (p, n) in state.items()}
    open_ = {g for g, (p, _) in state.items() if p != LAST and counts[g] > FEW}
    spark, at = rows.sparkSession, 0
    length = rows.select(F.length(key)).first()
    length = length[0] if length else 0
    kind = own.schema[group].dataType.simpleString()
    table = lambda: spark.createDataFrame([(g, p, n) for g, (p, n) in state.items()], f"`{group}` {kind}, p_ string, n_ long")
    while open_ and at < length:
        here = own.join(F.broadcast(table().where(F.col(group).isin(*open_))), group).where(F.col(key).startswith(F.col("p_")))
        found = here.groupBy(group, F.substring(key, at + 1, DIGITS).alias("d")).agg(F.count("*").alias("n")).collect()
        for g in list(open_):
            taken = state[g][1]
            for d, n in sorted((r.d, r.n) for r in found if r[group] == g):
                if taken <= n:
                    state[g] = [state[g][0] + d, taken] if taken < n else [state[g][0] + d + LAST, 0]
                    if n <= FEW or taken == n:
                        open_.discard(g)
                    break
                taken -= n
        at += DIGITS
    marked = own.join(F.broadcast(table()), group)
    prefix = F.substring(F.col(key), F.lit(1), F.length("p_"))
    below = marked.where(prefix < F.col("p_"))
    border = marked.where(prefix == F.col("p_")).withColumn("k_", F.row_number().over(Window.partitionBy(group).orderBy(key))).where("k_ <= n_").drop("k_")
    out = below.unionByName(border).drop("p_", "n_")
    return out if group in rows.columns else out.drop(group)


def running(rows: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None, **amounts: Column) -> DataFrame:
    """rows with, for each amount, its total over the rows before in the order (within the keys), this one not included.

    Rows are dealt by ranges of keys and order, so a key's rows are spread over parts; a part's totals are the base of the
    next. The order must be unique within the keys. Only the table of parts is ordered as a whole.
    """
    names = list(amounts)
    spread = rows.withColumns({f"{n}_": a for n, a in amounts.items()})
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    dealt = cut((spread.repartitionByRange(parts, *columns) if parts else spread.repartitionByRange(*columns)).withColumn("part_", F.spark_partition_id()))
    totals = dealt.groupBy("part_", *keys).agg(*[F.sum(f"{n}_").alias(f"{n}_") for n in names])
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part_", *keys, F.count("*").over(before).alias("parts_before_"), *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_base") for n in names])
    bases = bases.where("parts_before_ > 0").drop("parts_before_")
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"{n}_in": F.coalesce(F.sum(f"{n}_").over(inside), F.lit(0)) for n in names})
    out = _with_bases(out, bases, keys)
    return out.withColumns({n: F.col(f"{n}_in") + F.coalesce(f"{n}_base", F.lit(0)) for n in names}).drop("part_", *[f"{n}{s}" for n in names for s in ("_", "_in", "_base")])


def running_max(rows: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """rows with the largest value over the rows before in the order (within the keys), null for the first."""
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    dealt = cut(rows.withColumn("value_", value).repartitionByRange(*columns).withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part_", *keys).agg(F.max("value_").alias("most_")).select("part_", *keys, F.max("most_").over(before).alias("base_"))
    inside = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_bases(dealt.withColumn("in_", F.max("value_").over(inside)), bases.where("base_ is not null"), keys)
    return out.withColumn(name, F.greatest("in_", "base_")).drop("part_", "value_", "in_", "base_")


def _with_bases(rows: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the bases of their part and keys. A part goes on with one key of the parts before at most, so bases have a row a part and are broadcast."""
    own = ["part_", *keys]
    named = bases.withColumnsRenamed({c: f"{c}_of_base" for c in own})
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_base"))
    return rows.join(F.broadcast(named), same, "left").drop(*[f"{c}_of_base" for c in own])


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in a unique order within the keys."""
    return running(rows, keys, order, **{name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def midranks(rows: DataFrame, keys: list[str], value: str, name: str = "midrank") -> DataFrame:
    """rows with the average place of those with an equal value, the largest first; the distinct values are ordered, not the rows."""
    values = rows.groupBy(*keys, value).agg(F.count("*").alias("c_"))
    above = running(values, keys, [F.desc(value)], above_=F.col("c_"))
    return rows.join(above.select(*keys, value, (F.col("above_") + 1 + (F.col("c_") - 1) / 2).alias(name)), [*keys, value])
