"""Fits by sufficient statistics: two Gaussians on log scores, and two means with the direction that parts them.

A round is one aggregate over the distinct values; only its sums, a few numbers, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import cut

LEAST_VARIANCE, LEAST_ROWS = 1e-4, 10


@dataclass(frozen=True)
class Mixture:
    """status: fitted, abstained by BIC, or abstained for too little variation; means, variances and weights of log scores, the first component first."""

    status: str
    means: tuple[float, ...] = ()
    variances: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    bic_one: float = math.nan
    bic_two: float = math.nan
    rounds: int = 0


def _log_density(x: Column, k: int, m: Mixture) -> Column:
    return math.log(m.weights[k]) - 0.5 * (math.log(2 * math.pi * m.variances[k]) + (x - m.means[k]) ** 2 / m.variances[k])


def _norm(x: Column, m: Mixture) -> Column:
    a, b = _log_density(x, 0, m), _log_density(x, 1, m)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def quantiles(values: DataFrame, shares: list[float]) -> list[float]:
    """Interpolated quantiles of distinct values (x, c) with counts; the values are ordered in parts."""
    placed = cut(O.running(values, [], ["x"], before=F.col("c")))
    n = values.agg(F.sum("c")).first()[0]
    ranks = {k: share * (n - 1) for k, share in enumerate(shares)}
    want = sorted({r for v in ranks.values() for r in (math.floor(v), math.ceil(v))})
    at = F.array(*[F.lit(w).cast("long") for w in want])
    hit = placed.select("x", F.explode(F.filter(at, lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("c")))).alias("rank"))
    found = {r["rank"]: r.x for r in hit.collect()}  # two for each share
    return [found[math.floor(v)] + (v - math.floor(v)) * (found[math.ceil(v)] - found[math.floor(v)]) for v in ranks.values()]


def fit_mixture(scores: DataFrame, rounds: int = 60) -> Mixture:
    """Two Gaussians on the logarithms of the positive scores (score), or an abstention where one fits as well."""
    bad = scores.where("score is null or isnan(score) or score < 0 or score = double('infinity')").limit(1).count()
    if bad:
        raise ValueError("scores must be finite and nonnegative")
    values = cut(scores.where("score > 0").groupBy(F.log(F.col("score").cast("double")).alias("x")).agg(F.count("*").alias("c")))
    c, x = F.col("c"), F.col("x")
    whole = values.agg(F.sum("c").alias("n"), (F.sum(c * x) / F.sum("c")).alias("mean")).first()
    n, mean = whole.n or 0, whole["mean"] or 0.0
    variance = (values.agg(F.sum(c * (x - mean) ** 2)).first()[0] or 0.0) / max(n, 1)
    if n < LEAST_ROWS or math.sqrt(variance) < 1e-8:
        return Mixture("abstained: too little variation")
    m = Mixture("", tuple(quantiles(values, [0.25, 0.75])), (max(variance, LEAST_VARIANCE),) * 2, (0.5, 0.5))
    last = -math.inf
    for k in range(1, rounds + 1):
        norm = _norm(x, m)
        parts = [F.exp(_log_density(x, i, m) - norm) * c for i in range(2)]
        sums = values.agg(F.sum(norm * c).alias("l"), *[F.sum(p * (x - mean) ** q).alias(f"s{i}{q}") for i, p in enumerate(parts) for q in range(3)]).first()
        likelihood = sums.l
        if abs(likelihood - last) <= 1e-7 * max(1.0, abs(likelihood)):
            break
        last = likelihood
        counts = [max(sums[f"s{i}0"], 1e-8) for i in range(2)]
        near = [sums[f"s{i}1"] / counts[i] for i in range(2)]
        spread = [max((sums[f"s{i}2"] - 2 * near[i] * sums[f"s{i}1"] + near[i] ** 2 * sums[f"s{i}0"]) / counts[i], LEAST_VARIANCE) for i in range(2)]
        m = Mixture("", tuple(mean + d for d in near), tuple(spread), tuple(v / sum(counts) for v in counts))
    likelihood = values.agg(F.sum(_norm(x, m) * c)).first()[0]
    one = 2 * math.log(n) + n * (math.log(2 * math.pi * variance) + 1)
    two = 5 * math.log(n) - 2 * likelihood
    return Mixture("fitted" if two < one else "abstained by BIC", m.means, m.variances, m.weights, one, two, k)


def membership(rows: DataFrame, m: Mixture) -> DataFrame:
    """rows with `membership` of their score in the high component: 0 below the middle of the means, for zero scores and where the fit abstained."""
    if m.status != "fitted":
        return rows.withColumn("membership", F.lit(0.0))
    x = F.log(F.when(F.col("score") > 0, F.col("score").cast("double")))
    high = 0 if m.means[0] > m.means[1] else 1
    value = F.when(x >= sum(m.means) / 2, F.exp(_log_density(x, high, m) - _norm(x, m)))
    return rows.withColumn("membership", F.coalesce(value, F.lit(0.0)))


def scaled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features by minimum and maximum in [0, 1]; missing values are the median of the known ones first, a constant feature is 0.5."""
    fills = {}
    for f in features:
        known = cut(rows.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))).groupBy(F.col(f).cast("double").alias("x")).agg(F.count("*").alias("c")))
        fills[f] = 0.0 if known.isEmpty() else quantiles(known, [0.5])[0]
    filled = rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(fills[f])), F.lit(fills[f])) for f in features})
    ends = filled.agg(*[F.min(f).alias(f"least_{f}") for f in features], *[F.max(f).alias(f"most_{f}") for f in features]).first()
    out = {}
    for f in features:
        low, high = ends[f"least_{f}"], ends[f"most_{f}"]
        out[f] = F.lit(0.5) if low is None or high <= low else (F.col(f) - low) / (high - low)
    return filled.withColumns(out)


def two_means(points: DataFrame, features: list[str], key: str, restarts: int = 20, seed: int = 7, rounds: int = 100) -> np.ndarray | None:
    """The two centres of least inertia (2 x features) over seeded starts, or None where all points are equal; all starts share a round's aggregate.

    A start is a row by hash, and a second one with a chance in proportion to the squared distance from it.
    """
    d = len(features)
    square = lambda centre: sum(((F.col(f) - float(v)) ** 2 for f, v in zip(features, centre, strict=True)), F.lit(0.0))
    unit = lambda s: (F.pmod(F.xxhash64(F.lit(s), F.col(key)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    pick = lambda columns: points.agg(*columns).first()
    firsts = pick([F.max_by(F.array(*features), F.struct(unit(f"{seed}:{r}"), F.col(key))).alias(f"r{r}") for r in range(restarts)])
    if firsts[0] is None:
        return None
    starts = [np.array(firsts[r]) for r in range(restarts)]
    race = [F.when(square(a) > 0, F.struct((F.log(unit(f"{seed}:{r}:second")) / square(a)).alias("u"), F.array(*features).alias("x"))) for r, a in enumerate(starts)]
    seconds = pick([F.max(c).alias(f"r{r}") for r, c in enumerate(race)])
    centres = {r: np.array([a, seconds[r].x]) for r, a in enumerate(starts) if seconds[r] is not None}
    if not centres:
        return None
    open_, inertia = set(centres), {}
    for _ in range(rounds):
        if not open_:
            break
        columns = []
        for r in sorted(open_):
            second = square(centres[r][1]) < square(centres[r][0])
            for k in (0, 1):
                own = second if k else ~second
                columns += [F.count(F.when(own, 1)).alias(f"n{r}_{k}"), *[F.sum(F.when(own, F.col(f))).alias(f"s{r}_{k}_{j}") for j, f in enumerate(features)]]
            columns.append(F.sum(F.least(square(centres[r][0]), square(centres[r][1]))).alias(f"i{r}"))
        sums = pick(columns)
        for r in sorted(open_):
            if not sums[f"n{r}_0"] or not sums[f"n{r}_1"]:
                open_.discard(r)
                inertia.pop(r, None)
                continue
            new = np.array([[sums[f"s{r}_{k}_{j}"] / sums[f"n{r}_{k}"] for j in range(d)] for k in (0, 1)])
            inertia[r] = sums[f"i{r}"]
            if np.allclose(new, centres[r], rtol=0, atol=1e-12):
                open_.discard(r)
            centres[r] = new
    return centres[min(inertia, key=lambda r: (inertia[r], r))] if inertia else None


def projection(points: DataFrame, features: list[str], key: str, restarts: int = 20, seed: int = 7) -> np.ndarray:
    """The unit direction of Fisher's discriminant from the larger of two clusters to the smaller (of equal ones to that of the larger mean sum); constant features get 0."""
    ends = points.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features]).first()
    active = [f for f in features if ends[f] is not None and ends[f] > 1e-12]
    out = np.zeros(len(features))
    if not active:
        return out
    centres = two_means(points, active, key, restarts, seed)
    even = np.full(len(active), 1.0 / len(active))
    out[[features.index(f) for f in active]] = even if centres is None else _direction(points, active, centres, even)
    return out


def _direction(points: DataFrame, features: list[str], centres: np.ndarray, even: np.ndarray) -> np.ndarray:
    d = len(features)
    square = lambda c: sum(((F.col(f) - float(v)) ** 2 for f, v in zip(features, c, strict=True)), F.lit(0.0))
    second = square(centres[1]) < square(centres[0])
    shifted = [F.col(f) - F.when(second, float(centres[1][j])).otherwise(float(centres[0][j])) for j, f in enumerate(features)]
    columns = [F.count(F.when(second if k else ~second, 1)).alias(f"n{k}") for k in (0, 1)]
    columns += [F.sum(F.when(second if k else ~second, shifted[j])).alias(f"s{k}_{j}") for k in (0, 1) for j in range(d)]
    columns += [F.sum(shifted[i] * shifted[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    sums = points.agg(*columns).first()
    n = [sums["n0"], sums["n1"]]
    mean = [np.array([sums[f"s{k}_{j}"] / n[k] for j in range(d)]) for k in (0, 1)]
    within = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - sum(n[k] * np.outer(mean[k], mean[k]) for k in (0, 1))
    own = [centres[k] + mean[k] for k in (0, 1)]
    critical = (0 if n[0] < n[1] else 1) if n[0] != n[1] else (0 if own[0].sum() >= own[1].sum() else 1)
    direction = np.linalg.pinv(within + np.eye(d) * 1e-6) @ (own[critical] - own[1 - critical])
    size = float(np.linalg.norm(direction))
    return direction / size if size > 0 else even
