"""Alternative forks against a table kept event by event in time order."""

import random

import pytest
from pyspark.sql import functions as F

from trailgrain.operators import alternatives as A
from trailgrain.plans.diffusion import forked


def by_time(events, depth, k):
    """Labels of each event: (depth, parent, slot, pivot); events of one time do not see each other."""
    labels, at = {}, {}
    for t in sorted({e[3] for e in events}):
        now = [e for e in events if e[3] == t]
        for i, s, _, _ in now:
            own = [(depth[i], -1, -1, i)] if i in depth else []
            labels[i] = sorted([*own, *((d + 1, j, z, p) for d, j, z, p in at.get(s, []))])[:k]
        for i, s, d, _ in now:
            for z, (n, _, _, p) in enumerate(labels[i]):
                for node in {s, d} if p == i else {d}:
                    at.setdefault(node, []).append((n, i, z, p))
    return labels


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 2)])
def test_alternative_forks(spark, seed, k):
    rng = random.Random(seed)
    events = [(i, *(f"n{x}" for x in rng.sample(range(6), 2)), rng.randrange(9)) for i in range(26)]
    frame = spark.createDataFrame(events, "edge_id long, src string, dst string, t long").coalesce(1)
    pois = frame.where("edge_id in (3, 17)")
    unit = frame.withColumns({"cf": F.lit(1.0), "cb": F.lit(1.0)})
    found = spark.createDataFrame(forked(unit, pois, None).collect())
    chain = {r.edge_id: r.back for r in found.collect() if r.back is not None or r.edge_id in (3, 17)}

    def deep(i):
        return 0 if chain[i] is None else 1 + deep(chain[i])

    depth = {i: deep(i) for i in chain}
    back = spark.createDataFrame([(i, depth[i], chain[i]) for i in chain], "edge_id long, depth int, next long")
    labels = spark.createDataFrame(A.fork_labels(frame, back, k).collect(), A.LABEL)
    got = {}
    for r in labels.orderBy("edge_id", "slot").collect():
        got.setdefault(r.edge_id, []).append((r.depth, -1 if r.parent is None else r.parent, -1 if r.parent_slot is None else r.parent_slot, r.pivot))
    assert got == {i: v for i, v in by_time(events, depth, k).items() if v}
    rows = spark.createDataFrame(A.witnesses(labels, back, k).collect())
    sets = {}
    for r in rows.collect():
        sets.setdefault((r.anchor, r.slot), set()).add(r.edge_id)
    assert len({(a, tuple(sorted(s))) for (a, _), s in sets.items()}) == len(sets)
    assert {a for a, _ in sets} == set(got)
    assert A.witness_faults(rows, frame, pois).count() == 0
    broken = rows.withColumn("edge_id", F.when((F.col("part") == "back") & (F.col("position") == 0) & (F.col("anchor") == 3), 0).otherwise(F.col("edge_id")))
    assert A.witness_faults(broken, frame, pois).where("anchor = 3").count() >= 1
