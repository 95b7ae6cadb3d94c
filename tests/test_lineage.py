"""Execution lineage against a walk over creations in the order of time."""

import random

import pytest
from pyspark.sql import functions as F

from trailgrain.operators import lineage as L

S = L.SECOND


def walked(created, ended, roots, shells, b):
    born, gone = {}, {}
    for i, parent, child, t in sorted(created, key=lambda e: (e[3], e[0])):
        born.setdefault(child, (t, i, parent))
    for p, t in sorted(ended, key=lambda e: e[1]):
        if p in born and t >= born[p][0]:
            gone.setdefault(p, t)
    far, out = float("inf"), {}
    for r in sorted(set(roots) & set(born)):
        out[r] = ("root", r, 0, born[r][0], born[r][0] + b.lineage_s * S, [])
    for r in sorted(set(roots) & set(born)):
        t, i, parent = born[r]
        if parent in born and parent not in out and parent in shells and t < gone.get(parent, far) and 0 < t - born[parent][0] <= b.launcher_s * S:
            out[parent] = ("launcher", r, 0, born[parent][0], out[r][4], [born[parent][1], i])
    for child, (t, i, parent) in sorted(born.items(), key=lambda x: x[1][:2]):
        p = out.get(parent)
        if child in out or p is None or p[2] >= b.depth or t >= gone.get(parent, far) or not p[3] < t <= p[4]:
            continue
        out[child] = ("descendant", p[1], p[2] + 1, t, p[4], ([] if p[0] == "launcher" else p[5]) + [i])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lineage(spark, seed):
    rng, b = random.Random(seed), L.Bounds(depth=3, lineage_s=60, launcher_s=25)
    created = [(i, f"p{rng.randrange(30)}", f"p{rng.randrange(60)}", rng.randrange(100) * S) for i in range(70)]
    ended = [(f"p{rng.randrange(60)}", rng.randrange(100) * S) for _ in range(12)]
    roots, shells = [f"p{rng.randrange(60)}" for _ in range(12)], [f"p{k}" for k in range(0, 60, 2)]
    one = lambda v: spark.createDataFrame([(x,) for x in v], "process string")
    own = spark.createDataFrame(L.births(spark.createDataFrame(created, "edge_id long, parent string, process string, t long"), spark.createDataFrame(ended, "process string, t long")).collect(), "process string, parent string, event long, born long, gone long")
    want = walked(created, ended, roots, shells, b)
    rows = spark.createDataFrame(L.lineage(own, one(roots), one(shells), b).collect(), L.LINEAGE)
    got = {r.process: (r.kind, r.root, r.depth, r.since, r.expires, r.chain) for r in rows.collect()}
    assert got == want and rows.count() == len(want)
    assert L.lineage_faults(rows, own, one(roots), one(shells), b).isEmpty()
    kinds = {v[0] for v in want.values()}
    faults = lambda changed: {(r.process, r.fault) for r in L.lineage_faults(changed, own, one(roots), one(shells), b).collect()}
    for kind, fault in (("root", "root"), ("launcher", "launcher"), ("descendant", "target")):
        wrong = rows.withColumn("since", F.when(F.col("kind") == kind, F.col("since") + 1).otherwise(F.col("since")))
        assert {p for p, f in faults(wrong) if f == fault} == {p for p, v in want.items() if v[0] == kind}
    assert "descendant" in kinds
    early = faults(rows.withColumn("expires", F.col("expires") - 1))
    assert {p for p, f in early if f == "expiry"} == set(want)
    dead = own.withColumn("gone", F.col("born"))
    assert {p for p, f in {(r.process, r.fault) for r in L.lineage_faults(rows, dead, one(roots), one(shells), b).collect()} if f == "end"} == {p for p, v in want.items() if v[0] == "descendant"}


def test_chains_and_empty(spark):
    own = spark.createDataFrame([("c", "b", 3, 30, None), ("b", "a", 2, 20, None), ("a", "c", 1, 25, None), ("x", "x", 4, 5, None)], "process string, parent string, event long, born long, gone long")
    rows = L.execution_chains(own, own).collect()
    assert {(r.process, r.position, r.event) for r in rows} == {("c", 0, 3), ("c", 1, 2), ("b", 0, 2), ("a", 0, 1), ("x", 0, 4)}  # a is born after b: the chain ends
    assert {r.position for r in L.execution_chains(own, own, 1).collect()} == {0}
    none = own.limit(0)
    assert L.execution_chains(none, none).isEmpty() and L.lineage(none, none, none).isEmpty()
    assert L.lineage(own, none, own).isEmpty()
    with pytest.raises(ValueError):
        L.Bounds(depth=-1)
