"""Progressive removal against one removal after another."""

import random

import pytest

from trailgrain.operators import removal as R

GROUPS = "group long, cost long, base double, consistency double, redundancy string, previous long, mandatory boolean"


def slowly(groups, depends, budget, churn=None):
    """All utilities anew before each removal."""
    by, kept, stuck, used, out = {g[0]: g for g in groups}, {g[0] for g in groups}, set(), 0, []

    def utility(g):
        _, cost, base, cons, key, _, _ = by[g]
        shared = key is not None and sum(by[k][4] == key for k in kept) > 1
        return (base + 0.1 * cons - (0.02 if shared else 0.0)) / cost

    while sum(by[g][1] for g in kept) > budget:
        free = [g for g in kept if not by[g][6] and g not in stuck and not any(r == g and d in kept for d, r in depends)]
        if not free:
            break
        g = min(free, key=lambda g: (utility(g), g))
        if churn is not None and used + by[g][5] > churn:
            stuck.add(g)
            continue
        kept.discard(g)
        used += by[g][5]
        out.append(g)
    return kept, out, stuck


def case(seed, n=12):
    rng = random.Random(seed)
    groups = [(10 * i, rng.randint(1, 4), round(rng.random(), 2), round(rng.random(), 1), rng.choice([None, None, "k1", "k2"]), rng.randint(0, 2), rng.random() < 0.1) for i in range(n)]
    depends = [(10 * a, 10 * b) for a, b in (rng.sample(range(n), 2) for _ in range(4))]
    return groups, depends


@pytest.mark.parametrize(("seed", "budget", "churn"), [(1, 10, None), (3, 15, 3), (5, 0, 2)])
def test_removal(spark, seed, budget, churn):
    groups, depends = case(seed)
    got = R.progressive(spark.createDataFrame(groups, GROUPS).coalesce(2), spark.createDataFrame(depends, "dependent long, required long").coalesce(1), budget, churn).collect()
    kept, order, stuck = slowly(groups, depends, budget, churn)
    assert {r.group for r in got if r.kept} == kept
    assert [r.group for r in sorted((r for r in got if not r.kept), key=lambda r: r.place)] == order
    assert {r.group for r in got if r.reason == "churn"} == stuck
    assert all(r.reason == "protected" for r in got if r.group in {g[0] for g in groups if g[6]})
    assert all(r.reason is None and r.attempted for r in got if not r.kept)


def test_released_groups_go_in_turn(spark):
    """1 waits for 9, 2 and 3 for 1; what 9 releases goes before anything dearer than 9."""
    groups = [(1, 1, 0.1, 0.0, None, 0, False), (2, 1, 0.05, 0.0, None, 0, False), (3, 1, 0.2, 0.0, None, 0, False), (9, 1, 0.5, 0.0, None, 0, False), (10, 1, 0.6, 0.0, None, 0, False)]
    got = R.progressive(spark.createDataFrame(groups, GROUPS), spark.createDataFrame([(9, 1), (1, 2), (1, 3)], "dependent long, required long"), 1).collect()
    assert [r.group for r in sorted((r for r in got if not r.kept), key=lambda r: r.place)] == [9, 1, 2, 3]
    events = spark.createDataFrame([(i,) for i in range(6)], "edge_id long")
    found = R.atomic_groups(events, spark.createDataFrame([(5, 3), (3, 1)], "a long, b long")).collect()
    assert {r.edge_id: r.group for r in found} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4, 5: 1}
