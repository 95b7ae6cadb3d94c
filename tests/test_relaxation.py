"""Relaxation along time: stairs of nodes against a table kept round by round, and what a round moves."""

import random

import pytest
from pyspark.sql import functions as F

from trailgrain.operators import relaxation as R

STEPS, STARTS = "edge_id long, near string, far string, t long, f double", "node string, t long, value double, via long, root long"


def brute(steps, starts, largest, strict):
    """(value, via) of each event: all offers at a node are looked at again in every round, a better one replaces."""
    found = {}
    while True:
        offers = {}
        for n, t, v, via, _ in starts:
            offers.setdefault(n, []).append((t, -(1 << 62), v, via))
        for e, near, _, t, _ in steps:
            if e in found:
                offers.setdefault(near, []).append((t, e, found[e][0], e))
        new = {}
        for e, _, far, t, f in steps:
            seen = [(v if largest else -v, via is None, -(via or 0), v, via) for s, o, v, via in offers.get(far, []) if (s < t if strict else (s, o) < (t, e))]
            if seen:
                *_, v, via = max(seen)
                v = v * f
                if e not in found or (v > found[e][0] if largest else v < found[e][0]):
                    new[e] = (v, via)
        if not new:
            return found
        found |= new


@pytest.mark.parametrize(("largest", "strict"), [(True, True), (False, False)])
def test_stairs_equal_rounds_over_all_offers(spark, largest, strict):
    r = random.Random(7)
    steps = [(e, f"n{r.randrange(6)}", f"m{r.randrange(3)}" if e % 3 else f"n{r.randrange(6)}", r.randrange(400), r.choice([0.25, 0.5]) if largest else r.choice([2.0, 4.0])) for e in range(300)]
    starts = [(f"m{i % 3}" if i % 9 else "n0", r.randrange(200), float(1 + r.randrange(4)), None, None) for i in range(30)]
    got = {x.edge_id: (x.value, x.via) for x in R.relaxed(spark.createDataFrame(steps, STEPS), spark.createDataFrame(starts, STARTS), F.col("value") * F.col("f"), largest, strict).collect()}
    assert got == brute(steps, starts, largest, strict)


def test_a_long_stair_is_searched_by_pieces_and_events_are_not_sorted(spark, monkeypatch):
    """Each of 600 starts is better than those before; 2,000 events leave the hub and none of them enters a window."""
    sorted_, searched, raised, within = [], [], R.raised, R.within
    monkeypatch.setattr(R, "raised", lambda new, *a: (sorted_.append(new.count()), raised(new, *a))[1])
    monkeypatch.setattr(R, "within", lambda p, s, strict, most: (searched.append(most), within(p, s, strict, most))[1])
    starts = [("hub", 10 * i, float(i + 1), None, None) for i in range(600)]
    steps = [(e, f"leaf{e}", "hub", 3 * e + 1, 0.5) for e in range(2000)]
    got = {x.edge_id: x.value for x in R.relaxed(spark.createDataFrame(steps, STEPS), spark.createDataFrame(starts, STARTS), F.col("value") * F.col("f")).collect()}
    assert got == {e: 0.5 * min(600, (3 * e) // 10 + 1) for e in range(2000)}
    assert sorted_[0] == searched[0] == 600
