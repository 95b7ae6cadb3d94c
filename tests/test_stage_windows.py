"""Ways between stages: an event meets the pairs whose window it is in, not all of them."""

import random

from trailgrain.operators import bridges as B
from trailgrain.plans import prunings


def case(spark, n=240):
    r = random.Random(5)
    rows = [(i, f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice(["EVENT_READ", "EVENT_WRITE", "EVENT_FORK"]), r.randrange(n // 2), r.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "edge_id long, src string, dst string, relation string, timestamp_ns long, score double")


def test_windows_that_overlap_and_share_starts(spark, monkeypatch):
    rows, edges = case(spark)
    at = sorted((t, e) for e, *_, t, _ in rows)
    pick = lambda k: at[k][1]
    pairs = [("a", pick(3), pick(60)), ("b", pick(20), pick(90)), ("c", pick(20), pick(41)), ("d", pick(80), pick(30)), ("e", pick(70), 9999), ("f", pick(100), pick(101)), ("g", pick(150), pick(239))]
    plans, cut = [], B.cut
    for module in (B, B.O):  # the orders cut their rows, too
        monkeypatch.setattr(module, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    state, ways = B.stage_paths(edges, spark.createDataFrame(pairs, "pair string, start long, target long"))
    assert plans and not any("NestedLoop" in p for p in plans)
    state, ways = {r.pair: r.status for r in state.collect()}, sorted(map(tuple, ways.select("pair", "position", "edge_id").collect()))
    assert (state["d"], state["e"]) == ("backwards", "absent")
    for p in pairs:
        one, way = B.stage_paths(edges, spark.createDataFrame([p], "pair string, start long, target long"))
        assert one.first().status == state[p[0]]
        assert sorted(map(tuple, way.select("pair", "position", "edge_id").collect())) == [w for w in ways if w[0] == p[0]]
    assert any(state[p] == "connected" for p in "abcfg")


def test_stages_do_not_pair_points_of_a_host(spark, monkeypatch):
    dealt, ranked = [], prunings.O.ranked
    monkeypatch.setattr(prunings.O, "ranked", lambda rows, *a, **k: (dealt.append(rows.count()), ranked(rows, *a, **k))[1])
    rows = [(997 * i, "h0" if i % 3 else "h1", i * 7 % 5, "p1", "p2", "process") for i in range(40)]
    edges = spark.createDataFrame(rows, "edge_id long, host string, timestamp_ns long, src string, dst string, src_type string")
    found = prunings.stages(edges)
    assert dealt == [40]
    want = [(h, e, k) for h in ("h0", "h1") for k, (_, e) in enumerate(sorted((t, e) for e, x, t, *_ in rows if x == h))]
    assert sorted((r.sequence, r.edge_id, r.position) for r in found.collect()) == sorted(want)
