"""Queries at a hub: rows grow with the events, not with pairs of events and points of interest."""

from trailgrain.plans import metrics, pages, windows
from trailgrain.plans.continuations import STEP
from trailgrain.plans.scores import POI


def hub(spark, step):
    """A hundred marked events among 900 others at one node, some at equal times."""
    rows = [(i * step if i < 100 else 1_000_000_007 * i, "f1", (i * 37 % 500) * metrics.DAY // 8) for i in range(1000)]
    rows = [(e + 1 if i >= 100 and e % step == 0 else e, d, t) for i, (e, d, t) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "edge_id long, dst string, timestamp_ns long")


def spied(monkeypatch, module, name):
    dealt, plain = [], getattr(module.O, name)
    monkeypatch.setattr(module.O, name, lambda rows, *a, **k: (dealt.append(rows.count()), plain(rows, *a, **k))[1])
    return dealt


def test_nearest_events_do_not_pair_a_hub(spark, monkeypatch):
    rows, edges = hub(spark, POI)
    dealt = spied(monkeypatch, windows, "ranked")
    found = sorted((r.poi, r.k, r.edge_id) for r in windows.nearest_events(edges).collect())
    want = []
    for p, _, t in rows:
        if p % POI == 0:
            near = sorted((abs(x - t), e) for e, _, x in rows if e != p)[:3]
            want += [(p, k, e) for k, (_, e) in enumerate(near, 1)]
    assert found == sorted(want)
    assert len(dealt) == 1 and dealt[0] <= 1000


def test_duplicate_assignments_do_not_pair_a_hub(spark, monkeypatch):
    rows, edges = hub(spark, STEP)
    dealt = spied(monkeypatch, metrics, "running")
    found = {r.edge_id: r.groups for r in metrics.duplicate_assignments(edges).collect()}
    marked = [t for e, _, t in rows if e % STEP == 0]
    want = {e: sum(abs(x - t) <= 5 * metrics.DAY for x in marked) for e, _, t in rows}
    assert found == {e: n for e, n in want.items() if n > 1}
    assert dealt == [2 * 1000 + len(marked)]


def test_reference_actors_do_not_pair_events_and_references(spark, monkeypatch):
    hour = 3_600_000_000_000
    rows = [(i * STEP if i % 7 == 0 else 1_000_003 * (i + 1) * STEP + 1, "h0", 0, f"k{i % 2}", f"p{i // 40}", (i * 13 % 900) * hour // 40 * 3) for i in range(900)]
    edges = spark.createDataFrame(rows, "edge_id long, host string, day int, src_semantic string, src string, timestamp_ns long")
    dealt = spied(monkeypatch, pages, "running_max")
    found = {r.ref: r.actor for r in pages.reference_actors(edges).collect()}
    want = {}
    for e, _, _, k, _, t in rows:
        if e % STEP == 0:
            met = {r[4] for r in rows if r[3] == k and abs(r[5] - t - hour) <= 4 * hour}
            if len(met) == 1:
                want[e] = met.pop()
    assert found == want
    assert len(dealt) == 2 and max(dealt) <= 900 + sum(e % STEP == 0 for e, *_ in rows)
