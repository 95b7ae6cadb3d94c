"""PageRank under edits against a dense solve, and the snapshots of a stream."""

import math

import numpy as np
import pytest

from trailgrain.operators import dynamic as D

NAMES = [f"n{k}" for k in range(6)]


def dense(weights, seeds, restart=0.5):
    m = np.zeros((6, 6))
    for (a, b), w in weights.items():
        m[a, b] = m[b, a] = w
    for k in range(6):
        if m[k].sum() == 0:
            m[k, k] = 1
    p = m / m.sum(1)[:, None]
    s = np.zeros(6)
    for k, v in seeds.items():
        s[k] = v
    return np.linalg.solve(np.eye(6) - (1 - restart) * p.T, restart * s / s.sum())


def edits(spark, rows):
    return spark.createDataFrame([(NAMES[a], NAMES[b], float(w)) for a, b, w in rows], "a string, b string, weight double").coalesce(1)


def test_rank_under_edits(spark):
    """Insert, reweight, delete, a self-loop, a node left without edges, and other seeds; each solve starts from the one before."""
    rank, weights, seeds = D.empty(spark, 0.5), {}, {0: 1.0}
    rank = D.with_seeds(rank, spark.createDataFrame([("n0", 2.0)], D.SEEDS))
    pushes = []
    for step in ([(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 1)], [(1, 2, 0.5), (2, 3, 0), (5, 5, 3), (0, 5, 1)], [(3, 4, 0), (0, 1, 1)]):
        rank = D.with_edits(rank, edits(spark, step))
        for a, b, w in step:
            weights[a, b] = w
        weights = {k: v for k, v in weights.items() if v}
        if (3, 4) not in weights:
            seeds = {1: 1.0, 3: 3.0}
            rank = D.with_seeds(rank, spark.createDataFrame([("n1", 1.0), ("n3", 3.0)], D.SEEDS))
        rank, bound, n = D.solved(rank, 1e-3)
        pushes.append(n)
        want = dense(weights, seeds)
        got = {r.node: r.estimate for r in rank.values.collect()}
        assert bound <= 1e-3
        assert sum(abs(got.get(NAMES[k], 0.0) - want[k]) for k in range(6)) <= bound + 1e-12
    assert D.solved(rank, 1e-3)[2] == 0  # nothing changed, nothing is pushed


def test_refused_edits(spark):
    with pytest.raises(ValueError, match="finite"):
        D.with_edits(D.empty(spark), edits(spark, [(0, 1, -1)]))
    with pytest.raises(ValueError, match="zero"):
        D.with_seeds(D.empty(spark), spark.createDataFrame([("n0", 0.0)], D.SEEDS))
    rank = D.with_edits(D.with_seeds(D.empty(spark), spark.createDataFrame([("n0", 1.0)], D.SEEDS)), edits(spark, [(0, 1, 1), (1, 2, 2)]))
    _, bound, _ = D.solved(rank, 1e-6, rounds=1)
    assert bound > 1e-6  # stopped early, and says so
    assert math.isfinite(bound)


def stream_rows(spark):
    """A ring of three nodes at times 0, 1, .., one event late and one repeated, declarations before and between."""
    from trailgrain.streaming import snapshots as S

    rows = [(0, "node", "n0", "process", None, None, None, None, None)]
    times = [0, 1, 2, 3, 4, 2, 6, 7]
    for i, t in enumerate(times):
        rows.append((10 * i + 1, "edge", None, None, f"e{i}", f"n{i % 3}", f"n{(i + 1) % 3}", "EVENT_WRITE", t))
    rows += [(35, "node", "n1", "file", None, None, None, None, None), (72, "edge", None, None, "e7", "n1", "n2", "EVENT_WRITE", 7)]
    return S, spark.createDataFrame(rows, S.ROWS).coalesce(1)


def test_snapshots(spark, tmp_path):
    """The window of five keeps one event; types hold for later events only; three batches end where one does."""
    S, rows = stream_rows(spark)
    alerts = spark.createDataFrame([("e6",)], "event_id string")
    last = []
    for name, cuts in (("one", [(0, 1000)]), ("two", [(0, 45), (45, 1000)])):
        s = S.Snapshots(spark, str(tmp_path / name), alerts, window=5, budget=0.2, restart=0.5, tolerance=1e-2)
        for k, (a, b) in enumerate(cuts):
            s.step(rows.where(f"seq >= {a} and seq < {b}"), k)
        reports = {r.batch: r for r in s.reports().collect()}
        end = reports[len(cuts) - 1]
        assert (end.status, end.seen, end.hot, end.active, end.late, end.alerts, end.cap, end.kept) == ("ready", 8, 5, 5, 1, 1, 1, 1)
        assert end.bound <= 1e-2
        last.append({r.event_id: r for r in s.decisions(len(cuts) - 1).collect()})
        assert [i for i, r in last[-1].items() if r.retained] == ["e6"]
        if len(cuts) == 2:
            assert reports[0].status == "waiting for an alert"
            assert all(r.retained is None for r in s.decisions(0).collect())
            before = s.decisions(1).collect()
            s.step(rows.where("seq >= 45"), 1)  # a batch that runs again
            assert sorted(s.decisions(1).collect()) == sorted(before)
    assert last[0].keys() == last[1].keys() == {"e3", "e4", "e5", "e6", "e7"}
    assert all(abs(last[0][i].score - last[1][i].score) < 0.1 and last[0][i].rarity == last[1][i].rarity for i in last[0])
    count = {}
    types = {"n0": "process"}
    for i in range(8):
        if i == 4:
            types["n1"] = "file"
        pattern = (types.get(f"n{i % 3}", "unknown"), types.get(f"n{(i + 1) % 3}", "unknown"))
        if f"e{i}" in last[0]:
            assert math.isclose(last[0][f"e{i}"].rarity, math.log((i + 2) / (count.get(pattern, 0) + 1)) / math.log(i + 2))
        count[pattern] = count.get(pattern, 0) + 1


def test_history_of_alerts(spark, tmp_path):
    """Endpoints outlive the window and bring back what touched them; more alerts than the budget leave all undecided."""
    S, rows = stream_rows(spark)
    s = S.Snapshots(spark, str(tmp_path), spark.createDataFrame([("e0",), ("e6",), ("e7",)], "event_id string"), window=2, budget=0.5, hops=1, restart=0.5, tolerance=1e-2)
    s.step(rows, 0)
    report = s.reports().first()
    assert (report.status, report.hot, report.active, report.alerts, report.cap) == ("infeasible: more alerts than the budget", 2, 8, 3, 1)
    assert all(r.retained is None for r in s.decisions(0).collect())
