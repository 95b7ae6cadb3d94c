"""Operators whose queries have no SQL, against brute force on small tables; and orders, selections and components at odd sizes."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trailgrain.operators import bundles as B
from trailgrain.operators import graph as G
from trailgrain.operators import ordered as O
from trailgrain.operators import relaxation as R
from trailgrain.operators import walks as W
from trailgrain.plans.diffusion import forked

EDGES = "edge_id long, src string, dst string, t long, cf double, cb double"


def random_edges(seed, n=40, nodes=7, times=15):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.sample(range(nodes), 2)
        out.append((i, f"n{a}", f"n{b}", rng.randrange(times), 1.0 + rng.randrange(3), 1.0 + rng.randrange(3)))
    return out


def brute_forks(edges, pois):
    """Least costs by repeated passes over all pairs of events, strictly in time."""
    by = {e[0]: e for e in edges}
    back = {i: 0.0 for i in pois}
    while True:
        changed = False
        for i, _, dst, t, _, cb in edges:
            if i in pois:
                continue
            offers = [v + cb for j, v in back.items() if by[j][3] > t and (by[j][1] == dst or (j in pois and by[j][2] == dst))]
            if offers and min(offers) < back.get(i, math.inf):
                back[i], changed = min(offers), True
        if not changed:
            break
    cost = dict(back)
    while True:
        changed = False
        for i, src, _, t, cf, _ in edges:
            offers = [v + cf for j, v in cost.items() if by[j][3] < t and by[j][2] == src] + [back[j] + cf for j in back if by[j][3] < t and by[j][1] == src]
            if offers and min(offers) < cost.get(i, math.inf):
                cost[i], changed = min(offers), True
        if not changed:
            return cost


@pytest.mark.parametrize("seed", [1, 2])
def test_forks_to_the_end(spark, seed):
    edges = random_edges(seed)
    pois = {3, 17}
    frame = spark.createDataFrame(edges, EDGES).coalesce(1)
    got = forked(frame, frame.where(F.col("edge_id").isin(*pois)), None).collect()
    assert {r.edge_id: r.cost for r in got} == brute_forks(edges, pois)
    by, point = {e[0]: e for e in edges}, {r.edge_id: r for r in got}
    for r in got:
        if r.parent is not None:
            assert by[r.parent][3] < by[r.edge_id][3]
            assert by[r.edge_id][1] in by[r.parent][1:3]
        if r.back is not None:
            assert by[r.back][3] > by[r.edge_id][3]
        assert point[r.pivot].pivot is not None
    members = {}
    for r in B.members(frame.select("edge_id").join(spark.createDataFrame([(x.edge_id,) for x in got], "edge_id long"), "edge_id"), spark.createDataFrame(got)).collect():
        members.setdefault(r.anchor, set()).add(r.member)
    for r in got:
        want, at = set(), r.edge_id
        while at is not None:
            want.add(at)
            at = point[at].parent
        at = r.pivot
        while at is not None:
            want.add(at)
            at = point[at].back
        assert members[r.edge_id] == want


def test_max_product_to_the_end(spark):
    edges = random_edges(5, 30)
    frame = spark.createDataFrame([(i, d, s, t, 0.9 / cf) for i, s, d, t, cf, _ in edges], "edge_id long, near string, far string, t long, f double").coalesce(1)
    starts = spark.createDataFrame([("n1", 2, 1.0, None, None)], "node string, t long, value double, via long, root long")
    got = {r.edge_id: r.value for r in R.relaxed(frame, starts, F.col("value") * F.col("f"), True, False).collect()}
    best, want = {}, {}
    for i, s, d, t, cf, _ in sorted(edges, key=lambda e: (e[3], e[0])):
        have = max(best.get(s, 0.0), 1.0 if s == "n1" and t >= 2 else 0.0)
        if have:
            want[i] = have * 0.9 / cf
            best[d] = max(best.get(d, 0.0), want[i])
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i]) for i in want)


def test_pagerank_and_heat_against_dense(spark):
    import numpy as np

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(8), 2))): rng.random() + 0.1 for _ in range(20)}
    channels = spark.createDataFrame([(f"{a}", f"{b}", "r", w) for (a, b), w in pairs.items()], "a string, b string, relation string, weight double").coalesce(1)
    m = np.zeros((8, 8))
    for (a, b), w in pairs.items():
        m[a, b] = m[b, a] = w
    p = (m / np.maximum(m.sum(1), 1e-300)[:, None]).T
    seed = np.zeros(8)
    first = next(iter(pairs))[0]
    seed[first] = 1
    seeds = spark.createDataFrame([(0, f"{first}", 1.0)], "seed int, node string, mass double")
    share = W.transition(channels)
    found, residual, _ = W.pagerank(share, seeds, tolerance=1e-9, rounds=200)
    want = np.linalg.solve(np.eye(8) - 0.85 * p, 0.15 * seed)
    assert residual <= 1e-9
    assert all(math.isclose(r.mass, want[int(r.node)], abs_tol=1e-8) for r in found.collect())
    values, vectors = np.linalg.eig(3.0 * (p - np.eye(8)))
    exact = (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors) @ seed).real
    got = {int(r.node): r.mass for r in W.heat(share, seeds, tolerance=1e-7).collect()}
    assert all(math.isclose(got[k], exact[k], abs_tol=1e-6) for k in got)


def test_walks_move_only_hubs(spark):
    """Nodes whose links are all to busier nodes are in no state; two hubs of different degree, a link between them, and a lone pair."""
    import numpy as np

    pairs = [("h0", f"n{k}") for k in range(12)] + [("h1", f"n{k}") for k in range(0, 12, 2)] + [("h0", "h1"), ("x", "y")]
    names = sorted({v for pair in pairs for v in pair})
    at = {v: k for k, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for k, (a, b) in enumerate(pairs):
        m[at[a], at[b]] = m[at[b], at[a]] = 1 + k % 3
    p = (m / m.sum(1)[:, None]).T
    share = W.transition(spark.createDataFrame([(a, b, "r", float(m[at[a], at[b]])) for a, b in pairs], "a string, b string, relation string, weight double").coalesce(1))
    seeds = spark.createDataFrame([(1, "n0", 0.5), (1, "h0", 0.5), (2, "x", 1.0), (3, "n1", 1.0)], "seed long, node string, mass double").coalesce(1)
    first = {s: np.zeros(len(names)) for s in (1, 2, 3)}
    for s, v, x in [(1, "n0", 0.5), (1, "h0", 0.5), (2, "x", 1.0), (3, "n1", 1.0)]:
        first[s][at[v]] = x
    w = W.walks(share, seeds)
    for rounds, tolerance in ((3, None), (200, 1e-9)):
        state, _, k = W.ranked(w, 0.15, rounds, tolerance)
        assert {r.node for r in state.hubs.collect()} <= {"h0", "h1", "y"}
        got = {(r.seed, r.node): r.mass for r in w.spread(state).collect()}
        for s, start in first.items():
            want = start
            for _ in range(3 if tolerance is None else 400):
                want = 0.85 * p @ want + 0.15 * start
            assert all(math.isclose(got.get((s, v), 0.0), want[at[v]], abs_tol=1e-8) for v in names)
        assert tolerance is None or k < 100  # 0.85 ** k alone is below 1e-9 from 128 on


def bundle_rows(seed, n=18):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({"case": "c", "anchor": i, "score": round(rng.random(), 2), "mandatory": i < 2, "families": [f"f{rng.randrange(4)}", f"g{rng.randrange(3)}"], "members": sorted({i, *rng.sample(range(n + 3), rng.randrange(4))})})
    return rows


def slow_greedy(rows, budget, gain):
    """The bundle of the largest gain at each step, all gains computed anew; one that does not fit is given up."""
    kept, best, left = {r["anchor"] for r in rows if r["mandatory"]}, {r["anchor"]: r for r in rows}, [r for r in rows if not r["mandatory"]]
    while left and len(kept) < budget:
        r = min(left, key=lambda r: (*[-v for v in gain(r, kept, best)], r["anchor"]))
        left.remove(r)
        if gain(r, kept, best)[0] <= 0 or r["anchor"] in kept:
            continue
        new = set(r["members"]) - kept
        if len(kept) + len(new) <= budget:
            kept |= new
    return kept


def gains(rows):
    weight = {}
    for r in rows:
        weight[r["families"][0]] = max(weight.get(r["families"][0], 0.0), r["score"])

    def coverage(r, kept, best):
        total = 0.0
        for k, f in enumerate(r["families"]):
            have = max((best[i]["score"] for i in kept & best.keys() if best[i]["families"][k] == f), default=0.0)
            total += max(r["score"] - have, 0.0)
        return (total / 2,)

    def mass(f, kept, best):
        return sum(best[i]["score"] for i in sorted(kept & best.keys()) if best[i]["families"][0] == f)

    def diminishing(r, kept, best):
        w = weight[r["families"][0]]
        return (0.05 * r["score"] + 0.95 * w * math.log1p(r["score"] / (w + mass(r["families"][0], kept, best))),)

    def evidence(r, kept, best):
        new, add = set(r["members"]) - kept, {}
        for i in new & best.keys():
            add[best[i]["families"][0]] = add.get(best[i]["families"][0], 0.0) + best[i]["score"]
        gain = sum(0.05 * d + 0.95 * weight[f] * math.log1p(d / (weight[f] + mass(f, kept, best))) for f, d in add.items() if d)
        return (round(gain / len(new), 12), round(gain, 12)) if new else (0.0, 0.0)

    return {"coverage": coverage, "diminishing": diminishing, "evidence": evidence, "order": lambda r, kept, best: (r["score"] + 1,)}


def as_tables(spark, rows):
    own = spark.createDataFrame([(r["case"], r["anchor"], r["score"], r["mandatory"], r["anchor"], *r["families"]) for r in rows], "case string, edge_id long, score double, mandatory boolean, pivot long, f string, g string").repartition(3)
    parts = spark.createDataFrame([(r["anchor"], m) for r in rows for m in r["members"]], "anchor long, member long").repartition(3)
    return own, parts


@pytest.mark.parametrize(("seed", "budget"), list(itertools.product([1, 2, 3, 4], [2, 5, 9, 18])))
def test_greedy_choices(seed, budget):
    """The streamed choices without Spark, their rows in the order of the bounds."""
    rows, slow = bundle_rows(seed), gains(bundle_rows(seed))
    weight = {}
    for r in rows:
        weight[r["families"][0]] = max(weight.get(r["families"][0], 0.0), r["score"])
    best = {r["anchor"]: r for r in rows}
    single = lambda s, w: 0.95 * w * math.log1p(s / w) + 0.05 * s if w else 0.0

    def stream(bound):
        out = []
        for r in rows:
            ids = [r["anchor"]] if r["mandatory"] else r["members"]
            members = [{"id": i, **({"score": best[i]["score"], "families": best[i]["families"], "weight": weight[best[i]["families"][0]]} if i in best else {"score": None, "families": None, "weight": None})} for i in ids]
            row = {**r, "weight": weight[r["families"][0]], "members": members}
            out.append({**row, "bound": bound(row)})
        return iter(sorted(out, key=lambda r: (not r["mandatory"], -r["bound"], r["anchor"])))

    kept = lambda ledger: {e for _, _, e, _ in ledger}
    assert kept(B.by_coverage(stream(lambda r: r["score"]), budget)) == slow_greedy(rows, budget, slow["coverage"])
    assert kept(B.diminishing(stream(lambda r: single(r["score"], r["weight"])), budget)) == slow_greedy(rows, budget, slow["diminishing"])
    most = lambda r: max(single(m["score"], m["weight"]) if m["score"] is not None else 0.0 for m in r["members"])
    assert kept(B.by_evidence(stream(most), budget)) == slow_greedy(rows, budget, slow["evidence"])


@pytest.mark.parametrize("seed", [5, 6])
def test_packing_of_all_anchors(spark, seed):
    """More than a thousand anchors, two cases, budgets that are met exactly, early and never."""
    rng = random.Random(seed)
    rows = []
    for case, n in (("a", 1200), ("b", 300)):
        base = 0 if case == "a" else 10_000
        for i in range(n):
            path = {base + i} | {base + rng.randrange(n + 50) for _ in range(rng.choice([0, 1, 1, 2, 30]))}
            rows.append({"case": case, "anchor": base + i, "score": round(rng.random(), 2) + 0.01, "mandatory": i < 5, "families": ["f", "g"], "members": sorted(path)})
    own, parts = as_tables(spark, rows)
    for limits in ({"a": 400, "b": 200}, {"a": 5, "b": 100_000}):
        got = B.packed(own, parts, spark.createDataFrame(list(limits.items()), "case string, budget long")).collect()
        for case, budget in limits.items():
            mine = [r for r in rows if r["case"] == case]
            assert {r.edge_id for r in got if r.case == case} == slow_greedy(mine, budget, gains(mine)["order"])


def test_streamed_choice_and_its_audit(spark):
    from trailgrain.operators import audits as A

    rows = bundle_rows(8, 30)
    more = [{**r, "case": "d", "anchor": r["anchor"] + 1000, "members": [m + 1000 for m in r["members"]]} for r in bundle_rows(9, 25)]
    own, parts = as_tables(spark, rows + more)
    limits = spark.createDataFrame([("c", 12), ("d", 7)], "case string, budget long")
    bundles = B.bundled(own, parts, ["f", "g"], B.evidence_bound())
    ledger = spark.createDataFrame(B.streamed(bundles, limits, B.by_evidence).collect(), B.LEDGER)
    for case, budget, mine in (("c", 12, rows), ("d", 7, more)):
        assert {r.edge_id for r in ledger.collect() if r.case == case} == slow_greedy(mine, budget, gains(mine)["evidence"])
    assert all(r["rows"] == 0 for r in A.faults(own, parts, ledger, limits, "f").collect())
    broken = ledger.where("step <> 1").unionByName(ledger.where("step = 2").limit(1).withColumn("edge_id", F.lit(77).cast("long"))).withColumn("gain", F.when(F.col("step") == 3, 9.0).otherwise(F.col("gain")))
    found = {r.fault: r["rows"] for r in A.faults(own, parts, broken, spark.createDataFrame([("c", 3), ("d", 100)], "case string, budget long"), "f").collect()}
    assert found["members differ"] >= 1
    assert found["gain differs"] >= 1
    assert found["budget exceeded"] == 1
    assert {r.fault: r["rows"] for r in A.faults(own, parts, ledger.where("step > 0"), limits, "f").collect()}["mandatory event missing"] == 4
    value = {r.case: r for r in A.objective(own, ledger, "f").collect()}
    assert all(0 < value[c].attained <= value[c].upper + 1e-9 for c in "cd")
    reasons = {r.edge_id: r.reason for r in A.reasons(own.select("case", "edge_id"), own, parts, ledger, limits).collect()}
    assert reasons[0] == reasons[1001] == "mandatory"
    assert "left out" not in reasons.values()
    for name, bound in (("diminishing", B.diminishing_bound()), ("by_coverage", F.col("score"))):
        got = B.streamed(B.bundled(own, parts, ["f", "g"], bound), limits, getattr(B, name)).collect()
        assert {r.edge_id for r in got if r.case == "c"} == slow_greedy(rows, 12, gains(rows)["coverage" if name == "by_coverage" else name])


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_smallest_keys(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    rng = random.Random(few)
    rows = [(g, f"{rng.randrange(50):03d}{rng.randrange(1 << 40):010x}{i:04d}") for i in range(600) for g in ("a", "b")[: 1 + (i % 3 > 0)]]
    frame = spark.createDataFrame(rows, "g string, key string").coalesce(1)
    sizes = {"a": 123, "b": 10_000, "c": 5}
    got = O.smallest(frame, "key", spark.createDataFrame(list(sizes.items()), "g string, size long"), "g").collect()
    for g, n in sizes.items():
        assert sorted(r.key for r in got if r.g == g) == sorted(k for h, k in rows if h == g)[:n]


def test_running_totals_over_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), i, rng.randrange(100)) for i in range(500)]
    got = O.running(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], parts=7, before=F.col("v")).collect()
    assert all(r.before == sum(v for k, i, v in rows if k == r.k and i < r.i) for r in got)
    assert len(got) == 500


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(100) if i != 60] + [(200, 200), (300, 250)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 61 for i in range(61, 101)}, 200: 200, 300: 250, 250: 250}
    reached = G.followed(spark.createDataFrame([(5,)], "edge_id long"), spark.createDataFrame([(i, i + 1) for i in range(40)], "edge_id long, next long").coalesce(1))
    assert {r.edge_id for r in reached.collect()} == set(range(5, 41))


def test_impact_to_the_tolerance(spark):
    """Against a dense solve: scores of the given ends are 1, others the weighted sum of what they lead to."""
    import numpy as np

    rng = random.Random(12)
    pairs = {tuple(rng.sample(range(7), 2)) for _ in range(18)}
    out = {a: sum(1 for x, _ in pairs if x == a) for a, _ in pairs}
    edges = spark.createDataFrame([(i, f"{a}", f"{b}", 0.9 / out[a]) for i, (a, b) in enumerate(sorted(pairs))], "edge_id long, src string, dst string, w double").coalesce(1)
    given = sorted(pairs)[4]
    got = {int(r.node): r.score for r in G.dependency_impact(edges, edges.where("edge_id = 4"), "w", rounds=2000, tolerance=1e-8).collect()}
    m, b = np.eye(7), np.zeros(7)
    for a, to in pairs:
        if a not in given:
            m[a, to] -= 0.9 / out[a]
    for g in given:
        b[g] = 1
    want = np.linalg.solve(m, b)
    assert all(math.isclose(got.get(k, 0.0), want[k], abs_tol=1e-6) for k in range(7))
    with pytest.raises(RuntimeError, match="settle"):
        G.dependency_impact(edges, edges.where("edge_id = 4"), "w", rounds=1, tolerance=1e-12)


def test_contrast_in_chunks_of_seeds_and_blocks(spark, monkeypatch, mix=0.5):
    """Seeds in several vectors and links in several blocks give what a walk for each seed gives; no row for each event and seed is made."""
    import numpy as np

    monkeypatch.setattr(W, "WIDTH", 4)
    monkeypatch.setattr(W, "BLOCKS", 3)
    rng = random.Random(5)
    ends = [tuple(f"n{x}" for x in rng.sample(range(9), 2)) for _ in range(40)] + [(f"n{x}", f"n{(x + 1) % 9}") for x in range(9)]
    events = [(i, a, b, rng.choice([0.2, 0.7])) for i, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(events, "edge_id long, src string, dst string, rarity double").coalesce(1)
    m = np.zeros((9, 9))
    channels = {}
    for _, a, b, r in events:
        channels[tuple(sorted((a, b)))] = max(r, channels.get(tuple(sorted((a, b))), 0))
    for (a, b), r in channels.items():
        m[int(a[1]), int(b[1])] = m[int(b[1]), int(a[1])] = r
    p = (m / m.sum(1)[:, None]).T

    def walk(seed):
        now = seed
        for _ in range(3):
            now = 0.85 * p @ now + 0.15 * seed
        return now

    q, best = walk(np.full(9, 1 / 9)), {i: [0.0, 0.0, {}] for i, *_ in events}
    for s in range(0, 40, 6):
        x = walk(sum(0.5 * np.eye(9)[int(v[1])] for v in ends[s]))
        lift = np.log1p(np.maximum(x / q - 1, 0))
        at = [(int(a[1]), int(b[1]), 0.2 + 0.8 * r) for _, a, b, r in events]
        local = np.array([((1 - mix) * math.sqrt(lift[a] * lift[b]) + mix * (lift[a] + lift[b]) / 2) * w for a, b, w in at])
        plain = np.array([math.sqrt(x[a] * x[b]) * w for a, b, w in at])
        for i in range(len(events)):
            best[i][0] = max(best[i][0], local[i] / local.max())
            best[i][2][s] = local[i] / local.max()
            best[i][1] = max(best[i][1], plain[i] / plain.max())
    share = W.transition(spark.createDataFrame([(a, b, "r", r) for (a, b), r in channels.items()], "a string, b string, relation string, weight double").coalesce(1))
    pois, nodes = edges.where("edge_id % 6 = 0 and edge_id < 40"), spark.createDataFrame([(f"n{k}",) for k in range(9)], "node string").coalesce(1)
    got = {r.edge_id: r for r in W.contrast(edges, share, pois, nodes, 0.2, 0.1, 3, mix).collect()}
    assert got.keys() == best.keys()
    for i, (local, plain, seeds) in best.items():
        score = 1.0 if i % 6 == 0 and i < 40 else (local + 0.1 * plain) / 1.1
        assert math.isclose(got[i].score, score, abs_tol=1e-9)
        assert math.isclose(seeds[got[i].winner], local, abs_tol=1e-9) if local > 0 else got[i].winner is None
