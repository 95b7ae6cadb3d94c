"""Bridges, stage paths and pruning of atomic groups against going through the events one by one."""

import itertools
import random

import pytest

from trailgrain.operators import bridges as B
from trailgrain.operators import pruning as P

EDGES = "edge_id long, src string, dst string, relation string, timestamp_ns long, score double"
EVENTS = "case string, edge_id long, `group` long, score double, mandatory boolean, previous boolean, escape double"


def graph(seed, n=24, nodes=7):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(100), n):
        a, b = rng.sample(range(nodes), 2)
        rows.append((i, f"n{a}", f"n{b}", rng.choice(["EVENT_WRITE", "EVENT_EXECUTE", "EVENT_READ"]), rng.randrange(15), rng.choice([0.0, 0.25, 0.5, 0.75, 1.0])))
    return rows


def at(e):
    return e[4], e[0]


def cost(e):
    return max(1e-9, 1.0 - e[5])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bridges(spark, seed):
    rows = graph(seed)
    goals = {r[0] for r in rows[:2]}

    def ways(e):
        """Every way from e to a target: its cost, summed from the end, and its events."""
        out = []
        for f in rows:
            if at(f) <= at(e):
                continue
            if f[0] in goals and e[2] in f[1:3]:
                out.append((0.0, ()))
            elif f[0] not in goals and f[1] == e[2]:
                out += [(cost(f) + c, (f[0], *way)) for c, way in ways(f)]
        return out

    want = {r[0]: min(ways(r)) for r in rows if r[0] not in goals and ways(r)} | {g: (0.0, ()) for g in goals}
    found = B.bridges(spark.createDataFrame(rows, EDGES).coalesce(2), spark.createDataFrame([(g,) for g in goals], "edge_id long")).cache()
    assert {r.edge_id for r in found.collect()} == set(want)
    got = {e: [] for e in want}
    for r in sorted(B.bridge_events(found).collect(), key=lambda r: r.position):
        got[r.edge_id].append(r.bridge)
    assert {e: tuple(w) for e, w in got.items()} == {e: w for e, (_, w) in want.items()}
    assert B.bridges(spark.createDataFrame([], EDGES), spark.createDataFrame([(1,)], "edge_id long")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_stage_paths(spark, seed):
    rows = sorted(graph(seed, 30, 6), key=at)
    by = {r[0]: r for r in rows}
    ends = lambda e: (e[2], e[1]) if e[3] == "EVENT_EXECUTE" else (e[1], e[2])
    anchor = lambda e: e[2] if e[3] == "EVENT_READ" else e[1]
    chosen = [rows[k][0] for k in (0, 14, 29)]
    sequences = [("a", 0, chosen[0]), ("a", 1, chosen[1]), ("a", 2, chosen[2]), ("b", 0, rows[20][0]), ("b", 1, rows[3][0]), ("c", 0, rows[5][0]), ("c", 1, 1000)]
    state, ways = B.stage_paths(spark.createDataFrame(rows, EDGES).coalesce(2), B.stage_pairs(spark.createDataFrame(sequences, "sequence string, position int, edge_id long")))
    state, ways = {r.pair: r for r in state.collect()}, ways.collect()
    assert state["b|0"].status == "backwards" and state["c|0"].status == "absent" and set(state) == {"a|0", "a|1", "b|0", "c|0"}
    for pair in ("a|0", "a|1"):
        one, two = by[state[pair].start], by[state[pair].target]
        starts, goals = {ends(one)[1], anchor(one)}, {ends(two)[0], anchor(two)}
        inside = [r for r in rows if at(one) < at(r) < at(two)]
        found = []

        def walk(node, since, spent, way, inside=inside, goals=goals, found=found):
            if node in goals:
                found.append((spent, way))
            for r in inside:
                if ends(r)[0] == node and at(r) > since:
                    walk(ends(r)[1], at(r), spent + cost(r), (*way, r[0]))

        for node in starts:
            walk(node, at(one), 0.0, ())
        way = tuple(r.edge_id for r in sorted((r for r in ways if r.pair == pair), key=lambda r: r.position))
        assert state[pair].status == ("connected" if found else "disconnected")
        assert (way in {w for _, w in found}) if found else way == ()
        if found:
            assert sum(cost(by[e]) for e in way) == pytest.approx(min(found)[0])
    with pytest.raises(ValueError):
        B.stage_pairs(spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "sequence string, position int, edge_id long"))


def best_overlap(sizes, capacity, least):
    """Every subset: the largest sum, and the smallest of `least` or more."""
    sums = {sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)}
    sums = {s for s in sums if s <= capacity}
    return max(sums), min((s for s in sums if s >= min(least, max(sums))))


def test_subset():
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(0, 8))]
        capacity, least = rng.randint(0, 25), rng.randint(0, 20)
        counts = sorted((s, sizes.count(s)) for s in set(sizes))
        largest, taken = P.subset(counts, capacity, least)
        most, target = best_overlap(sizes, max(0, capacity), least)
        assert largest == most and sum(s * n for s, n in taken.items()) == target
        assert all(n <= dict(counts)[s] for s, n in taken.items())


def case(seed, n=26):
    """Events in groups, bridges between them."""
    rng = random.Random(seed)
    heads = sorted(rng.sample(range(n), n // 2) + [0])
    events = []
    for i in range(n):
        group = i if i in heads else rng.choice([h for h in heads if h <= i])
        events.append((f"c{seed}", i + 1000 * seed, group + 1000 * seed, rng.choice([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), rng.random() < 0.06, rng.random() < 0.3, rng.choice([None, None, 0.1, 0.7, 0.9])))
    first = {e[2]: min(x[1] for x in events if x[2] == e[2]) for e in events}
    events = [(c, e, first[g], *rest) for c, e, g, *rest in events]
    links = [(e[1], rng.choice(events)[1]) for e in events for _ in range(rng.choice([0, 0, 1, 2]))]
    return events, links


def slowly(events, links, ratio, mode, positive=False, slack=None, share=0.0, threshold=0.0):
    """One group after another, with sets of groups."""
    size, top, claim, prior, needs = {}, {}, {}, set(), {}
    of = {e[1]: e[2] for e in events}
    for _, e, g, score, _, previous, escape in events:
        size[g], top[g] = size.get(g, 0) + 1, max(top.get(g, 0.0), score)
        if escape is not None and escape >= threshold:
            claim.setdefault(g, []).append(escape)
        if previous and slack is not None:
            prior.add(g)
    for e, b in links:
        needs.setdefault(of[e], set()).add(of[b])
    n, weight = len(events), lambda gs: sum(size[g] for g in gs)
    budget = max(1, int(n * ratio))
    ranks = sorted(size, key=lambda g: (-top[g] / size[g], -top[g], g))
    kept = {e[2] for e in events if e[4]}
    kept |= {m for g in kept for m in needs.get(g, ())}
    required = weight(kept)
    out = {"required": required, "budget": budget}

    def offer(g):
        return ({g} | needs.get(g, set())) - kept

    if slack is not None:
        total, overlap = weight(prior), weight(kept & prior)
        loss = min(total, max(0, total - budget) + required - overlap + -int(-slack * budget // 1))
        atomic = 0
        if required <= budget:
            open_ = sorted(prior - kept)
            lacking = max(0, total - loss - overlap)
            counts = sorted((s, sum(size[g] == s for g in open_)) for s in {size[g] for g in open_})
            largest, taken = P.subset(counts, budget - required, lacking)
            atomic = max(0, lacking - largest)
            plan = {g for s, k in taken.items() for g in [g for g in open_ if size[g] == s][:k]}
            for g in ranks:
                if weight(kept & prior) >= total - min(total, loss + atomic):
                    break
                if g in plan and g not in kept and weight(kept | offer(g)) <= budget:
                    kept |= offer(g)
        out |= {"declared_loss": loss, "atomic_loss": atomic}
    if claim and share > 0:
        quota, used = max(1, int(budget * share)), 0
        for g in sorted(claim, key=lambda g: (-max(claim[g]), g)):
            if g not in kept and weight(kept | offer(g)) <= budget and used + len(claim[g]) <= quota:
                kept |= offer(g)
                used += len(claim[g])
        out |= {"quota": quota, "escaped": used}
    turns, seen = n, 0
    if mode == "adaptive":
        turns = max(1, -int(-len(ranks) * ratio // 1))
        gaps = [top[a] - top[b] for a, b in itertools.pairwise(ranks)]
        if gaps and max(gaps) > 1e-12:
            turns = max(turns, gaps.index(max(gaps)) + 1)
    for g in ranks:
        if g in kept:
            continue
        if (positive and top[g] <= 0) or seen >= turns:
            break
        seen += 1
        if weight(kept | offer(g)) <= budget:
            kept |= offer(g)
        elif mode != "rdp_guard":
            break
    return {e[1] for e in events if e[2] in kept}, out


@pytest.mark.parametrize(("mode", "ratio", "options"), [
    ("ratio", 0.5, {}),
    ("ratio", 0.7, {"positive": True, "slack": 0.1}),
    ("adaptive", 0.4, {"share": 0.2, "threshold": 0.5}),
    ("rdp_guard", 0.3, {}),
    ("rdp_guard", 0.6, {"slack": 0.0, "share": 0.3, "threshold": 0.5}),
])
def test_pruned(spark, mode, ratio, options):
    cases = [case(s) for s in range(1, 7)]
    events, links = [e for c in cases for e in c[0]], [x for c in cases for x in c[1]]
    kept, account = P.pruned(
        spark.createDataFrame(events, EVENTS).coalesce(2), spark.createDataFrame(links, "edge_id long, bridge long").coalesce(2), ratio, mode, options.get("positive", False), options.get("slack"), options.get("share", 0.0), options.get("threshold", 0.0)
    )
    kept, account = kept.collect(), {r["case"]: r.asDict() for r in account.collect()}
    for own, between in cases:
        name = own[0][0]
        want, figures = slowly(own, between, ratio, mode, **options)
        assert {r.edge_id for r in kept if r["case"] == name} == want
        assert account[name] | figures == account[name]
        assert account[name]["kept"] == len(want) and account[name]["events"] == len(own)
        assert account[name]["churn_holds"] or not account[name]["feasible"] or account[name]["required"] > 0


def test_progressive_mode(spark):
    events, links = case(3)
    tables = spark.createDataFrame(events, EVENTS), spark.createDataFrame(links, "edge_id long, bridge long")
    kept, account = P.pruned(*tables, 0.5, "progressive", positive_only=True, churn_slack=0.5)
    kept, account = {r.edge_id: r for r in kept.collect()}, account.first()
    of = {e[1]: e[2] for e in events}
    groups = {r.group for r in kept.values()}
    assert all(of[b] in groups for e, b in links if of[e] in groups and kept[e].reason != "bridge")
    assert {e for e, g in of.items() if g in groups} == set(kept) and account.kept == len(kept)
    assert {e[1] for e in events if e[4]} <= set(kept)
    with pytest.raises(ValueError):
        P.pruned(spark.createDataFrame([*events, *case(4)[0]], EVENTS), tables[1], 0.5, "progressive")


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "edge_id long, bridge long")
    for mode in P.MODES:
        kept, account = P.pruned(spark.createDataFrame([], EVENTS), none, 0.5, mode, churn_slack=0.1)
        assert kept.count() == account.count() == 0
    kept, account = P.pruned(spark.createDataFrame([("c", 1, 1, None, None, None, None)], EVENTS), none, 0.1)
    assert [r.edge_id for r in kept.collect()] == [1] and account.first().budget == 1


def test_certificates(spark):
    account = spark.createDataFrame([(c, c != "d") for c in "abcdefg"], "case string, feasible boolean")
    pois = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("c", 5), ("d", 6), ("e", 7), ("e", 8), ("f", 9), ("f", 10)], "case string, edge_id long")
    kept = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)], "edge_id long")
    pairs = "case string, sequence string, pair string, status string"
    before = spark.createDataFrame([("b", "s", "s|0", "connected"), ("e", "s", "s|0", "connected"), ("e", "t", "t|0", "disconnected")], pairs)
    after = spark.createDataFrame([("b", "s", "s|0", "connected"), ("e", "s", "s|0", "connected"), ("e", "t", "t|0", "disconnected")], pairs)
    got = {r["case"]: r.status for r in P.certificates(account, pois, kept, before, after).collect()}
    assert got == {"a": "poi_only", "b": "valid", "c": "missing_poi", "d": "budget_infeasible", "e": "candidate_disconnected", "f": "unordered_multi_poi", "g": "missing_poi"}
