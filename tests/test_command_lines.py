"""Command lines that name a file: the first executions after it, without pairs of executions and points of interest of a name."""

import random

from trailgrain.operators import continuation as C


def test_command_lines_take_the_next_executions_of_the_name(spark, monkeypatch):
    r = random.Random(5)
    host = lambda: r.choice(["h0", "h0", "h1", "", None])
    pois = [(i, "p1", f"f{i}", "EVENT_WRITE", r.randrange(300), host(), f"file:/home/*/doc{i % 2}") for i in range(200)]
    runs = [(1000 + i, r.randrange(300), host(), f"sh -c '/home/*/doc{i % 3}' doc{i % 2}") for i in range(400)]
    dealt, plain = [], C.O.running
    monkeypatch.setattr(C.O, "running", lambda rows, *a, **k: (dealt.append(rows.count()), plain(rows, *a, **k))[1])
    p = spark.createDataFrame(pois, "edge_id long, src string, dst string, relation string, timestamp_ns long, host string, dst_semantic string")
    e = spark.createDataFrame(runs, "edge_id long, timestamp_ns long, host string, command string")
    got = sorted(x.edge_id for x in C.command_line_executions(p, e, 40).collect())
    want = set()
    for _, _, _, _, t, h, key in pois:
        name = key.rsplit("/", 1)[1]
        near = sorted((at, i) for i, at, g, command in runs if f"/{name}'" in command or command.endswith(f" {name}"))
        hosts = {i: g for i, _, g, _ in runs}
        near = [x for x in near if t <= x[0] <= t + 40 and (not h or not hosts[x[1]] or h == hosts[x[1]])]
        want |= {i for _, i in near[:2]}
    assert got == sorted(want)
    assert len(dealt) == 1 and dealt[0] <= 2 * len(pois) + 2 * 2 * len(runs)
