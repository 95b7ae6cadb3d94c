"""Similarities against the standard library and plain loops, and clusters against one walk over each process."""

import hashlib
import ipaddress
import random
import re

import pytest

from trailgrain.operators import behaviours as B


def plain_address(a, b):
    def host(v):
        v = (v or "").removeprefix("socket:")
        if v[:1] == "[" and "]" in v:
            return v[1 : v.index("]")]
        return v.split(":")[0] if v.count(":") == 1 and v.split(":")[1].isdigit() else v

    try:
        x, y = ipaddress.ip_address(host(a)), ipaddress.ip_address(host(b))
    except ValueError:
        return 0.0
    if x.version != y.version:
        return 0.0
    n = x.max_prefixlen
    same = [p == q for p, q in zip(f"{int(x):0{n}b}", f"{int(y):0{n}b}", strict=True)]
    return (same.index(False) if False in same else n) / n


def plain_path(a, b):
    a, b = ([p for p in re.split(r"[/\\]+", (v or "").lower()) if p] for v in (a, b))
    if not a or not b:
        return 0.0
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    most = max(len(a), len(b))
    return n / (max(1, most - 1) if 0 < n < most else most)


def test_addresses(spark):
    v = ["socket:10.0.3.17:443", "10.0.3.18", "10.1.0.0:80", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "[2001:db8::1]:443", "2001:db8::2", "2001:DB8:0:0:0:0:0:3", "fe80::1%eth0", "::ffff:10.0.0.1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7", "12345::", "::", "", None, "name", "host:1"]
    rows = spark.createDataFrame([(a, b) for a in v for b in v], "a string, b string").select("a", "b", B.address_similarity(B.F.col("a"), B.F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in rows} == pytest.approx({(a, b): plain_address(a, b) for a in v for b in v})


def test_paths_and_operations(spark):
    v = ["/home/a/x", "/home/a/y", "/HOME/a", "c:\\users\\a", "C:/Users/b", "/", "", None, "x", "/x/x"]
    rows = spark.createDataFrame([(a, b) for a in v for b in v], "a string, b string").select("a", "b", B.path_similarity(B.F.col("a"), B.F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in rows} == pytest.approx({(a, b): plain_path(a, b) for a in v for b in v})
    pairs = {("EVENT_READ", "EVENT_WRITE"): 1.0, ("EVENT_WRITE", "EVENT_READ"): 0.0, ("EVENT_RECVFROM", "event_write"): 1.0, ("EVENT_FORK", "fork"): 0.5, ("", None): 0.0, (None, None): 0.0}
    rows = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", B.operation_similarity(B.F.col("a"), B.F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in rows} == pairs


def plain_vector(label, counts, least, size):
    out = [0.0] * size
    for t in (x.lower() for x in re.findall("[A-Za-z0-9_.-]+", label)):
        if counts.get(t, 0) >= least:
            one = [0.0] * size
            for g in {f"^{t}$"[i : i + 3] for i in range(len(t))}:
                d = hashlib.blake2b(g.encode(), digest_size=8).digest()
                one[int.from_bytes(d[:4], "big") % size] += 1 if d[4] & 1 else -1
            norm = sum(x * x for x in one) ** 0.5
            out = [a + (b / norm if norm else 0) for a, b in zip(out, one, strict=True)]
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm if norm else 0.0 for x in out]


@pytest.mark.parametrize("least", [1, 2])
def test_labels(spark, least):
    labels = ["bash -c run", "bash", "bash -c run", "python run.py", "", "???", "a", "Bash"]
    counts = {}
    for x in labels:
        for t in re.findall("[A-Za-z0-9_.-]+", x):
            counts[t.lower()] = counts.get(t.lower(), 0) + 1
    asked = [("process", a, b) for a in [*set(labels), "new bash"] for b in [*set(labels), "never"]]
    rows = B.similarities(spark.createDataFrame(asked, "kind string, left string, right string"), spark.createDataFrame([(x,) for x in labels], "label string"), 16, least).collect()
    want = {(a, b): max(0.0, min(1.0, sum(x * y for x, y in zip(plain_vector(a, counts, least, 16), plain_vector(b, counts, least, 16), strict=True)))) for _, a, b in asked}
    assert {(r.left, r.right): r.similarity for r in rows} == pytest.approx(want)
    with pytest.raises(ValueError):
        B.label_vectors(spark.createDataFrame([], "label string"), spark.createDataFrame([], "label string"), 0)


EDGES = "edge_id long, src string, dst string, src_type string, dst_type string, src_label string, dst_label string, relation string, t long"


def test_clusters_and_features(spark):
    rng, kind = random.Random(4), {"p": "process", "f": "file", "s": "socket"}
    label = {"p0": "bash", "p1": "bash run", "p2": None, "f0": "/a/b", "f1": "/a/c", "s0": "10.0.0.1:80", "s1": "10.0.0.9:80"}
    events = []
    for i in range(60):
        s, d = (rng.choice(list(label)) for _ in range(2))
        events.append((i, s, d, kind[s[0]], kind[d[0]], label[s], label[d], rng.choice(["EVENT_READ", "EVENT_WRITE", "EVENT_FORK"]), rng.randrange(50) * B.SECOND * 5))
    frame = spark.createDataFrame(events, EDGES)
    own, number, member, feats = {}, 0, {}, {}
    for e in events:
        for n, other in {(e[1], e[2]), (e[2], e[1])}:
            if n[0] == "p":
                own.setdefault(n, []).append((e[8], e[0], other, e[7]))
    counts = {"bash": 2, "run": 1}
    for n in sorted(own):
        before = None
        for t, i, other, relation in sorted(own[n]):
            if before is None or t - before[0] > 10 * B.SECOND:
                number += 1
            member.setdefault(i, set()).add(number - 1)
            sim = op = 1.0
            if before:
                a, b = label[before[2]] or "", label[other] or ""
                sim = plain_path(a, b) if other[0] == "f" else plain_address(a, b) if other[0] == "s" else max(0.0, sum(x * y for x, y in zip(plain_vector(a, counts, 1, 32), plain_vector(b, counts, 1, 32), strict=True)))
                op = 1.0 if (before[3], relation) == ("EVENT_READ", "EVENT_WRITE") else 0.5 if before[3] == relation else 0.0
            feats[n, i] = ((t - min(own[n])[0]) / 10 / B.SECOND, 1 - sim, 1 - op)
            before = (t, i, other, relation)
    seq = B.sequences(frame)
    found = B.clusters(seq, 10)
    got = {}
    for r in found.collect():
        got.setdefault(r.edge_id, set()).add(r.cluster)
    assert got == member
    pois = spark.createDataFrame([(3,), (40,)], "edge_id long")
    hot = member.get(3, set()) | member.get(40, set())
    rows = {r.edge_id: (r.cluster, r.importance) for r in B.importance(frame, found, pois).collect()}
    assert rows == {e[0]: (min(member.get(e[0], [None])), float(e[0] in (3, 40) or bool(member.get(e[0], set()) & hot))) for e in events}
    known = spark.createDataFrame([(v,) for v in label.values()], "label string")
    rows = {(r.process, r.edge_id): (r.interval, r.object, r.operation) for r in B.features(seq, known, 10).collect()}
    assert set(rows) == set(feats)
    for k in feats:
        assert rows[k] == pytest.approx(feats[k], abs=1e-9)
    assert B.importance(frame.limit(0), B.clusters(B.sequences(frame.limit(0)), 10), pois.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        B.clusters(seq, 0)
