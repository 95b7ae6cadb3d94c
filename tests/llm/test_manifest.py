"""Exact copies by block names, Merkle manifest and clusters by exact integer distances, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from trailgrain.llm import block_names as B
from trailgrain.llm import centroids as C
from trailgrain.llm import merkle as M

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("name", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("level", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("n", T.StringType()),
])


def corpus():
    rng = random.Random(11)
    long = "".join(rng.choice("abcé\n") for _ in range(9000))
    texts = ["", None, "a", "a", "b", "x" * 1024, "x" * 1025, "x" * 2048, "x" * 2048, "x" * 3072, long, long, long[:-1], long + "!", "é" * 512, "é" * 513]
    texts += ["hot"] * 60 + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(40)]
    rows = [(k, rng.choice([None, "s1", "s2"]), rng.choice(["de", "en", None]), rng.choice([None, 3, 70]), t, "r", "n", "p", "l", "t", "m") for k, t in enumerate(texts)]
    return [*rows, *rows[:3], (None, None, None, None, None, *"rnpltm"), (None, "s1", "en", 1, "hot", *"rnpltm"), (7, "s", "en", 1, "other text of 7", *"rnpltm")]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def copies(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[4] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "buckets", "hot"), [(1024, 1 << 20, 1000), (2, 1, 0), (3, 7, 2)])
def test_copies(docs, monkeypatch, block, buckets, hot):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "BUCKETS", buckets)  # with one bucket all hashes collide
    monkeypatch.setattr(B, "HOT", hot)
    rows = docs if block > 9 else docs.where("coalesce(length(text), 0) < 100")
    want = ROWS if block > 9 else [r for r in ROWS if len(r[4] or "") < 100]
    assert sorted([tuple(r) for r in B.name_copies(rows).collect()], key=str) == copies(want)


def test_copies_of_nothing(docs):
    assert B.name_copies(docs.limit(0)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests, fanout):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, k, fanout):
    for level in levels[:-1]:
        g = k // fanout * fanout
        yield k - g, [d for j, d in enumerate(level[g : g + fanout], g) if j != k]
        k //= fanout


def leaf_of(doc, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def manifest_rows(rows, fanout):
    by = collections.defaultdict(list)
    for doc, source, lang, n, text, *_ in rows:
        hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        by[lang].append((doc, leaf_of(doc, source, lang, n, text), leaf_of(doc, source, lang, n + 1, text) if hit else None))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree([r[1] for r in by[lang]], fanout)
    top = tree([trees[lang][-1][0] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        for i, (doc, leaf, other) in enumerate(by[lang]):
            path = [*way(trees[lang], i, fanout), *way(top, k, fanout)]
            now = other or leaf
            for place, others in path:
                now = h(*others[:place], now, *others[place:])
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], h(*[d for _, o in path for d in o]), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "chunk", "width"), [(2, M.CHUNK, M.WIDTH), (2, 5, 2), (3, 4, 3)])
def test_manifest(docs, fanout, chunk, width):
    got = sorted([tuple(r) for r in M.manifest(docs, fanout, chunk, width).collect()], key=str)
    assert got == manifest_rows(ROWS, fanout)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_little(docs):
    assert M.manifest(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 9")
    assert [tuple(r) for r in M.manifest(one).collect()] == manifest_rows([r for r in ROWS if r[0] == 9], 2)


@pytest.mark.parametrize(("size", "fanout"), [(n, f) for n in (1, 2, 3, 7, 8, 9, 30, 64, 65) for f in (2, 3, 5)])
def test_peaks(size, fanout):
    """Stacks over runs of any length, merged, hold every node of the tree once; asked() names what a run lacks."""
    rng = random.Random(size)
    leaves = [h(str(k)) for k in range(size)]
    want = {(level, k): d for level, row in enumerate(tree(leaves, fanout)) for k, d in enumerate(row)}
    borders = sorted({0, size, *(rng.randrange(size) for _ in range(3))})
    parts, nodes, left = list(zip(borders, borders[1:], strict=False)), {}, []
    for a, b in parts:
        s = M.Peaks(fanout)
        for k in range(a, b):
            s.push(0, k, leaves[k])
        left += s.peaks
    whole = M.Peaks(fanout, size)
    for p in left:
        whole.push(*p)
    for level, k, d in [*left, *whole.born]:
        nodes[level, k] = d
    assert nodes.items() <= want.items()
    assert len(whole.peaks) == 1
    for a, b in parts:
        outside = {k: nodes[k] for k in M.asked(a, b - a, size, fanout)}
        got = list(M.siblings(a, leaves[a:b], size, fanout, outside))
        assert got == [list(way(tree(leaves, fanout), k, fanout)) for k in range(a, b)]


def test_node_records(spark):
    leaves = spark.createDataFrame([("t", k, h(str(k)), None) for k in range(23)], "tree string, id long, leaf string, other string").repartition(4)
    got = {(r.level, r.idx): r.digest for r in M.node_records(leaves, ["id"], 2, 3, 2).collect()}
    assert got == {(level, k): d for level, row in enumerate(tree([h(str(k)) for k in range(23)], 2)) for k, d in enumerate(row)}


def clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    for t in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]
        if t < rounds:
            for j in range(len(at)):
                own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
                at[j] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else at[j]
    sums = collections.Counter()
    for d, j in near:
        sums[j] += d
    return sorted([(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near, strict=True)], key=str)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("cluster", T.StringType()), T.StructField("x", T.StringType())])


@pytest.mark.parametrize(("n", "k", "dims"), [(300, 40, 64), (7, 40, 64), (120, 5, 11)])
def test_clusters(spark, n, k, dims):
    rng = random.Random(n)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(middles)]) for i in range(n)]
    rows += [(500, None), (501, [1.0] * (dims - 1)), (502, [float("nan")] * dims), (503, [1.0] * (dims - 1) + [float("-inf")]), (504, [None] * dims), (505, []), (506, [0.0] * dims), (507, [-0.001] * dims)]
    rows += [rows[0], rows[0], (1, rows[2][1]), (None, rows[3][1])] + [(600 + i, [0.5] * dims) for i in range(n // 3)]
    df = spark.createDataFrame([(*r, "v", "c", "x") for r in rows], VECTORS).repartition(3)
    got = sorted([tuple(r) for r in C.cluster(df, k=k, dims=dims).collect()], key=str)
    assert got == clusters(rows, k, 5, dims)


def test_clusters_of_nothing(spark):
    assert C.cluster(spark.createDataFrame([(1, None, "v", "c", "x")], VECTORS)).count() == 0


def test_screening():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 64)) * rng.uniform(10, 3000, size=(12, 8)).repeat(8, axis=1)
    v = np.floor(middles[rng.integers(0, 12, 800)] + rng.normal(size=(800, 64)) * 20).astype(np.int64)
    c = np.concatenate([np.floor(middles).astype(np.int64), v[:20], v[:3]])
    d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(2)
    best, least, done = C.nearest(v, C.norms(v), c)
    assert (best == d.argmin(1)).all()
    assert (least == d.min(1)).all()
    assert done < d.size / 4
