"""Deduplicating operators against brute force on small tables with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from trailgrain.llm import arrays as A
from trailgrain.llm.ngram_join import near_duplicates
from trailgrain.llm.substring_dedup import FMIndex, substring_deduplicate
from trailgrain.llm.suffix_dedup import suffix_deduplicate
from trailgrain.llm.vector_dedup import multi_sequence, near_vectors

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType()), T.StructField("key", T.StringType()), T.StructField("tok", T.StringType())])


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "né", "ko", "ti", "ß"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    texts += [passage, passage, f"x {passage} y", f"{word()} {passage}", passage[:-20]]
    base = [word() for _ in range(150)]
    for k in range(12):
        near = list(base)
        near[(k * 7) % 150] = f"edit{k}"
        texts.append(" ".join(near))
    texts += ["", " \n\t", "one", "ONE", "two words", "a " * 300, "ab" * 400, "é" * 250, None, None, " ".join(word() for _ in range(4000))]
    texts += texts[:4]
    return [(i, t, "b", "k", "t") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def bytes_left(rows, length=100):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            gone |= set(range(p, p + length)) if w in seen else set()
            seen.add(w)
        left = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[d] = (len(raw), len(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1 << 22, 700])
def test_suffix_dedup(docs, shard):
    got = suffix_deduplicate(docs, shard=shard).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == bytes_left(ROWS)
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_substring_dedup(docs, shard):
    words = {d: (t or "").encode().split() for d, t, *_ in ROWS}
    counts = collections.Counter(tuple(w[p : p + 35]) for w in words.values() for p in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        gone = {i for p in range(len(w) - 34) if counts[tuple(w[p : p + 35])] > 1 for i in range(p, p + 35)}
        want[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_deduplicate(docs, shard=shard).collect()} == want


def groups(rows, percent=80):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().translate(low).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("hot", [64, 3, 1000])
def test_ngram_join(docs, monkeypatch, hot):
    import trailgrain.llm.ngram_join as N

    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "TILE_SHINGLES", 500)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == groups(ROWS)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", "", "", ""), (None, None, "", "", ""), (5, "a b c d e f", "", "", ""), (5, "a b c d e f", "", "", ""), (4, "A b c d e f", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted([tuple(r) for r in near_duplicates(docs).collect()], key=str)
    assert got == sorted([(None, 2, None), (None, 0, None), (5, 2, 4), (5, 2, 4), (4, 2, 4)], key=str)
    assert suffix_deduplicate(docs).count() == 5
    assert substring_deduplicate(docs).count() == 5


def test_one_id_with_two_texts_of_equal_size(spark):
    first, second = " ".join(f"a{i}" for i in range(16)), " ".join(f"b{i}" for i in range(16))
    rows = [(4, first), (5, first), (5, second), (9, second + " more"), (7, "quite another text of seven words here")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (5, 4), (5, 4), (7, 7), (9, 4)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == suffix_deduplicate(docs).count() == substring_deduplicate(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(vectors).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = rng.integers(0, 3, rng.integers(1, 150)).astype(np.uint8)
        sa, _ = A.suffix_array(s, 8)
        raw = bytes(s)
        assert list(sa) == sorted(range(len(s)), key=lambda i: raw[i:])
        lcp = A.common_prefixes(s, sa, 1000)
        for r in range(1, len(s)):
            x, y = raw[sa[r - 1] :], raw[sa[r] :]
            assert lcp[r] == next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


def test_matching_statistics():
    rng = np.random.default_rng(2)
    for _ in range(20):
        seq = np.append(rng.integers(1, 4, 60), 0)
        index = FMIndex(seq, 4, 20)
        text = rng.integers(1, 4, 30)
        got = index.matching_statistics(text, np.array([0]), np.array([30]), 2)
        raw = bytes(seq[:-1].astype(np.uint8))
        for i in range(30):
            k = 0
            while i + k < 30 and len(re.findall(b"(?=%s)" % re.escape(bytes(text[i : i + k + 1].astype(np.uint8))), raw)) >= 2:
                k += 1
            assert got[i] == k


def test_multi_sequence_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(5)
    want = sorted(range(35), key=lambda c: a[c // 5] + b[c % 5])
    assert multi_sequence(a, b, 35) == want


@pytest.mark.parametrize("part", [4096, 7])
def test_vectors(spark, part):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    near = np.repeat(base[:8], 6, 0) + rng.normal(scale=0.05, size=(48, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:1]]))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (None, rows[0][1], 0)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), recall=1.0, part=part).collect()}
    v = np.array([r[1] for r in rows[:n]] + [rows[0][1]], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = v @ v.T >= 0.9
    np.fill_diagonal(hit, False)
    found = sum(got[i].n_links for i in range(n))
    assert found >= 0.95 * hit[:n].sum()
    assert all(got[i].n_links <= hit[i].sum() for i in range(n))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, n + 4))
    assert got[None].component_id is None
    assert not got[None].kept
    assert got[0].component_id == 0


def test_calibration_sees_partners_outside_the_sample(spark, monkeypatch):
    import trailgrain.llm.vector_dedup as V

    monkeypatch.setattr(V, "CELL", 1)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 16))
    near = base + rng.normal(scale=0.38, size=base.shape)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample=64).agg({"n_links": "sum"}).first()[0]
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.9).sum() - len(v)
    assert want > 1000
    assert 0.99 * want <= got <= want


def test_parts_bound_guests_too(spark):
    from trailgrain.llm.vector_dedup import visits_by_part

    rows = [(i, 1, b"", 1, [1]) for i in range(5)] + [(100 + i, 1, b"", 2, [2, 1]) for i in range(3000)]
    placed = spark.createDataFrame(rows, "entry long, copies long, vector binary, home int, seen array<int>")
    found = visits_by_part(placed, 100).toPandas()
    sides = found.groupby(["cell", "r", "q", "resident"]).size()
    assert sides.max() <= 200
    met = found[found.cell == 1].merge(found[found.cell == 1], on=["r", "q"])
    assert (met.resident_x & ~met.resident_y).sum() == 5 * 3005


def test_exact_vectors(spark, monkeypatch):
    import trailgrain.llm.vector_dedup as V

    monkeypatch.setattr(V, "CELL", 2)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base + rng.normal(scale=0.36, size=base.shape)]).astype(np.float32))]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample=50, exact=True).collect()}
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.9).sum(1) - 1
    assert want.sum() > 100
    assert [got[i] for i in range(len(rows))] == want.tolist()
