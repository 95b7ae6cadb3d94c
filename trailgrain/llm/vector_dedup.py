"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells; a vector lives in the cell of its nearest
codewords. A vector visits cells in the order of the multi-sequence algorithm, nearest first, as many as sampled vectors
need to meet the target share of their partners in the whole table, and is compared there in double precision with the residents. Equal
vectors are one entry with a count; cells with many residents or many visitors are split into parts. A part counts links and
returns links that span its groups, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.arrays import spanning
from trailgrain.llm.shared import components, partitions, small_batches, stored

SAMPLE, PART, CELL = 8192, 4096, 48
QUERIES, ENOUGH, BLOCKS = 2048, 512, 8  # vectors of a calibration block, how many must have partners, blocks at most
ENTRY = "key binary, vec_id long"


def unit(raw: np.ndarray) -> np.ndarray | None:
    """The vector in double precision at length 1, or None if it is zero or not finite."""
    v = raw.astype(np.float64)
    top = np.abs(v).max() if len(v) else 0.0
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a spread start, fixed by a seed."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def multi_sequence(first: np.ndarray, second: np.ndarray, cells: int) -> list[int]:
    """The cells (i * len(second) + j) of the smallest first[i] + second[j], in that order."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, seen, out = [(x[0] + y[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(y) + int(b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (x[p] + y[q], p, q))
    return out


def distances(v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    return tuple((c * c).sum(1) - 2 * x @ c.T for c, x in zip(books, (v[:, :half], v[:, half:]), strict=True))


def ranks_of(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """The how-manieth of the cells that one vector visits these are."""
    d1, d2 = distances(v[None, :], books)
    sums = (d1[0][:, None] + d2[0][None, :]).ravel()
    return np.searchsorted(np.sort(sums), sums[cells], "right")


def homes(v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    d1, d2 = distances(v, books)
    return np.argmin(d1, 1) * len(books[1]) + np.argmin(d2, 1)


def needed(ranks: np.ndarray, weights: np.ndarray, recall: float) -> int:
    """The least rank by which this share of the weights is reached."""
    order = np.argsort(ranks)
    share = np.cumsum(weights[order]) / weights.sum()
    return int(ranks[order][min(np.searchsorted(share, recall), len(ranks) - 1)])


def at_threshold(v: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector one in a random direction that just links with it."""
    if v.shape[1] < 2 or threshold >= 1:
        return v
    side = np.random.default_rng(7).normal(size=v.shape)
    side -= (side * v).sum(1)[:, None] * v
    cosine = max(threshold, -1.0)
    return cosine * v + np.sqrt(1 - cosine * cosine) * side / np.sqrt((side * side).sum(1))[:, None]


def calibrate(entries: DataFrame, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> int:
    """How many cells a vector must visit, so that on average the sampled queries find this share of their partners.

    Queries are blocks of entries in hash order, each compared with all entries, until ENOUGH of them have partners or all
    entries have been queries. Where partners are too rare for that in BLOCKS blocks, the queries also look for made-up
    partners at the threshold, and the larger number counts.
    """
    spark = entries.sparkSession
    ranks, weights, last, queries = [], [], None, []
    for _ in range(BLOCKS):
        rest = entries if last is None else entries.where(F.col("entry") > last)
        block = rest.select("entry", "key").orderBy("entry").limit(QUERIES).collect()
        if block:
            last = block[-1].entry
            queries = [unit(np.frombuffer(bytes(r.key), np.float64)) for r in block]
            found = _partners(entries, [r.entry for r in block], np.stack(queries), books, threshold)
            ranks += [r["rank"] for r in found]
            weights += [r["weight"] for r in found]
        if len(block) < QUERIES:
            return max(4, needed(np.array(ranks), np.array(weights), recall)) if ranks else 4
        if sum(weights) >= ENOUGH:
            return max(4, needed(np.array(ranks), np.array(weights), recall))
    v = np.stack(queries[:ENOUGH])
    made = np.concatenate([ranks_of(x, books, c) for x, c in zip(v, homes(at_threshold(v, threshold), books)[:, None], strict=True)])
    return max(4, needed(made, np.ones(len(made)), recall), needed(np.array(ranks), np.array(weights), recall) if ranks else 4)


def _partners(entries: DataFrame, names: list[int], queries: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float) -> list:
    """Ranks of the cells in which partners of the queries live; a query's partners weigh 1 together."""
    shared = entries.sparkSession.sparkContext.broadcast((np.array(names), queries, books))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, books = shared.value
        for b in batches:
            keys, entry = b.column("key").to_pylist(), b.column("entry").to_numpy()
            for i in range(0, len(keys), 1024):
                v = np.stack([unit(np.frombuffer(x, np.float64)) for x in keys[i : i + 1024]])
                x, y = np.nonzero(v @ queries.T >= threshold)
                other = entry[i + x] != names[y]
                x, y = x[other], y[other]
                used, at = np.unique(x, return_inverse=True)
                cell = homes(v[used], books)[at] if len(used) else np.zeros(0, np.int64)
                pairs, n = np.unique(np.stack([y, cell]), axis=1, return_counts=True)
                yield pa.record_batch([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["query", "cell", "n"])

    def rank(t: pa.Table) -> pa.Table:
        _, queries, books = shared.value
        n = t.column("n").to_numpy()
        ranks = ranks_of(queries[t.column("query")[0].as_py()], books, t.column("cell").to_numpy())
        return pa.table({"rank": pa.array(ranks.astype(np.int64)), "weight": pa.array(n / n.sum())})

    hits = entries.select("entry", "key").mapInArrow(cross, "query int, cell int, n long").groupBy("query", "cell").agg(F.sum("n").alias("n"))
    return hits.groupBy("query").applyInArrow(rank, "rank long, weight double").groupBy("rank").agg(F.sum("weight").alias("weight")).collect()


def cells_within(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], limit: float) -> list[np.ndarray]:
    """For each vector all cells that can hold a vector within this squared distance, its home first.

    A resident is no farther from its codewords than their radius, so by the triangle inequality in each half.
    """
    half = books[0].shape[1]
    gaps = []
    for d, c, r, x in zip(distances(v, books), books, radii, (v[:, :half], v[:, half:]), strict=True):
        away = np.sqrt(np.maximum(d + (x * x).sum(1)[:, None], 0)) - r - 1e-9
        gaps.append(np.where(r[None, :] < 0, np.inf, np.maximum(away, 0) ** 2))
    out = []
    for a, b, home in zip(*gaps, homes(v, books), strict=True):
        order = np.argsort(b)
        n = np.searchsorted(b[order], limit + 1e-9 - a, "right")
        i = np.repeat(np.arange(len(a)), n)
        cells = i * len(b) + order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        out.append(np.concatenate([[home], cells[cells != home]]))
    return out


def _radii(entries: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far the farthest resident of each codeword is from it, -1 without residents: a row a codeword."""
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        far = [np.full(len(c), -1.0) for c in books]
        half = books[0].shape[1]
        for b in batches:
            if b.num_rows:
                v = np.stack([unit(np.frombuffer(x, np.float64)) for x in b.column("key").to_pylist()])
                for d, r, x in zip(distances(v, books), far, (v[:, :half], v[:, half:]), strict=True):
                    near = np.argmin(d, 1)
                    np.maximum.at(r, near, np.sqrt(np.maximum(d[np.arange(len(v)), near] + (x * x).sum(1), 0)))
        yield pa.record_batch([pa.array(np.repeat([0, 1], [len(r) for r in far])), pa.array(np.concatenate([np.arange(len(r)) for r in far])), pa.array(np.concatenate(far))], ["book", "word", "radius"])

    found = entries.select("key").mapInArrow(widest, "book long, word long, radius double").groupBy("book", "word").agg(F.max("radius").alias("radius")).collect()
    out = tuple(np.full(len(c), -1.0) for c in books)
    for r in found:
        out[r.book][r.word] = r.radius
    return out


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, recall: float = 0.99, sample: int = SAMPLE, part: int = PART, exact: bool = False) -> DataFrame:
    """Rows of embeddings: vec_id, n_links (other vectors linked directly), component_id and kept.

    Vectors link if the cosine, in double precision, is at least the threshold; candidates come from the index, whose
    codebooks are fitted on `sample` vectors at most and whose visits are calibrated against all, so that links may be missed within the recall but none is wrong. exact: vectors visit every cell
    that can hold a partner, by the cells' radii, so that none is missed; there may be many. Null and zero vectors,
    vectors with null or non-finite components and vectors of other lengths than the most frequent link with nothing.
    Repeated rows are vectors of their own; rows with null vec_id count as links of others, but get no component
    (null) and are not kept. Labels and other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for e in b.column("embedding"):
                v = None if not e.is_valid or e.values.null_count else unit(e.values.to_numpy(zero_copy_only=False))
                keys.append(None if v is None else e.values.to_numpy(zero_copy_only=False).tobytes())
            yield pa.record_batch([pa.array(keys, pa.binary()), b.column("vec_id")], ["key", "vec_id"])

    named = stored(rows.mapInArrow(name, ENTRY), "vectors")
    dims = named.where("key is not null").groupBy(F.octet_length("key").alias("size")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "size").first()
    size = dims.c and dims["size"] if dims else -1
    entries = named.where(F.octet_length("key") == size).groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    entries = stored(entries.withColumn("entry", F.xxhash64("key")), "entries")
    total = entries.count()
    k = int(min(1024, max(4, round((total / CELL) ** 0.5))))
    books = _books(entries, k, sample)
    visits = 0 if exact else calibrate(entries, books, threshold, recall)
    shared = spark.sparkContext.broadcast((books, _radii(entries, books) if exact else None))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, radii = shared.value
        for b in batches:
            keys = b.column("key").to_pylist()
            if not keys:
                continue
            v = np.stack([unit(np.frombuffer(x, np.float64)) for x in keys])
            if exact:
                seen = cells_within(v, books, radii, 2 - 2 * threshold)
            else:
                seen = [multi_sequence(x, y, visits) for x, y in zip(*distances(v, books), strict=True)]
            small = [_narrow(np.frombuffer(x, np.float64)) for x in keys]
            yield pa.record_batch([b.column("entry"), b.column("copies"), pa.array(small, pa.binary()), pa.array([s[0] for s in seen], pa.int32()), pa.array(seen, pa.list_(pa.int32()))], ["entry", "copies", "vector", "home", "seen"])

    placed = stored(entries.select("entry", "copies", "key").mapInArrow(place, "entry long, copies long, vector binary, home int, seen array<int>"), "placed")
    def match(t: pa.Table) -> pa.Table:
        return compare(t, threshold)

    found = stored(visits_by_part(placed, part).groupBy("cell", "r", "q").applyInArrow(match, "entry long, n long, other long"), "found")
    ids = entries.select("entry", "id", "copies")
    links = found.where("other is not null").select("entry", "other").distinct()
    links = links.join(ids.select("entry", F.col("id").alias("a")), "entry").join(ids.select(F.col("entry").alias("other"), F.col("id").alias("b")), "other").select("a", "b")
    counts = found.where("n is not null").groupBy("entry").agg(F.sum("n").alias("n"))
    groups = components(links).withColumnRenamed("node", "id")
    known = entries.join(counts, "entry", "left").join(groups, "id", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = named.join(known, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def visits_by_part(placed: DataFrame, part: int) -> DataFrame:
    """Residents and guests of the cells. Either are split by their number, so that each part (cell, r, q) has about `part` of each at most."""
    guests = placed.select("entry", "copies", "vector", "home", F.explode("seen").alias("cell"))
    pieces = lambda name: F.ceil(F.count("*") / part).cast("int").alias(name)
    parts = placed.groupBy(F.col("home").alias("cell")).agg(pieces("rs")).join(guests.groupBy("cell").agg(pieces("qs")), "cell")  # a row for each used cell, k * k at most
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = placed.withColumn("cell", F.col("home")).join(parts, "cell").withColumn("r", F.pmod("entry", "rs").cast("int"))
    own = own.select("cell", "r", spread("qs").alias("q"), "entry", "copies", "vector", "home", "seen", F.lit(True).alias("resident"))
    guests = guests.join(parts, "cell").withColumn("q", F.pmod("entry", "qs").cast("int"))
    guests = guests.select("cell", spread("rs").alias("r"), "q", "entry", "copies", "vector", "home", F.lit(None).cast("array<int>").alias("seen"), F.lit(False).alias("resident"))
    return own.unionByName(guests).repartition(partitions(placed.sparkSession), "cell", "r", "q")  # not by cell alone, as the joins leave it


def _books(entries: DataFrame, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks, fitted in one task on at most `sample` entries."""
    def fit(t: pa.Table) -> pa.Table:
        v = np.stack([unit(np.frombuffer(x, np.float64)) for x in sorted(t.column("key").to_pylist())])
        half = max(1, v.shape[1] // 2)
        books = (codebook(v[:, :half], k), codebook(v[:, half:], k))
        return pa.table({"a": [books[0].tobytes()], "b": [books[1].tobytes()], "half": pa.array([half], pa.int32()), "rest": pa.array([v.shape[1] - half], pa.int32())})

    rows = entries.select("key", "entry").orderBy("entry").limit(sample).select("key").withColumn("all", F.lit(0)).groupBy("all")
    found = rows.applyInArrow(fit, "a binary, b binary, half int, rest int").collect()
    if not found:
        return np.zeros((1, 1)), np.zeros((1, 1))
    r = found[0]
    return np.frombuffer(bytes(r.a)).reshape(-1, r.half), np.frombuffer(bytes(r.b)).reshape(-1, r.rest) if r.rest else np.zeros((1, 0))


def compare(t: pa.Table, threshold: float) -> pa.Table:
    """Within one part of a cell: link counts of visitors and residents, and links that span what is connected here.

    A visitor counts each resident that it links with. A resident counts a visitor only if it does not itself visit the
    visitor's home, where it would count it.
    """
    is_own = t.column("resident").to_numpy(zero_copy_only=False).astype(bool)
    empty = pa.table({"entry": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    if is_own.all() or not is_own.any():
        return empty
    entry, copies, home = (t.column(c).to_numpy() for c in ("entry", "copies", "home"))
    raw = t.column("vector").to_pylist()
    own, guest = np.flatnonzero(is_own), np.flatnonzero(~is_own)
    vectors = np.stack([unit(_wide(x)) for x in raw])
    seen = t.column("seen").to_pylist()
    cell = home[own[0]]
    base = int(max(home.max(), max(max(seen[i]) for i in own))) + 1
    known = np.sort(np.concatenate([np.asarray(seen[i], np.int64) + base * k for k, i in enumerate(own)]))
    out_entry, out_n, spans = [], [], []
    residents, add = vectors[own], np.zeros(len(own), np.int64)
    for i in range(0, len(guest), 512):
        part = guest[i : i + 512]
        x, y = np.nonzero(vectors[part] @ residents.T >= threshold)
        other = entry[part[x]] != entry[own[y]]
        x, y = x[other], y[other]
        if not len(x):
            continue
        out_entry.append(entry[part]), out_n.append(np.bincount(x, copies[own[y]], len(part)).astype(np.int64))
        goes = home[part[x]] + base * y.astype(np.int64)
        back = np.isin(goes, known) | (home[part[x]] == cell)
        add += np.bincount(y[~back], copies[part[x[~back]]], len(own)).astype(np.int64)
        spans.append(spanning(entry[part], entry[own], x, y))
    if not out_entry:
        return empty
    e, n = np.concatenate([*out_entry, entry[own]]), np.concatenate([*out_n, add])
    e, n = e[n > 0], n[n > 0]
    links = np.concatenate(spans)
    return pa.table({"entry": pa.array(np.concatenate([e, links[:, 0]])), "n": pa.concat_arrays([pa.array(n), pa.nulls(len(links), pa.int64())]), "other": pa.concat_arrays([pa.nulls(len(e), pa.int64()), pa.array(links[:, 1].copy())])})


def _narrow(v: np.ndarray) -> bytes:
    """The vector's bytes, in single precision where that loses nothing; the first byte tells which."""
    single = v.astype(np.float32)
    return b"4" + single.tobytes() if (single == v).all() else b"8" + v.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"4" else np.float64, offset=1)

