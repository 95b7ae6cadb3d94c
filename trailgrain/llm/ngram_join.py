"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

A document is its set of distinct word shingles. All shingles have one global order: by a class of their document
frequency (from a sketch of bounded size over all documents), then by hash, so that rare ones come first. If two
documents overlap enough, then for any m the first |s| - need + m shingles of both, need being the least overlap that a
link asks of s, share at least m. Each document takes the m that makes its estimated cost least, and two documents are
verified if they share as many prefix shingles as the smaller of their two m.

Groups of copies do not need all their pairs: documents of one set are one node, and a shingle's nodes are first
compared with one of them, the pivot, if they share as many prefix shingles with it. What that links is one group
already. Then all pairs between different groups that share enough prefix shingles are verified. So no link that joins
different groups is lost. Pairs of a frequent shingle are not written out: the nodes outside its pivot's group meet
all its nodes in tiles of bounded size and are verified there at once; shingles with one pivot share the tiles.

Sets are verified as arrays of hashes. They are stored once, for nodes that share a prefix shingle with others; before a
join a bit table of fixed size tells which of them it needs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm import arrays as A
from trailgrain.llm.shared import components, dropped, partitions, release, small_batches, stored

SKETCH_BITS, SKETCH_BLOCKS = 22, 1024
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16)
POSTING = np.dtype([("tok", "<u4"), ("top", "<u2"), ("node", "i8"), ("nm", "u4")])  # 48 bits of the shingle; size and place of m among the choices
FLUSH = 150_000
HOT = 64  # nodes of a shingle from which they are verified in tiles
TILE, TILE_SHINGLES = 1024, 1 << 20  # nodes and shingles in one side of a tile, about
SLOTS = 1 << 17  # rows of 64 bits in the table that tells which keys a join needs


def set_chunks(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of rows their sets of shingle hashes, each sorted, one after another, and the rows' offsets into them.

    The words of a row with fewer than width words are one shingle.
    """
    for i, j in A.row_chunks(offs):
        starts, ends, at = A.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        hashes = A.word_hashes(data[offs[i] : offs[j]], starts, ends, A.LOWER_CODE)
        n_words = np.diff(at)
        n = np.where(n_words >= width, n_words - width + 1, n_words > 0)
        bounds = np.append(0, np.cumsum(n))
        s = A.gram_hashes(hashes, width)[np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], n)]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        s[bounds[short]] = A.span_hashes(hashes, at[short], at[short + 1])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s[a:b].sort()
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        keep[bounds[:-1][n > 0]] = True
        yield s[keep], np.append(0, np.cumsum(keep))[bounds]


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    for s, at in set_chunks(data, offs, width):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield s[a:b]


def set_nodes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each set of shingles, from two sums of different hashes and the size."""
    sums = [np.append(A.U(0), np.cumsum(A.mix(x))) for x in (s, s * A.U(0x9E3779B97F4A7C15))]
    one, two = (x[at[1:]] - x[at[:-1]] for x in sums)
    return A.mix(one ^ A.mix(two + np.diff(at).astype(np.uint64))).view(np.int64)


def near_duplicates(documents: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Rows of documents: doc_id, n_shingles and component_id, the smallest doc_id reachable by links, itself included.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Two documents link if 100 * intersection >= percent * union of
    their sets of distinct shingles of `width` words; a text with fewer words is one shingle. Null and wordless texts
    have an empty set and link with nothing. Rows with null doc_id get their n_shingles and a null component; rows that
    share a doc_id are judged by their own text each, and their id joins what any of them links. Other columns are
    ignored; an empty table gives no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets, sketch = _sets(docs, width)
    own = sets.where("node is not null and doc_id is not null")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    lists = stored(_postings(docs, _classes(sketch), percent, width), "lists")
    links, used = _links(_set_store(docs, nodes, lists, width), lists, percent)
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    texts_of_id = own.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = components(links.union(texts_of_id))
    for t in used:
        dropped(t)
    groups = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    first = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = sets.join(groups.select("node", "component").join(first, "component").select("node", "component_id"), "node", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def _sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Stored: doc_id, n and node (null without shingles) of each document; and the frequency sketch, block by block."""
    size = 1 << SKETCH_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            data, offs = A.text_bytes(b.column("text"))
            n, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, at in set_chunks(data, offs, width):
                n.append(np.diff(at))
                nodes.append(set_nodes(s, at))
                np.add.at(counts, (s >> A.U(64 - SKETCH_BITS)).astype(np.int64), 1)
            n, nodes = np.concatenate(n), np.concatenate(nodes)
            yield pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(nodes, mask=n == 0), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "node", "block", "counts"])
        parts = np.split(counts, SKETCH_BLOCKS)
        k = [i for i, p in enumerate(parts) if p.any()]
        yield pa.record_batch([*[pa.nulls(len(k), pa.int64())] * 3, pa.array(k, pa.int32()), pa.array([parts[i].tobytes() for i in k], pa.binary())], ["doc_id", "n", "node", "block", "counts"])

    found = stored(docs.mapInArrow(scan, "doc_id long, n long, node long, block int, counts binary"), "sets")
    return found.where("block is null").select("doc_id", "n", "node"), found.where("block is not null").select("block", "counts")


def _classes(sketch: DataFrame) -> np.ndarray:
    """A frequency class for each place of the sketch, 0 for all but the frequent; 2 ** SKETCH_BITS bytes at any input size."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(c, np.uint32)
                sums[k] = sums[k] + c if k in sums else c.astype(np.uint64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["block", "counts"])

    spark = sketch.sparkSession
    rows = sketch.repartition(min(partitions(spark), SKETCH_BLOCKS), "block").mapInArrow(total, "block int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS)
    width = len(counts) // SKETCH_BLOCKS
    for k, c in rows:
        counts[k * width : (k + 1) * width] = np.frombuffer(c, np.uint64)
    usual = np.median(counts)
    floor = usual + 4 * math.sqrt(usual) + 4
    return np.where(counts > floor, np.log2(np.maximum(counts / floor, 1)) + 1, 0).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix in global order and how many shingles of it a partner must share. classes: of its shingles."""
    if classes.any():
        order = np.lexsort((s, classes))
        s, length, m = s[order], *_choice(len(s), percent, classes[order])
    else:
        length, m = _plain_choice(len(s), percent)
    return s[:length], m


def _choice(n: int, percent: int, classes: np.ndarray) -> tuple[int, int]:
    """Length of the prefix and m that make the estimated cost least: postings, and candidates with their verification."""
    rest = n - -(-percent * n // 100)
    costs = np.cumsum(np.exp2(2.0 * classes))  # how many documents a shingle may bring, from its class
    sizes = np.array([m for m in CHOICES if rest + m <= n])
    brought = costs[rest + sizes - 1]
    best = int(np.argmin(brought + brought / sizes * (4 + n / 64)))
    return rest + int(sizes[best]), int(sizes[best])


@functools.lru_cache(100_000)
def _plain_choice(n: int, percent: int) -> tuple[int, int]:
    return _choice(n, percent, np.zeros(n))


def _postings(docs: DataFrame, classes: np.ndarray, percent: int, width: int) -> DataFrame:
    """Rows (tok, node, n, m) of prefix shingles that at least two nodes share, each with the shingle's pivot and its m."""
    spark = docs.sparkSession
    blocks, shared = 4 * partitions(spark), spark.sparkContext.broadcast(classes)
    choice = {m: k for k, m in enumerate(CHOICES)}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            p = np.concatenate(held)
            block = (A.mix(_toks(p)) % A.U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            p, block = p[order], block[order]
            heads = np.flatnonzero(np.diff(block, prepend=-1))
            ends = A.tails(heads, len(block))
            return pa.record_batch([pa.array(block[heads], pa.int32()), pa.array([p[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary())], ["block", "payload"])

        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            for s, at in set_chunks(*A.text_bytes(b.column("text")), width):
                cls = shared.value[(s >> A.U(64 - SKETCH_BITS)).astype(np.int64)]
                for i, j, node in zip(at[:-1].tolist(), at[1:].tolist(), set_nodes(s, at).tolist(), strict=True):
                    if i == j or node in known:
                        continue
                    known.add(node)
                    tok, m = prefix(s[i:j], cls[i:j], percent)
                    p = np.zeros(len(tok), POSTING)
                    p["tok"], p["top"], p["node"], p["nm"] = tok & A.U(0xFFFFFFFF), (tok >> A.U(32)) & A.U(0xFFFF), node, (j - i) * len(CHOICES) + choice[m]
                    held.append(p)
                    size += len(p)
                    if size >= FLUSH:
                        yield flushed()
                        held, size = [], 0
        if size:
            yield flushed()

    def lists(t: pa.Table) -> pa.Table:
        p = np.frombuffer(b"".join(t.column("payload").to_pylist()), POSTING)
        tok, node = _toks(p).astype(np.int64), p["node"]
        drawn = A.mix(node.view(np.uint64))  # the pivot is the node of the least hash, so lists of the same nodes choose the same
        order = np.lexsort((node, drawn, tok))
        p, tok, node = p[order], tok[order], node[order]
        new = np.append(True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]))
        p, tok, node = p[new], tok[new], node[new]
        heads = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        sizes = A.tails(heads, len(tok)) - heads
        n, m = (p["nm"] // len(CHOICES)).astype(np.int32), np.array(CHOICES, np.int32)[p["nm"] % len(CHOICES)]
        keep = np.repeat(sizes > 1, sizes)
        columns = {"tok": tok, "node": node, "n": n, "m": m, "pivot": np.repeat(node[heads], sizes), "pivot_m": np.repeat(m[heads], sizes)}
        return pa.table({c: pa.array(v[keep]) for c, v in columns.items()})

    return docs.mapInArrow(emit, "block int, payload binary").groupBy("block").applyInArrow(lists, "tok long, node long, n int, m int, pivot long, pivot_m int")


def _toks(p: np.ndarray) -> np.ndarray:
    return (p["top"].astype(np.uint64) << A.U(32)) | p["tok"].astype(np.uint64)


def _only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df that may have a key among those wanted (a column of the same name): all that do, and few others.

    The keys' hashes set bits in a table of SLOTS rows at most, which is broadcast whatever the input; so only rows that a
    join needs are shuffled for it.
    """
    h = F.xxhash64(key)
    slot, bit = F.pmod(F.shiftrightunsigned(h, 6), F.lit(SLOTS)).cast("int").alias("slot"), F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 as int))")
    bits = wanted.select(slot, bit.alias("bit")).groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits"))
    return df.withColumn("slot", slot).join(F.broadcast(bits), "slot").where(F.expr(f"bits & shiftleft(1L, cast(xxhash64({key}) & 63 as int)) <> 0")).drop("slot", "bits")


def _set_store(docs: DataFrame, nodes: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """Stored: the whole set of each node of the lists, from the text of its smallest doc_id."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            want, out = b.column("node").to_pylist(), []
            for s, at in set_chunks(*A.text_bytes(b.column("text")), width):
                for i, j, node in zip(at[:-1].tolist(), at[1:].tolist(), set_nodes(s, at).tolist(), strict=True):
                    if node == want[len(out)] and node not in known:
                        known.add(node)
                        out.append(s[i:j].tobytes())
                    else:
                        out.append(None)
            b = pa.record_batch([b.column("node"), pa.array(out, pa.binary())], ["node", "hashes"])
            yield b.filter(b.column("hashes").is_valid())

    wanted = stored(nodes.join(lists.select("node").distinct(), "node"), "wanted")
    texts = _only(docs, "doc_id", wanted).join(wanted, "doc_id")
    store = stored(texts.select("node", "text").mapInArrow(hashes, "node long, hashes binary"), "store")
    dropped(wanted)
    return store


def _links(store: DataFrame, lists: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links that join what belongs together: with pivots, then within frequent shingles and by shared prefixes; and the tables they read."""
    star = lists.where("node <> pivot").repartition("node")
    star = star.groupBy(F.col("node"), F.col("pivot").alias("y")).agg(F.count("*").alias("c"), F.min(F.least("m", "pivot_m")).alias("need")).where("c >= need")
    best = star.groupBy("node").agg(F.max(F.struct("c", "y")).alias("b")).select(F.col("node").alias("x"), F.col("b.y").alias("y"))
    first = _verified(store, best, percent)
    left = _between(lists, first)
    dropped(lists)
    tiles = _verified_in_tiles(store, left.where(F.col("c") >= HOT), percent)
    blocks = 4 * partitions(lists.sparkSession)
    packed = left.where(F.col("c") < HOT).select(F.pmod(F.xxhash64("tok"), F.lit(blocks)).alias("block"), "tok", "node", "n", "m", "comp")

    def cross(t: pa.Table) -> pa.Table:
        return _cross_pairs(*(t.column(c).to_numpy() for c in ("tok", "node", "n", "m", "comp")), percent)

    # Pairs that share a hot shingle meet in tiles; the others have all that they share in these lists.
    pairs = packed.groupBy("block").applyInArrow(cross, "x long, y long, c int, need int")
    pairs = pairs.groupBy("x", "y").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("x", "y")
    found = [first, tiles, _verified(store, pairs, percent)]
    return functools.reduce(DataFrame.union, found), [store, left, *found]


def _verified_in_tiles(store: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Stored links between nodes of frequent shingles, tile by tile.

    The nodes of a pivot's frequent shingles outside its group are dealt into rows of tiles, all their nodes into columns,
    by their number and their shingles, so that a tile is bounded on both sides. A pivot has no more shingles than its
    prefix, and those of a group of near copies mostly hold the same nodes, which so meet once.
    """
    rows = stored(hot.groupBy("pivot", "major", "node").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "tiles")
    parts = lambda which: F.greatest(F.lit(1), F.ceil(F.count_if(which) / TILE), F.ceil(F.sum(F.when(which, F.col("n"))) / TILE_SHINGLES)).cast("int")
    size = rows.groupBy("pivot").agg(parts(F.col("comp") != F.col("major")).alias("tall"), parts(F.lit(True)).alias("wide"))
    rows_of = rows.join(size, "pivot")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    tall = F.when(F.col("comp") != F.col("major"), F.transform(every("wide"), lambda j: F.struct(deal("tall", 1).alias("i"), j.alias("j"), F.lit(True).alias("row"))))
    wide = F.transform(every("tall"), lambda i: F.struct(i.alias("i"), deal("wide", 2).alias("j"), F.lit(False).alias("row")))
    tiles = rows_of.select("pivot", "node", "comp", F.explode(F.when(tall.isNull(), wide).otherwise(F.concat(tall, wide))).alias("t")).select("pivot", "t.i", "t.j", "node", "comp", "t.row")

    def verify(t: pa.Table) -> pa.Table:
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        is_row = t.column("row").to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        x, y = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        sizes = np.array([len(s) for s in sets])
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column, minlength=len(names)) > 1
        number = np.cumsum(shared) - 1
        at, column = at[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        both = np.zeros((len(x), len(y)), np.float32)
        step = 1024
        for first in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [first, first + step])
            m = np.zeros((len(sets), step), np.float32)
            m[at[a:b], column[a:b] - first] = 1
            both += m[x] @ m[y].T
        union = sizes[x, None] + sizes[None, y] - both
        hit = (100 * both >= percent * union) & (comp[x, None] != comp[None, y]) & (both > 0)
        links = A.spanning(node[x], node[y], *np.nonzero(hit))
        return pa.table({"a": pa.array(links[:, 0].copy(), pa.int64()), "b": pa.array(links[:, 1].copy(), pa.int64())})

    release(store.sparkSession)
    sets = _only(store, "node", rows.select("node"))
    links = stored(tiles.join(sets, "node").select("pivot", "i", "j", "node", "comp", "row", "hashes").groupBy("pivot", "i", "j").applyInArrow(verify, "a long, b long"), "links")
    dropped(rows)
    return links


def _between(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Stored rows of those shingles whose nodes are in more than one group so far, with comp, the shingle's number of nodes c, and its pivot's group major."""
    groups = components(links).withColumnRenamed("component", "comp")
    now = lists.select("tok", "node", "n", "m", "pivot").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_pivot = F.max(F.when(F.col("node") == F.col("pivot"), F.col("comp"))).alias("major")
    several = now.groupBy("tok").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c"), of_pivot).where("a < b").select("tok", "c", "major")
    return stored(now.join(several, "tok"), "lists")


def _cross_pairs(tok: np.ndarray, node: np.ndarray, n: np.ndarray, m: np.ndarray, comp: np.ndarray, percent: int) -> pa.Table:
    """Pairs of nodes of one block between different groups, of sizes that can link, with the number of shared shingles in it."""
    order = np.lexsort((comp, tok))
    tok, node, n, m, comp = tok[order], node[order], n[order].astype(np.int64), m[order], comp[order]
    ends = np.searchsorted(tok, tok, "right")
    after = np.zeros(len(tok), np.int64)  # first row of the shingle's next group
    if len(tok):
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (comp[1:] != comp[:-1])
        heads = np.flatnonzero(new)
        after = np.repeat(A.tails(heads, len(tok)), A.tails(heads, len(tok)) - heads)
    counts = ends - after
    out: list[np.ndarray] = []
    i = 0
    total = np.cumsum(counts)
    while i < len(tok):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 2_000_000, "right")))
        c = counts[i:j]
        left = np.repeat(np.arange(i, j), c)
        right = np.repeat(after[i:j] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        fit = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
        left, right = left[fit], right[fit]
        x, y, need = np.minimum(node[left], node[right]), np.maximum(node[left], node[right]), np.minimum(m[left], m[right])
        out.append(_counted(x, y, np.ones(len(x), np.int64), need))
        i = j
    rows = _counted(*np.concatenate(out, axis=1)) if out else np.zeros((4, 0), np.int64)
    return pa.table({"x": pa.array(rows[0], pa.int64()), "y": pa.array(rows[1], pa.int64()), "c": pa.array(rows[2].astype(np.int32)), "need": pa.array(rows[3].astype(np.int32))})


def _counted(x: np.ndarray, y: np.ndarray, c: np.ndarray, need: np.ndarray) -> np.ndarray:
    order = np.lexsort((y, x))
    x, y, c, need = x[order], y[order], c[order], need[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    heads = np.flatnonzero(new)
    sums = np.add.reduceat(c, heads) if len(heads) else c[:0]
    return np.stack([x[heads], y[heads], sums, need[heads]]).astype(np.int64)


def _verified(store: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Stored: of the pairs (x, y) those whose whole sets reach the threshold, as links (a, b)."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(*(b.column(c).to_pylist() for c in ("sx", "sy")), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column("x").filter(kept), b.column("y").filter(kept)], ["a", "b"])

    release(store.sparkSession)
    pairs = stored(pairs, "pairs")
    needed = _only(store, "node", pairs.select(F.explode(F.array("x", "y")).alias("node")))
    one = pairs.join(needed.select(F.col("node").alias("x"), F.col("hashes").alias("sx")), "x")
    links = stored(one.join(needed.select(F.col("node").alias("y"), F.col("hashes").alias("sy")), "y").select("x", "y", "sx", "sy").mapInArrow(verify, "a long, b long"), "links")
    dropped(pairs)
    return links
