"""Merkle manifest of a dataset: hash trees over sorted leaves, built from runs, with membership proofs.

Each tree's leaves are sorted and dealt by ranges; a task streams its part and writes runs of CHUNK leaves at most. A run knows
its first leaf's index in the tree. A stack of peaks walks over it: whenever a peak completes its aligned group of `fanout`
siblings, the group becomes a node one level up, like a carry in a number of that base. Peaks whose group reaches beyond the run
stay; WIDTH neighbouring runs' peaks are merged by the same stack, in rounds, until a tree is one run. That last run knows the
tree's size and closes short groups at the right edge by hashing what they have, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.llm.shared import dropped, small_batches, stored

CHUNK, WIDTH = 4096, 64  # leaves of a run, and runs that are merged in one group
RUN = "tree string, part int, seq long, n long, leaves array<string>, others array<string>, ids array<long>"
NODE = "tree string, chunk long, level int, idx long, digest string, done boolean"
Key = tuple[int, int]  # level and index of a node


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Peaks:
    """The stack: nodes come in the order of the leaves they cover; a completed group is replaced by its parent at once.

    peaks: what is not yet under a completed parent; born: the parents made here. size: leaves of the whole tree, where a group
    that ends with the tree is complete although short; None: unknown, only full groups complete.
    """

    def __init__(self, fanout: int, size: int | None = None) -> None:
        self.fanout, self.peaks, self.born = fanout, [], []
        self.counts = [size] if size is not None else None
        while self.counts and self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // fanout))

    def push(self, level: int, idx: int, digest: str) -> None:
        self.peaks.append((level, idx, digest))
        while True:
            level, idx, _ = self.peaks[-1]
            last = self.counts is not None and idx == self.counts[level] - 1
            if (self.counts is not None and level == len(self.counts) - 1) or not (last or idx % self.fanout == self.fanout - 1):
                return
            want = idx % self.fanout + 1
            run = self.peaks[-want:]
            if len(run) < want or run[0][:2] != (level, idx - want + 1):
                return  # the group begins before this run
            del self.peaks[-want:]
            parent = (level + 1, idx // self.fanout, joined(d for _, _, d in run))
            self.born.append(parent)
            self.peaks.append(parent)


def runs(leaves: DataFrame, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Runs of leaves (tree, id, leaf, other, .. order columns): RUN with the number `chunk` of a run in its tree, its first index `start`, and the tree's `size`."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, tree, held = TaskContext.get().partitionId(), 0, None, []
        schema = pa.schema([("tree", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("leaves", pa.list_(pa.string())), ("others", pa.list_(pa.string())), ("ids", pa.list_(pa.int64()))])

        def run() -> pa.RecordBatch:
            own = {"tree": tree, "part": part, "seq": seq, "n": len(held), "leaves": [h[0] for h in held], "others": [h[1] for h in held], "ids": [h[2] for h in held]}
            return pa.RecordBatch.from_pylist([own], schema)

        for b in batches:
            for t, *row in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "other", "id")), strict=True):
                if held and (t != tree or len(held) == chunk):
                    yield run()
                    seq, held = seq + 1, []
                tree = t
                held.append(row)
        if held:
            yield run()

    small_batches(leaves.sparkSession)
    dealt = leaves.withColumn("spread", F.monotonically_increasing_id())  # equal leaves may stand in any order, and in several parts
    dealt = stored(dealt, "leaves")
    sorted_ = dealt.repartitionByRange("tree", *order, "leaf", "spread").sortWithinPartitions("tree", *order, "leaf", "spread")
    made = stored(sorted_.select("tree", "leaf", "other", "id").mapInArrow(cut, RUN), "runs")
    dropped(dealt)
    counted = made.select("tree", "part", "seq", "n")
    inside = Window.partitionBy("tree", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("tree", "part").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    parts = parts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.sum("n").over(whole).alias("size"))
    places = counted.withColumns({"n1": F.coalesce(F.sum("n").over(inside), F.lit(0)), "c1": F.count("*").over(inside)})
    places = places.join(parts, ["tree", "part"]).select("tree", "part", "seq", (F.col("n0") + F.col("n1")).alias("start"), (F.col("c0") + F.col("c1")).alias("chunk"), "size")
    out = made.join(places, ["tree", "part", "seq"])
    out.stored_path = made.stored_path
    return out


def peaks(made: DataFrame, fanout: int, nodes: bool = False) -> DataFrame:
    """NODE rows of each run: the peaks that stay (done false), and with `nodes` also the leaves and parents below them (done true)."""
    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Peaks(fanout)
                for k, leaf in enumerate(row["leaves"]):
                    s.push(0, row["start"] + k, leaf)
                stay = {p[:2] for p in s.peaks}
                below = [(0, row["start"] + k, leaf) for k, leaf in enumerate(row["leaves"])] + s.born if nodes else []
                found = [(*p, False) for p in s.peaks] + [(*p, True) for p in below if p[:2] not in stay]
                yield _nodes(row["tree"], row["chunk"], found)

    return made.select("tree", "chunk", "start", "leaves").mapInArrow(stack, NODE)


def _nodes(tree: str, chunk: int, found: list[tuple]) -> pa.RecordBatch:
    level, idx, digest, done = zip(*found, strict=True) if found else ((), (), (), ())
    n = len(found)
    return pa.record_batch([pa.array([tree] * n, pa.string()), pa.array([chunk] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.string()), pa.array(done, pa.bool_())], ["tree", "chunk", "level", "idx", "digest", "done"])


def merged(made: DataFrame, fanout: int, width: int = WIDTH, nodes: bool = False) -> DataFrame:
    """All nodes that are not inside one run, as far as `nodes` is false: NODE rows with the tree's `size`; the root is the one of the highest level.

    A round merges `width` neighbours of each tree, so a group holds that many runs' peaks: fanout * levels * 2 each at most.
    """
    sizes = made.groupBy("tree").agg(F.max("size").alias("size"), F.max("chunk").alias("last"))
    now = stored(peaks(made, fanout, nodes).join(sizes, "tree"), "peaks")
    tables = [now]
    out = []
    while True:
        most = now.agg(F.max("last")).first()[0]
        out.append(now.where("done"))
        final = most is None or most < width

        groups = now.where("not done").withColumn("group", F.expr(f"chunk div {width}"))
        now = stored(groups.groupBy("tree", "group").applyInArrow(_merge(fanout, width, final), NODE + ", size long, last long"), "peaks")
        tables.append(now)
        if final:
            out.append(now)
            break
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    both = stored(both.select("tree", "level", "idx", "digest", "size"), "nodes")
    for t in tables:
        dropped(t)
    return both


def _merge(fanout: int, width: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    """The peaks of a group of runs, merged; final: the group is a whole tree."""
    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["idx"] * fanout ** r["level"])
        size, last = rows[0]["size"], rows[0]["last"] // width
        s = Peaks(fanout, size if final else None)
        for r in rows:
            s.push(r["level"], r["idx"], r["digest"])
        stay = set() if final else {p[:2] for p in s.peaks}
        seen = {(r["level"], r["idx"]): (r["level"], r["idx"], r["digest"]) for r in rows} | {p[:2]: p for p in s.born}
        made = pa.Table.from_batches([_nodes(rows[0]["tree"], rows[0]["group"], [(*p, k not in stay) for k, p in seen.items()])])
        return made.append_column("size", pa.array([size] * len(seen), pa.int64())).append_column("last", pa.array([last] * len(seen), pa.int64()))

    return merge


def counts(size: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree, the leaves first."""
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // fanout))
    return found


def asked(start: int, n: int, size: int, fanout: int) -> list[Key]:
    """The nodes that proofs of the leaves start .. start + n - 1 need and that this run can't make by itself."""
    out, a, b, full_from, full_to = [], start, start + n - 1, start, start + n  # full: indices at this level that the run covers whole
    for level, count in enumerate(counts(size, fanout)[:-1]):
        groups = {a // fanout, b // fanout}
        out += [(level, i) for g in groups for i in range(g * fanout, min((g + 1) * fanout, count)) if not full_from <= i < full_to]
        a, b = a // fanout, b // fanout
        full_from, full_to = -(-full_from // fanout), full_to // fanout
    return out


def siblings(start: int, leaves: list[str], size: int, fanout: int, outside: dict[Key, str]) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf of a run its proof: for each level its place in its group and the digests of the group's others, left to right."""
    levels, known = counts(size, fanout), [dict(enumerate(leaves, start))]
    for level in range(len(levels) - 1):
        here = known[level]
        here.update({i: d for (at, i), d in outside.items() if at == level})
        up = {}
        for g in {i // fanout for i in here}:
            group = range(g * fanout, min((g + 1) * fanout, levels[level]))
            if all(i in here for i in group):
                up[g] = joined(here[i] for i in group)
        known.append(up)
    proofs: dict[Key, tuple[int, list[str]]] = {}
    for k in range(len(leaves)):
        i, path = start + k, []
        for level in range(len(levels) - 1):
            if (level, i) not in proofs:
                g = i // fanout * fanout
                proofs[level, i] = (i - g, [known[level][j] for j in range(g, min(g + fanout, levels[level])) if j != i])
            path.append(proofs[level, i])
            i //= fanout
        yield path


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof give."""
    for place, others in path:
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def with_outside(made: DataFrame, nodes: DataFrame, fanout: int, beyond: DataFrame | None = None) -> DataFrame:
    """Runs with the nodes `outside` (array of level, idx, digest) that their proofs need: at most 2 * fanout a level.

    beyond: more columns of each tree; they are joined to the list of runs, not to the leaves in them.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["tree"], r["chunk"], *k) for r in b.to_pylist() for k in asked(r["start"], r["n"], r["size"], fanout)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])
    wanted = made.select("tree", "chunk", "start", "n", "size").mapInArrow(ask, "tree string, chunk long, level int, idx long")
    found = wanted.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    listed = found.groupBy("tree", "chunk").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("outside"))
    places = made.select("tree", "chunk") if beyond is None else made.select("tree", "chunk").join(beyond, "tree")
    return made.join(places.join(listed, ["tree", "chunk"], "left"), ["tree", "chunk"])


def roots(nodes: DataFrame) -> DataFrame:
    """The root of each tree: (tree, root)."""
    return nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("root"))


def node_records(leaves: DataFrame, order: list[str], fanout: int = 2, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """The manifest in full: every node of every tree (tree, level, idx, digest, size) over leaves (tree, id, leaf, other and the order columns); leaves are level 0.

    Null and repeated order keys are sorted like others (null first), equal keys by their leaf. An empty table gives no rows.
    """
    return merged(runs(leaves, order, chunk), fanout, width, nodes=True)


def framed(*columns: str) -> F.Column:
    """Columns as one binary: `-` for null, else the UTF-8 byte count, `:` and the value."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary")


def document_leaves(docs: DataFrame, tampered_every: int = 7) -> DataFrame:
    """Leaves of documents by lang, and in `other` the leaf with n_chars + 1 where crc32 of the doc_id divides (null elsewhere)."""
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").withColumn("more", F.col("n_chars").cast("decimal(20, 0)") + 1)
    leaf = F.sha2(framed("doc_id", "source", "lang", "n_chars", "text"), 256)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_every == 0
    other = F.when(hit & F.col("n_chars").isNotNull(), F.sha2(framed("doc_id", "source", "lang", "more", "text"), 256))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null before all languages, bytewise
    return rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), other.alias("other"))


def manifest(docs: DataFrame, fanout: int = 2, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """For each document its leaf, its language's subroot, the root over all, its proof's digest, and whether the row, tampered with or not, still folds to the root.

    Columns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Leaves of a language ascend by doc_id, null first;
    rows with one doc_id ascend by their leaf, and repeated rows are leaves of their own. Null columns and empty texts have
    leaves that differ. A null doc_id or n_chars is never tampered with. An empty table gives no rows. Other columns are not read.
    """
    made = runs(document_leaves(docs), ["id"], chunk)
    nodes = merged(made, fanout, width)
    subroots = stored(roots(nodes), "subroots")
    upper = runs(subroots.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("id"), F.col("root").alias("leaf"), F.col("tree").alias("other"), F.col("tree").alias("name")), ["name"], chunk)
    above = merged(upper, fanout, width)
    root = [r.root for r in roots(above).collect()]  # one digest, or none of an empty table
    paths = with_outside(upper, above, fanout).mapInArrow(_paths(fanout), "tree string, subroot string, path array<struct<place: int, others: array<string>>>")
    whole = with_outside(made, nodes, fanout, paths)
    return whole.mapInArrow(_proved(fanout, *root), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proofs(row: dict, fanout: int) -> Iterator[list[tuple[int, list[str]]]]:
    outside = {(o["level"], o["idx"]): o["digest"] for o in row["outside"] or []}
    return siblings(row["start"], row["leaves"], row["size"], fanout, outside)


def _paths(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tree, subroot, path) of the tree over subroots, whose runs hold the trees' names in `others`."""
    schema = pa.schema([("tree", pa.string()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])))])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = zip(row["others"], row["leaves"], _proofs(row, fanout), strict=True)
                yield pa.RecordBatch.from_pylist([{"tree": t, "subroot": r, "path": [{"place": p, "others": o} for p, o in path]} for t, r, path in found], schema)

    return prove


def _proved(fanout: int, root: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The manifest's rows of runs that have the subroot and its path."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                above = [(p["place"], p["others"]) for p in row["path"]]
                out = []
                for doc, leaf, other, path in zip(row["ids"], row["leaves"], row["others"], _proofs(row, fanout), strict=True):
                    path = [*path, *above]
                    now = folded(other or leaf, path)
                    out.append((doc, leaf, row["subroot"], root, joined(d for _, others in path for d in others), now, now == root))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return prove
