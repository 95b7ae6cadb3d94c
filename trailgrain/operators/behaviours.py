"""Behaviours of processes: how alike the objects of consecutive events are, and clusters of events between gaps.

Paths and addresses are compared by column expressions. Other labels are compared by vectors of their tokens: each distinct token is
hashed once, and a label's vector is an aggregate over its tokens. A process's events meet their predecessor by ranges of time
(`ordered.running_max`), so a busy process is in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import cut

SECOND = 1_000_000_000
#: Operations of which the second uses what the first made.
RELATED = (("READ", "WRITE"), ("WRITE", "EXECUTE"), ("WRITE", "EXEC"), ("WRITE", "DELETE"), ("WRITE", "UNLINK"), ("CREATE", "WRITE"), ("RECV", "WRITE"), ("READ", "SEND"))
TOKEN = "[A-Za-z0-9_.-]+"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once though f names it often."""
    return F.transform(F.array(value), f)[0]


def _same(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    return _once(F.array_position(equal, F.lit(False)).cast("int"), lambda first: F.when(first == 0, n).otherwise(first - 1))


def path_similarity(left: Column, right: Column) -> Column:
    """Shared first folders over the longer path, its last part not counted where both begin alike; 0 without parts, null as an empty path."""
    parts = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[/\\]+"), lambda p: p != "")

    def share(a: Column, b: Column, common: Column) -> Column:
        longer = F.greatest(F.size(a), F.size(b))
        most = F.when((common > 0) & (common < longer), F.greatest(F.lit(1), longer - 1)).otherwise(longer)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), common / most))

    return _once(parts(left), lambda a: _once(parts(right), lambda b: _once(_same(a, b), lambda common: share(a, b, common))))


def host(label: Column) -> Column:
    """The address in a socket's label: without its prefix, brackets and port."""
    v = F.regexp_replace(F.coalesce(label, F.lit("")), "^socket:", "")
    bracket = F.regexp_extract(v, r"^\[([^\]]*)\]", 1)
    port = F.regexp_extract(v, r"^([^:]*):[0-9]+$", 1)
    return F.when(v.rlike(r"^\[[^\]]*\]"), bracket).when(v.rlike(r"^[^:]*:[0-9]+$"), port).otherwise(v)


def bits(address: Column) -> Column:
    """The 32 or 128 bits of an address as text, null for what is none."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    quad = rf"{octet}\.{octet}\.{octet}\.{octet}"
    binary = lambda xs, base, size: F.array_join(F.transform(xs, lambda x: F.lpad(F.conv(x, base, 2), size, "0")), "")
    four = binary(F.split(address, r"\."), 10, 8)
    # Version 6: no zone; a dotted end becomes two groups.
    six = F.regexp_replace(address, "%[^%]+$", "")
    end = F.split(F.regexp_extract(six, rf":({quad})$", 1), r"\.")
    pair = lambda i: F.lower(F.conv(F.concat(F.lpad(F.conv(end[i], 10, 16), 2, "0"), F.lpad(F.conv(end[i + 1], 10, 16), 2, "0")), 16, 16))
    dotted = six.rlike(rf":{quad}$")
    six = F.when(dotted, F.concat(F.regexp_replace(six, rf"{quad}$", ""), pair(0), F.lit(":"), pair(2))).otherwise(six)
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    filled = lambda head, tail: F.when(F.size(head) + F.size(tail) < 8, F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail)), tail))

    def wide(c: Column) -> Column:
        full = _once(groups(F.substring_index(c, "::", 1)), lambda head: _once(groups(F.substring_index(c, "::", -1)), lambda tail: filled(head, tail)))
        fine = c.rlike("^[0-9A-Fa-f:]+$") & ~c.rlike(":::|::.*::|^:[^:]|[^:]:$|[0-9A-Fa-f]{5}")
        return F.when(fine, _once(F.when(c.contains("::"), full).otherwise(groups(c)), lambda g: F.when(F.size(g) == 8, binary(g, 16, 16))))

    return F.when(address.rlike(f"^{quad}$"), four).when(address.contains(":"), _once(six, wide))


def address_similarity(left: Column, right: Column) -> Column:
    """Equal first bits of two addresses of one version, as a part of all bits; otherwise 0."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    share = lambda a, b: F.when(F.length(a) == F.length(b), F.when(a == b, 1.0).otherwise(_same(chars(a), chars(b)) / F.length(a))).otherwise(0.0)
    own = lambda c: _once(host(c), bits)
    return _once(own(left), lambda a: _once(own(right), lambda b: share(a, b)))


def operation_similarity(left: Column, right: Column) -> Column:
    """1 for related operations in this order, 0.5 for the same, otherwise 0."""
    name = lambda c: F.replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "^EVENT_", ""), F.lit("FROM"), F.lit(""))
    a, b = name(left), name(right)
    related = reduce(lambda x, y: x | y, [(a == p) & (b == q) for p, q in RELATED])
    return F.when(related, 1.0).when((a == b) & (a != ""), 0.5).otherwise(0.0)


def tokens(label: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def _hashed(size: int):  # noqa: ANN202
    """A unit vector of a token's trigrams, each hashed to a place and a sign."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(token: str) -> list[float]:
            padded, out = f"^{token}$", [0.0] * size
            for gram in {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}:
                digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
                out[int.from_bytes(digest[:4], "big") % size] += 1.0 if digest[4] % 2 else -1.0
            norm = sum(x * x for x in out) ** 0.5
            return [x / norm for x in out] if norm else out

        for batch in batches:
            yield batch.map(one)

    return vectors


def label_vectors(labels: DataFrame, known: DataFrame, size: int = 32, least: int = 1) -> DataFrame:
    """(label, vector) of distinct labels: the unit mean of the vectors of their tokens that occur at least so often in `known` (label, a row an entity). Labels without such a token are absent."""
    if size < 1 or least < 1:
        raise ValueError("size and least are positive")
    counted = known.select(F.explode(tokens(F.col("label"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    vectors = cut(counted.select("token", _hashed(size)("token").alias("vector")))
    rows = labels.select("label").distinct().select("label", F.explode(tokens(F.col("label"))).alias("token")).join(vectors, "token")
    total = rows.groupBy("label").agg(*[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(size)])
    v = F.array(*[F.col(f"v{i}") for i in range(size)])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return total.select("label", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))


def similarities(pairs: DataFrame, known: DataFrame, size: int = 32, least: int = 1) -> DataFrame:
    """(kind, left, right, similarity) of distinct pairs: files by path, sockets by address, all others by the vectors of their tokens."""
    pairs = cut(pairs.select("kind", "left", "right").distinct())
    plain = pairs.where("kind in ('file', 'socket')").withColumn("similarity", F.when(F.col("kind") == "file", path_similarity(F.col("left"), F.col("right"))).otherwise(address_similarity(F.col("left"), F.col("right"))))
    rest = pairs.where("kind not in ('file', 'socket')")
    vectors = cut(label_vectors(rest.select(F.explode(F.array("left", "right")).alias("label")), known, size, least))
    both = rest.join(vectors.select(F.col("label").alias("left"), F.col("vector").alias("a")), "left", "left").join(vectors.select(F.col("label").alias("right"), F.col("vector").alias("b")), "right", "left")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return plain.unionByName(both.select("kind", "left", "right", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)), F.lit(0.0)).alias("similarity")))


def sequences(edges: DataFrame) -> DataFrame:
    """(process, edge_id, t, relation, kind, label, prev) of each process's events in the order of time and id; prev (t, edge_id, relation, label) is the one before, null at first.

    kind and label are of the other end. edges: edge_id, src, dst, src_type, dst_type, src_label, dst_label, relation, t. An event of two processes is in both sequences.
    """
    side = lambda a, b: edges.where(f"{a}_type = 'process'").select(F.col(a).alias("process"), "edge_id", "t", "relation", F.col(f"{b}_type").alias("kind"), F.col(f"{b}_label").alias("label"))
    rows = side("src", "dst").unionByName(side("dst", "src").join(edges.where("src = dst").select("edge_id"), "edge_id", "left_anti"))
    return O.running_max(rows, ["process"], ["t", "edge_id"], F.struct("t", "edge_id", "relation", "label"), "prev")


def features(seq: DataFrame, known: DataFrame, gap_s: float, size: int = 32, least: int = 1) -> DataFrame:
    """(process, edge_id, interval, object, operation) of sequences: time since the process's first event in gaps, and how far object and operation are from those before (0 at first)."""
    seq = cut(seq)
    pairs = seq.where("prev is not null").select("kind", F.coalesce("prev.label", F.lit("")).alias("left"), F.coalesce("label", F.lit("")).alias("right"))
    first = seq.groupBy("process").agg(F.min("t").alias("first"))
    rows = seq.select("*", F.coalesce("prev.label", F.lit("")).alias("left"), F.coalesce("label", F.lit("")).alias("right")).join(first, "process")
    rows = rows.join(similarities(pairs, known, size, least), ["kind", "left", "right"], "left")
    at_first = F.col("prev").isNull()
    object_ = F.when(at_first, 0.0).otherwise(1 - F.col("similarity"))
    operation = F.when(at_first, 0.0).otherwise(1 - operation_similarity(F.col("prev.relation"), F.col("relation")))
    return rows.select("process", "edge_id", ((F.col("t") - F.col("first")) / F.lit(SECOND * gap_s)).alias("interval"), object_.alias("object"), operation.alias("operation"))


def clusters(seq: DataFrame, gap_s: float) -> DataFrame:
    """(process, edge_id, cluster): a process's events between gaps longer than gap_s; numbers go on from process to process in the order of their names."""
    if gap_s <= 0:
        raise ValueError("gap_s must be positive")
    new = F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev.t") > F.lit(SECOND * gap_s)), 1).otherwise(0).cast("long")
    own = cut(O.running(seq.select("process", "edge_id", "t", new.alias("new")), ["process"], ["t", "edge_id"], before=F.col("new")).select("process", "edge_id", (F.col("before") + F.col("new") - 1).alias("own")))
    sizes = own.groupBy("process").agg((F.max("own") + 1).alias("n"))
    base = O.running(sizes, [], ["process"], base=F.col("n")).select("process", "base")
    return own.join(base, "process").select("process", "edge_id", (F.col("base") + F.col("own")).alias("cluster"))


def importance(edges: DataFrame, found: DataFrame, pois: DataFrame) -> DataFrame:
    """(edge_id, cluster, importance) of all edges: the smallest cluster (null without a process), and 1 for points of interest and events that share a cluster with one."""
    hot = found.join(pois.select("edge_id"), "edge_id", "left_semi").select("cluster").distinct().withColumn("hot", F.lit(True))
    own = found.join(hot, "cluster", "left").groupBy("edge_id").agg(F.min("cluster").alias("cluster"), F.max(F.coalesce("hot", F.lit(False))).alias("hot"))
    poi = pois.select("edge_id", F.lit(True).alias("poi")).distinct()
    rows = edges.select("edge_id").join(own, "edge_id", "left").join(poi, "edge_id", "left")
    return rows.select("edge_id", "cluster", F.coalesce(F.col("poi") | F.col("hot"), F.col("poi"), F.col("hot"), F.lit(False)).cast("double").alias("importance"))
