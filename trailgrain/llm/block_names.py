"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Texts are cut into blocks of BLOCK bytes. Equal blocks get equal integer names by sorting: a block goes to one of BUCKETS by
its hash, and its name is its bucket and its rank in the sorted bucket. Then adjacent names are paired and the pairs named in
the same way, level by level, until a document has one name. Names and the number of levels decide equality; hashes only
route. A round of pairs halves what is left, so a document of n blocks takes log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrain.llm.shared import dropped, stored

BLOCK = 1024  # bytes of a block
BUCKETS, RANK_BITS = 1 << 20, 40  # a name is bucket * 2^40 + rank
HOT, LEAST = 1000, 16  # so many of the most frequent keys are named apart, if they occur so often
ALONE = 0  # stands for the missing right neighbour of a last block; no name is 0


def frequent(rows: DataFrame, *keys: Column) -> DataFrame:
    """The HOT most frequent values of the keys; any other value has less than 1 / HOT of the rows, or fewer than LEAST."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") >= LEAST)
    return counts.orderBy(F.desc("n_"), *[c for c in counts.columns if c != "n_"]).limit(HOT)


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with a unique `row` and `pos`, keys never null) with the integer `name` of their keys in place of the keys.

    The most frequent keys, at most HOT, are sorted and named apart (below 0) and reach the rows by a broadcast of at most HOT
    keys; these rows are spread over all tasks without their keys. All others meet in buckets and are named by their rank.
    """
    hashed = rows.withColumn("hash_", F.xxhash64(*keys))
    wide = any(rows.schema[k].dataType != T.LongType() for k in keys)  # long keys are counted by their hashes first
    maybe = hashed.join(F.broadcast(frequent(hashed, F.col("hash_")).select("hash_")), "hash_", "left_semi") if wide else hashed
    top = frequent(maybe, *[F.col(k) for k in keys]).select(*keys)
    top = top.withColumn("hot_", -F.row_number().over(Window.orderBy(*keys)).cast("long"))
    marked = hashed.join(F.broadcast(top), keys, "left")
    cold = F.col("hot_").isNull()
    spread = F.when(cold, F.pmod("hash_", F.lit(BUCKETS))).otherwise(-1 - F.pmod(F.xxhash64("row", "pos"), F.lit(BUCKETS)))
    light = marked.withColumn("bucket_", spread).withColumns({k: F.when(cold, F.col(k)) for k in keys})
    rank = F.dense_rank().over(Window.partitionBy("bucket_").orderBy(*keys)).cast("long")
    name = F.coalesce("hot_", F.shiftleft(F.col("bucket_"), RANK_BITS) + rank)
    return light.withColumn("name", name).drop("hash_", "hot_", "bucket_", *keys)


def identities(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The identity of each row's text: (row, doc_id, sha, level, name); rows have equal (level, name) exactly where texts are equal.

    A stored table (stored_path), which the caller drops. `row` numbers the rows of the input; sha is the text's SHA-256 and takes no part.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), whole.alias("bytes"))
    n = F.greatest(F.ceil(F.octet_length("bytes") / BLOCK), F.lit(1)).cast("int")
    rows = rows.select("row", F.struct("doc_id", F.unhex(F.sha2("bytes", 256)).alias("sha")).alias("head"), n.alias("n"), "bytes")
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("bytes", i * BLOCK + 1, F.lit(BLOCK)))
    cut = rows.select("row", "head", F.col("n"), F.posexplode(pieces).alias("pos", "block"))
    cut = cut.withColumn("head", F.when(F.col("pos") == 0, F.col("head")))
    first = level = stored(named(cut, ["block"]), "names")
    done, tables = [first.where("n = 1").select("row", F.lit(0).alias("level"), "name")], [first]
    most, depth = first.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = level.where("n > 1").groupBy("row", F.expr("n - n div 2").cast("int").alias("n"), F.expr("pos div 2").alias("pos"))
        pairs = stored(pairs.agg(F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(ALONE)).alias("b")), "pairs")
        level = stored(named(pairs, ["a", "b"]), "names")
        done.append(level.where("n = 1").select("row", F.lit(depth).alias("level"), "name"))
        tables += [pairs, level]
    heads = first.where("pos = 0").select("row", "head.doc_id", "head.sha", "n", "name")
    one = heads.where("n = 1").select("row", "doc_id", "sha", F.lit(0).alias("level"), "name")
    for d in done[1:]:
        one = one.unionByName(heads.where("n > 1").select("row", "doc_id", "sha").join(d, "row").select("row", "doc_id", "sha", "level", "name"))
    out = stored(one, "identities")
    for t in tables:
        dropped(t)
    return out


def name_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (hex).

    Texts are equal when their bytes are; null counts as empty, and all empty texts are equal. The row with the largest doc_id
    of a group stays (null is smaller than any); of rows that share it, one. An empty table gives no rows. Other columns of docs
    are not read, whatever their names.
    """
    ids = identities(docs, text, id_column)
    groups = ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
    large = groups.where(F.col("group_size") >= LEAST).orderBy(F.desc("group_size"), "level", "name").limit(HOT)
    marked = ids.join(F.broadcast(large), ["level", "name"], "left")
    rest = marked.where("group_size is null").drop("group_size", "keep").join(groups, ["level", "name"])
    both = marked.where("group_size is not null").unionByName(rest)
    return both.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
