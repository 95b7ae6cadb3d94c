"""What follows a point of interest: rules that are equi-joins with a time interval and the first or nearest few rows.

pois and edges have edge_id, src, dst, relation, timestamp_ns, host and the semantic keys. Hosts must agree; a missing
host agrees with any. Every rule returns distinct edge_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrain.operators import ordered as O
from trailgrain.operators.graph import cut


def basename(key: Column) -> Column:
    """Lower-case last part of a file's path; null for other keys."""
    return F.when(key.startswith("file:"), F.lower(F.regexp_extract(F.trim(F.substring(key, 6, 10_000)), r"([^/\\]*)$", 1)))


def program(key: Column) -> Column:
    """Lower-case name of a process's program, without its folder and arguments; null for other keys."""
    first = F.regexp_extract(F.trim(F.substring(key, 9, 10_000)), r"^(\S+)", 1)
    return F.when(key.startswith("process:"), F.lower(F.regexp_extract(first, r"([^/\\]*)$", 1)))


def _poi(pois: DataFrame) -> DataFrame:
    return pois.select(F.col("edge_id").alias("poi"), F.col("src").alias("p_src"), F.col("dst").alias("p_dst"), F.col("timestamp_ns").alias("p_t"), F.col("host").alias("p_host"), basename(F.col("dst_semantic")).alias("p_name"))


def _same_host() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return empty("host") | empty("p_host") | (F.col("host") == F.col("p_host"))


def _within(before: int, after: int) -> Column:
    return F.col("timestamp_ns").between(F.col("p_t") - before, F.col("p_t") + after)


def _first(found: DataFrame, n: int, newest: bool = False, *keys: str) -> DataFrame:
    time = F.desc("timestamp_ns") if newest else F.asc("timestamp_ns")
    w = Window.partitionBy(*(keys or ("poi",))).orderBy(time, "edge_id")
    return found.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def executed_after_write(edges: DataFrame, pois: DataFrame, after_ns: int) -> DataFrame:
    """The earliest execution of a file with the written one's name."""
    runs = edges.where("relation = 'EVENT_EXECUTE'").withColumn("p_name", basename(F.col("dst_semantic"))).where("p_name <> ''")
    found = _poi(pois.where("relation = 'EVENT_WRITE'")).join(runs, "p_name").where(_within(0, after_ns) & _same_host())
    return _first(found, 1).select("edge_id").distinct()


def adjacent_writes(edges: DataFrame, pois: DataFrame, near_ns: int) -> DataFrame:
    """Other writes of the very file near a written point of interest."""
    writes = edges.where("relation = 'EVENT_WRITE'").join(pois.select("edge_id"), "edge_id", "left_anti").withColumn("p_dst", F.col("dst"))
    return _poi(pois.where("relation = 'EVENT_WRITE'")).join(writes, "p_dst").where(_within(near_ns, near_ns)).select("edge_id").distinct()


def named_file_context(edges: DataFrame, pois: DataFrame, near_ns: int, writes: int = 2, reads: int = 16) -> DataFrame:
    """The latest writes before, to other nodes of the file's name, and the first reads after."""
    p = _poi(pois.where("relation = 'EVENT_WRITE'")).where("p_name <> ''")
    wrote = edges.where("relation = 'EVENT_WRITE'").withColumn("p_name", basename(F.col("dst_semantic")))
    read = edges.where("relation = 'EVENT_READ'").withColumn("p_name", basename(F.col("src_semantic")))
    one = p.join(wrote, "p_name").where(_within(near_ns, 0) & _same_host() & (F.col("dst") != F.col("p_dst")) & (F.col("edge_id") != F.col("poi")))
    two = p.join(read, "p_name").where(_within(0, near_ns) & _same_host())
    return _first(one, writes, True).select("edge_id").union(_first(two, reads).select("edge_id")).distinct()


def new_socket_after_write(edges: DataFrame, pois: DataFrame, lookback_ns: int, after_ns: int, connect: str = "EVENT_CONNECT") -> DataFrame:
    """The first socket after a write that neither the writer nor its parent used before; the fork too if the parent opened it."""
    p = _poi(pois.where("relation = 'EVENT_WRITE'"))
    forks = edges.where("relation = 'EVENT_FORK'").withColumn("p_src", F.col("dst"))
    w = Window.partitionBy("poi").orderBy(F.desc("timestamp_ns"), F.desc("edge_id"))
    parents = p.join(forks, "p_src").where(_within(lookback_ns, 0) & _same_host()).withColumn("k_", F.row_number().over(w)).where("k_ = 1")
    parents = parents.select("poi", F.col("src").alias("process"), F.col("edge_id").alias("fork"))
    actors = p.select("poi", F.col("p_src").alias("process")).union(parents.select("poi", "process")).distinct().join(p, "poi")
    opened = actors.join(edges.where(F.col("relation") == connect).withColumn("process", F.col("src")), "process").where(_same_host())
    used = opened.where((F.col("timestamp_ns") >= F.col("p_t") - lookback_ns) & (F.col("timestamp_ns") < F.col("p_t"))).select("poi", "dst").distinct()
    later = opened.where((F.col("timestamp_ns") > F.col("p_t")) & (F.col("timestamp_ns") <= F.col("p_t") + after_ns)).join(used, ["poi", "dst"], "left_anti")
    first = _first(later.select("poi", "edge_id", "src", "timestamp_ns").distinct(), 1)
    by_parent = first.join(parents, (first.poi == parents.poi) & (first.src == parents.process)).select(F.col("fork").alias("edge_id"))
    return first.select("edge_id").union(by_parent).distinct()


def program_after(edges: DataFrame, starts: DataFrame, programs: list[str], after_ns: int) -> DataFrame:
    """The first child of the given programs that a start event's process forks soon after it."""
    forks = edges.where("relation = 'EVENT_FORK'").where(program(F.col("dst_semantic")).isin(*programs)).withColumn("p_src", F.col("src"))
    return _first(_poi(starts).join(forks, "p_src").where(_within(0, after_ns) & _same_host()), 1).select("edge_id").distinct()


def network_episode(edges: DataFrame, pois: DataFrame, lookback_ns: int, after_ns: int, connect: str = "EVENT_CONNECT", send: str = "EVENT_SENDTO", most: int = 8) -> DataFrame:
    """The latest earlier connections of a network point of interest's process, and the first send to its socket."""
    p = _poi(pois.where(F.col("relation") == connect))
    prior = p.join(edges.where(F.col("relation") == connect).withColumn("p_src", F.col("src")), "p_src").where(_within(lookback_ns, 0) & (F.col("edge_id") != F.col("poi")))
    w = Window.partitionBy("poi").orderBy(F.desc("timestamp_ns"), F.desc("edge_id"))
    prior = prior.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= most)
    sends = p.join(edges.where(F.col("relation") == send).withColumn("p_dst", F.col("dst")), "p_dst").where(_within(0, after_ns))
    return prior.select("edge_id").union(_first(sends, 1).select("edge_id")).distinct()


def socket_group(key: Column) -> Column:
    """The /24 of a socket's IPv4 address, else its host; null for other keys."""
    host = F.regexp_replace(F.substring(key, 8, 10_000), r":[^:]*$", "")
    octets = F.split(host, r"\.")
    four = (F.size(octets) == 4) & F.forall(octets, lambda x: x.rlike(r"^\d{1,3}$") & (x.cast("int") <= 255))
    return F.when(key.startswith("socket:"), F.when(four, F.concat_ws(".", F.slice(octets, 1, 3))).otherwise(host))


def socket_port(key: Column) -> Column:
    """A socket's port; 65536, which sorts last, without one."""
    port = F.when(key.startswith("socket:"), F.regexp_extract(key, r":(\d+)$", 1))
    return F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.lit(65536))


def folder(key: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(key, 6, 10_000), r"^(.*)[/\\][^/\\]*$", 1))


def forward_execution(
    edges: DataFrame, pois: DataFrame, execution_ns: int, forward_ns: int, lookback_ns: int, connect: str = "EVENT_CONNECT", side_effects: int = 1, groups: int = 3,
) -> DataFrame:
    """A written file's execution by the writer or its child, up to three forks that lead to it, the writer's other writes before, and the program's first connections, one for each network."""
    p = _poi(pois.where("relation = 'EVENT_WRITE'")).where("p_name <> ''")
    soon = _within(0, execution_ns) & _same_host()
    runs = edges.where("relation = 'EVENT_EXECUTE'")
    forks = edges.where("relation = 'EVENT_FORK'")
    child = p.join(forks.select(F.col("src").alias("p_src"), F.col("dst").alias("child"), "timestamp_ns", "host"), "p_src").where(soon).select("poi", "child").distinct()
    named = program(F.col("dst_semantic")) == F.col("p_name")
    by_child = child.join(p, "poi")
    found = [
        by_child.join(runs.withColumn("child", F.col("dst")), "child").where(soon & named),
        p.join(runs.withColumn("p_src", F.col("src")), "p_src").where(soon & named),
        by_child.join(runs.withColumn("child", F.col("src")), "child").where(soon & (basename(F.col("dst_semantic")) == F.col("p_name"))),
    ]
    columns = ["poi", "p_src", "p_dst", "p_t", "p_host", "edge_id", "src", "dst", "dst_semantic", "timestamp_ns"]
    every = found[0].select(*columns).union(found[1].select(*columns)).union(found[2].select(*columns)).distinct()
    run = _first(every, 1).withColumnRenamed("timestamp_ns", "at").withColumnRenamed("edge_id", "execute")
    is_process = F.col("dst_semantic").startswith("process:")
    run = run.withColumn("actor", F.when(is_process, F.col("dst")).otherwise(F.col("src")))
    via = run.join(child.withColumn("src", F.col("child")), ["poi", "src"], "left").withColumn("born", F.when(F.col("child").isNotNull(), F.col("src")).otherwise(F.col("dst")))
    born = via.select("poi", "p_t", "p_host", "at", F.explode(F.array_distinct(F.array("born", "actor"))).alias("process"))
    led = born.join(forks.select(F.col("dst").alias("process"), "edge_id", "timestamp_ns", "host"), "process").where(_same_host() & F.col("timestamp_ns").between(F.col("p_t"), F.col("at")))
    latest = Window.partitionBy("poi").orderBy(F.desc("timestamp_ns"), F.desc("edge_id"))
    led = led.select("poi", "edge_id", "timestamp_ns").distinct().withColumn("k_", F.row_number().over(latest)).where("k_ <= 3")
    place = pois.select(F.col("edge_id").alias("poi"), folder(F.col("dst_semantic")).alias("p_folder"))
    wrote = run.select("poi", "p_src", "p_dst", "p_t", "p_host").join(place, "poi").join(edges.where("relation = 'EVENT_WRITE' and dst_semantic like 'file:%'").withColumn("p_src", F.col("src")), "p_src")
    wrote = wrote.where(_within(lookback_ns, 0) & _same_host() & (F.col("dst") != F.col("p_dst")))
    nearest = (folder(F.col("dst_semantic")) != F.col("p_folder"), F.desc("timestamp_ns"), F.col("edge_id"))
    wrote = wrote.withColumn("k_", F.row_number().over(Window.partitionBy("poi", "dst").orderBy(*nearest))).where("k_ = 1")
    wrote = wrote.withColumn("k_", F.row_number().over(Window.partitionBy("poi").orderBy(*nearest))).where(F.col("k_") <= side_effects)
    net = run.select("poi", "p_t", "p_host", "at", "actor").join(edges.where(F.col("relation") == connect).select(F.col("src").alias("actor"), "edge_id", "timestamp_ns", "host", F.col("dst_semantic").alias("to")), "actor")
    net = net.where(_same_host() & F.col("timestamp_ns").between(F.col("at"), F.col("p_t") + forward_ns)).withColumn("net", socket_group(F.col("to"))).where("net <> ''")
    order = ("timestamp_ns", socket_port(F.col("to")), "edge_id")
    net = net.withColumn("k_", F.row_number().over(Window.partitionBy("poi", "net").orderBy(*order))).where("k_ = 1")
    net = net.withColumn("k_", F.row_number().over(Window.partitionBy("poi").orderBy(*order))).where(F.col("k_") <= groups)
    parts = [run.select(F.col("execute").alias("edge_id")), led.select("edge_id"), wrote.select("edge_id"), net.select("edge_id")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def socket_origin(edges: DataFrame, pois: DataFrame, before_ns: int, after_ns: int, connect: str = "EVENT_CONNECT", receive: tuple[str, ...] = ("EVENT_READ", "EVENT_RECVFROM"), most: int = 80) -> DataFrame:
    """Of a written file: the reads of the socket that gave the writer or its parent most bytes around the write, the parent's fork, and the nearest connection and send to that socket."""
    p = _poi(pois.where("relation = 'EVENT_WRITE'"))
    around = _within(before_ns, after_ns) & _same_host()
    forks = edges.where("relation = 'EVENT_FORK'").select(F.col("dst").alias("p_src"), F.col("src").alias("process"), F.col("edge_id").alias("fork"), "timestamp_ns", "host")
    last = Window.partitionBy("poi").orderBy(F.desc("timestamp_ns"), F.desc("fork"))
    parents = p.join(forks, "p_src").where(_within(before_ns, 0) & _same_host()).withColumn("k_", F.row_number().over(last)).where("k_ = 1").select("poi", "process", "fork")
    actors = p.select("poi", F.col("p_src").alias("process")).union(parents.select("poi", "process")).distinct().join(p, "poi")
    got = edges.where(F.col("relation").isin(*receive) & ((F.col("src_type") == "socket") | F.col("src_semantic").startswith("socket:")))
    got = actors.join(got.select(F.col("dst").alias("process"), F.col("src").alias("socket"), "edge_id", "timestamp_ns", "host", F.greatest(F.lit(0), F.coalesce("data_size", F.lit(0))).alias("bytes")), "process").where(around)
    best = got.groupBy("poi", "socket").agg(F.struct(F.sum("bytes").alias("b"), F.count("*").alias("c"), F.col("socket").alias("s")).alias("x")).groupBy("poi").agg(F.max("x").alias("x")).select("poi", F.col("x.s").alias("socket"))
    reads = got.join(best, ["poi", "socket"])
    reads = reads.withColumn("k_", F.row_number().over(Window.partitionBy("poi").orderBy(F.desc("bytes"), "timestamp_ns", "edge_id"))).where(F.col("k_") <= most)
    near = lambda relation: _nearest(actors.join(best, "poi").join(edges.where(F.col("relation") == relation).select(F.col("src").alias("process"), F.col("dst").alias("socket"), "edge_id", "timestamp_ns", "host"), ["process", "socket"]).where(around))
    out = reads.select("edge_id").union(parents.join(best, "poi").select(F.col("fork").alias("edge_id")))
    for relation in (connect, "EVENT_SENDTO"):
        out = out.union(near(relation).select("edge_id"))
    return out.distinct()


def _nearest(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("poi").orderBy(F.abs(F.col("timestamp_ns") - F.col("p_t")), "edge_id")
    return found.withColumn("k_", F.row_number().over(w)).where("k_ = 1")


def shared_file_bridge(
    edges: DataFrame, pois: DataFrame, local_ns: int, span_ns: int, connect: str = "EVENT_CONNECT", receive: str = "EVENT_RECVFROM", opened: str = "EVENT_OPEN",
    receives: int = 8, files: int = 2, reads_per_file: int = 4, opens_per_file: int = 2,
) -> DataFrame:
    """A connection and a later write that are joined by a file which the first's process or child opened and the second's read; and the connection's replies."""
    host = lambda a, b: (F.coalesce(F.col(a), F.lit("")) == "") | (F.coalesce(F.col(b), F.lit("")) == "") | (F.col(a) == F.col(b))
    c = pois.where(F.col("relation") == connect).select(F.col("edge_id").alias("c"), F.col("src").alias("c_src"), F.col("dst").alias("c_dst"), F.col("timestamp_ns").alias("c_t"), F.col("host").alias("c_host"))
    w = pois.where("relation = 'EVENT_WRITE'").select(F.col("edge_id").alias("w"), F.col("src").alias("w_src"), F.col("timestamp_ns").alias("w_t"), F.col("host").alias("w_host"))
    if w.isEmpty():
        return pois.select("edge_id").limit(0)
    reply = c.join(edges.where(F.col("relation") == receive).select(F.col("src").alias("c_dst"), F.col("dst").alias("c_src"), "edge_id", "timestamp_ns", "host"), ["c_dst", "c_src"])
    reply = reply.where(host("host", "c_host") & F.col("timestamp_ns").between(F.col("c_t"), F.col("c_t") + local_ns))
    reply = reply.withColumn("k_", F.row_number().over(Window.partitionBy("c").orderBy("timestamp_ns", "edge_id"))).where(F.col("k_") <= receives)
    near = F.abs(F.col("timestamp_ns") - F.col("c_t")) <= local_ns
    fork = c.join(edges.where("relation = 'EVENT_FORK'").select(F.col("src").alias("c_src"), F.col("dst").alias("process"), F.col("edge_id").alias("fork"), "timestamp_ns", "host"), "c_src").where(host("host", "c_host") & near)
    last = Window.partitionBy("c", "process").orderBy(F.desc("timestamp_ns"), F.desc("fork"))  # of several forks of a child the last counts
    fork = fork.withColumn("k_", F.row_number().over(last)).where("k_ = 1").select("c", "process", "fork", F.col("timestamp_ns").alias("f_t"))
    actors = c.select("c", F.col("c_src").alias("process"), F.lit(None).cast("long").alias("f_t"), F.lit(True).alias("own")).union(fork.select("c", "process", "f_t", F.lit(False)))
    actors = actors.groupBy("c", "process").agg(F.max("own").alias("own"), F.max("f_t").alias("f_t")).join(c, "c")
    opens = actors.join(edges.where(F.col("relation") == opened).select(F.col("src").alias("process"), F.col("dst").alias("file"), F.col("edge_id").alias("open"), "timestamp_ns", "host"), "process")
    opens = opens.where(host("host", "c_host") & near & (F.col("own") | (F.col("f_t") <= F.col("timestamp_ns")))).select("c", "c_t", "c_host", "file", "open", "process", F.abs(F.col("timestamp_ns") - F.col("c_t")).alias("gap"))
    reads = w.join(edges.where("relation = 'EVENT_READ'").select(F.col("dst").alias("w_src"), F.col("src").alias("file"), F.col("edge_id").alias("read"), "timestamp_ns", "host"), "w_src")
    reads = reads.where(host("host", "w_host") & F.col("timestamp_ns").between(F.col("w_t") - local_ns, F.col("w_t"))).select("w", "w_t", "w_host", "file", "read", F.col("timestamp_ns").alias("r_t"))
    one, two = opens.select("c", "c_t", "c_host", "file").distinct(), reads.groupBy("w", "w_t", "w_host", "file").agg(F.max("r_t").alias("last"))
    shared = one.join(two, "file").where(F.col("w_t").between(F.col("c_t"), F.col("c_t") + span_ns) & host("c_host", "w_host"))
    shared = shared.withColumn("k_", F.row_number().over(Window.partitionBy("c", "w").orderBy(F.desc("last"), "file"))).where(F.col("k_") <= files).select("c", "w", "file")
    took = shared.join(reads, ["w", "file"]).withColumn("k_", F.row_number().over(Window.partitionBy("c", "w", "file").orderBy(F.desc("r_t"), F.desc("read")))).where(F.col("k_") <= reads_per_file)
    gave = shared.join(opens, ["c", "file"]).withColumn("k_", F.row_number().over(Window.partitionBy("c", "w", "file").orderBy("gap", "open"))).where(F.col("k_") <= opens_per_file)
    born = gave.join(fork, ["c", "process"])
    return reply.select("edge_id").union(took.select("read")).union(gave.select("open")).union(born.select("fork")).distinct()


def command_line_executions(pois: DataFrame, executions: DataFrame, delay_ns: int, most: int = 2) -> DataFrame:
    """Executions (edge_id, timestamp_ns, host, command) whose command line names an opened or written file soon after it."""
    p = _poi(pois.where("relation in ('EVENT_OPEN', 'EVENT_WRITE')")).where("p_name <> ''")
    # An equi-join on the words of the command that could be the name. A name's executions have places in time, and a point of
    # interest takes those after its own place, so that no name pairs all its executions with all its points of interest.
    lane = lambda c: F.concat(F.lit("host:"), F.coalesce(F.col(c), F.lit("")))
    lanes = F.when(F.coalesce("p_host", F.lit("")) == "", F.array(F.lit("all"))).otherwise(F.array(lane("p_host"), F.lit("host:")))
    asks = cut(p.select("poi", "p_t", "p_name", F.explode(lanes).alias("lane")))
    words = executions.withColumn("p_name", F.explode(F.array_distinct(F.split(F.lower("command"), r"[^\w.\-]+"))))
    words = words.withColumn("lane", F.explode(F.array(lane("host"), F.lit("all")))).join(asks.select("p_name", "lane").distinct(), ["p_name", "lane"], "left_semi")
    rows = words.select("p_name", "lane", "timestamp_ns", F.lit(1).alias("run"), "edge_id").unionByName(asks.select("p_name", "lane", F.col("p_t").alias("timestamp_ns"), F.lit(0).alias("run"), F.col("poi").alias("edge_id")))
    placed = cut(O.running(rows, ["p_name", "lane"], ["timestamp_ns", "run", "edge_id"], before=F.col("run").cast("long")))
    places = F.explode(F.sequence(F.col("before") + 1, F.col("before") + most)).alias("place")
    took = placed.where("run = 0").select("p_name", "lane", F.col("edge_id").alias("poi"), F.col("timestamp_ns").alias("p_t"), places)
    runs = placed.where("run = 1").select("p_name", "lane", "edge_id", "timestamp_ns", (F.col("before") + 1).alias("place"))
    found = took.join(runs, ["p_name", "lane", "place"]).where(_within(0, delay_ns))
    return _first(found, most).select("edge_id").distinct()
