"""Readers, ingest and the stream on small literal files."""

import json
import math

from pyspark.sql import functions as F

from trailgrain.operators import store
from trailgrain.sources import cdm, ecar
from trailgrain.streaming.arrivals import Arrivals

RECORDS = [
    {"datum": {"v20.Subject": {"uuid": "p1", "cmdLine": {"string": "bash"}, "hostId": "h", "parentSubject": {"com.UUID": "p0"}, "startTimestampNanos": 5}}},
    {"datum": {"v20.FileObject": {"uuid": "f1", "baseObject": {"properties": {"map": {"path": "/home/ann/x.sh"}}}, "hostId": "h"}}},
    {"datum": {"v20.NetFlowObject": {"uuid": "s1", "remoteAddress": "10.0.0.1", "remotePort": 443, "hostId": "h"}}},
    {"datum": {"v20.Event": {"uuid": "e1", "type": "EVENT_READ", "subject": {"com.UUID": "p1"}, "predicateObject": {"com.UUID": "f1"}, "timestampNanos": 7, "size": {"long": 12}, "hostId": "h"}}},
    {"datum": {"v20.Event": {"uuid": "e2", "type": "EVENT_WRITE", "subject": {"com.UUID": "p1"}, "predicateObject": {"com.UUID": "s1"}, "predicateObject2": {"com.UUID": "f1"}, "timestampNanos": 8, "size": {"long": -1}, "hostId": "h"}}},
    {"datum": {"v20.Event": {"uuid": "e3", "type": "EVENT_WRITE", "subject": {"com.UUID": "p9"}, "predicateObject": {"com.UUID": "f9"}, "predicateObjectPath": {"string": "/home/bob/n.txt"}, "timestampNanos": 9, "properties": {"map": {"exec": "vi", "bytesWritten": "77"}}, "hostId": "h"}}},
    {"datum": {"uuid": "f3", "baseObject": {"properties": {"map": {"path": "/etc/x"}}}}, "datumType": "v20.FileObject"},
]


def test_cdm(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, RECORDS), "{broken", ""]))
    lines = cdm.read_lines(spark, str(tmp_path))
    counts = cdm.malformed(lines).first()
    assert (counts.records, counts.malformed) == (7, 1)
    recs = cdm.records(lines)
    nodes = {r.uuid: r for r in cdm.nodes(recs).collect()}
    assert (nodes["p1"].label, nodes["p1"].semantic_key, nodes["p1"].node_type) == ("bash", "process:bash", "process")
    assert (nodes["f1"].label, nodes["f1"].semantic_key) == ("/home/ann/x.sh", "file:/home/*/x.sh")
    assert (nodes["s1"].label, nodes["s1"].semantic_key) == ("10.0.0.1:443", "socket:10.0.0.1:443")
    edges = {r.event_id: (r.src, r.dst, r.timestamp_ns, r.data_size) for r in cdm.edges(recs).collect()}
    assert edges == {"e1": ("f1", "p1", 7, 12), "e2": ("p1", "s1", 8, None), "e2:2": ("p1", "f1", 8, None), "LINEAGE:p1": ("p0", "p1", 5, None), "e3": ("p9", "f9", 9, 77)}
    assert (nodes["p9"].label, nodes["p9"].node_type, nodes["p9"].properties) == ("vi", "process", {"exec": "vi"})
    assert (nodes["f9"].label, nodes["f9"].semantic_key) == ("/home/bob/n.txt", "file:/home/*/n.txt")
    assert nodes["f3"].label == "/etc/x"


def test_cdm_sizes(spark, tmp_path):
    event = lambda k, **more: {"datum": {"v20.Event": {"uuid": f"e{k}", "type": "EVENT_READ", "subject": "p", "predicateObject": "f", **more}}}
    rows = [event(k, **{f: {"long": 10 + k}}) for k, f in enumerate(cdm.SIZE_FIELDS)]
    rows += [event(5 + k, properties={"map": {f: str(20 + k)}}) for k, f in enumerate(cdm.SIZE_FIELDS)]
    rows += [event(10, size=-4, byteCount=8), event(11, size="many"), event(12, dataSize=5)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.event_id: r.data_size for r in cdm.edges(cdm.records(cdm.read_lines(spark, str(tmp_path)))).collect()}
    assert got == {**{f"e{k}": 10 + k for k in range(5)}, **{f"e{5 + k}": 20 + k for k in range(5)}, "e10": 8, "e11": None, "e12": None}


def test_store(spark):
    nodes = spark.createDataFrame([("a", "file", "x", "h", "k", 1), ("a", "process", "", "", "k2", 2)], "uuid string, node_type string, label string, host string, semantic_key string, n int")
    one = store.upserted(nodes, "n")
    assert [tuple(r) for r in one.collect()] == [("a", "process", "x", "h", "k2")]
    rows = [("e", "a", "b", "R", 1, "h", 5), ("e", "a", "b", "R", 1, "h", 5), ("e", "a", "c", "R", 2, "h", None)]
    edges = store.deduplicated(spark.createDataFrame(rows, "event_id string, src string, dst string, relation string, timestamp_ns long, host string, data_size long"))
    got = sorted(edges.collect(), key=lambda r: r.timestamp_ns)
    assert [r.event_id[:2] for r in got] == ["e", "e#"]
    whole = store.with_placeholders(one, edges)
    assert {r.uuid: r.node_type for r in whole.collect()} == {"a": "process", "b": "unknown", "c": "unknown"}
    assert {r.dst_type for r in store.wide(edges, whole).collect()} == {"unknown"}


def test_ecar(spark, tmp_path):
    rows = [
        {"id": "1", "actorID": "A", "objectID": "O", "hostname": "h", "pid": 3, "object": "FILE", "action": "READ", "timestamp": "2024-01-01T00:00:00.000001+00:00", "properties": {"file_path": "C:\\x"}},
        {"id": "2", "actorID": "A", "objectID": "B", "hostname": "h", "pid": 3, "object": "PROCESS", "action": "CREATE", "timestamp": "2024-01-01T00:00:01+00:00", "properties": {"image_path": "b.exe", "parent_image_path": "a.exe"}},
        {"id": "2", "actorID": "A", "objectID": "C", "hostname": "h", "pid": 3, "object": "PROCESS", "action": "CREATE", "timestamp": "2024-01-01T00:00:02+00:00", "properties": {}},
        {"id": "3", "actorID": "A", "objectID": "O", "hostname": "g", "pid": 3, "object": "MODULE", "action": "LOAD", "timestamp": "2024-01-01T00:00:02+00:00", "properties": {}},
    ]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    edges = ecar.ecar_edges(ecar.read_ecar(spark, str(tmp_path)))
    got = {(r.id, r.target): r for r in edges.collect()}
    assert len(got) == 3
    r = got["1", "A"]
    assert (r.source, r.source_label, r.source_type, r.target_label, r.timestamp_ns) == ("O", "C:\\x", "file", "进程 PID 3", 1704067200000001000)
    assert (got["2", "B"].source_label, got["2", "B"].target_label) == ("a.exe", "b.exe")
    assert [r.id for r in ecar.conflicts(edges).collect()] == ["2"]
    assert {r.target for r in ecar.corpus(edges, "h", 1 << 62).collect()} == {"A", "B"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"e{i % 17 if i > 20 else i}", "p", "R" if i % 3 else "W", "f", 100 - i if i % 5 == 0 else i * 10) for i in range(30)]
    frame = spark.createDataFrame(rows, "seq long, event_id string, src_type string, relation string, dst_type string, timestamp_ns long")
    for k in range(3):
        frame.where((F.col("seq") >= 10 * k) & (F.col("seq") < 10 * k + 10)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    a = Arrivals(spark, f"{tmp_path}/state", window=1000)
    a.run(stream, f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.seq: r for r in a.scored().collect()}
    seen, n, counts, latest = set(), 0, {}, None
    for seq, event_id, _, relation, _, t in rows:
        if event_id in seen:
            assert seq not in got
            continue
        seen.add(event_id)
        assert math.isclose(got[seq].rarity, math.log((n + 2) / (counts.get(relation, 0) + 1)) / math.log(n + 2))
        assert got[seq].late == (latest is not None and t < latest)
        n, latest = n + 1, t if latest is None else max(latest, t)
        counts[relation] = counts.get(relation, 0) + 1


def test_sysdig(spark, tmp_path):
    import uuid

    from trailgrain.sources import sysdig

    lines = [
        "7 40.000000250 1 3 tar czf (881) > write cwd=/srv/ fd=6(<f>/srv/out 1.tgz) size=4096",
        "8 40.000000900 1 3 tar czf (881) < write res=4096 exepath=/usr/bin/tar",
        "9 41.25 0 3 rsync (902) > read fd=2(<f>backup/./list) cwd=/var size=30",
        "10 41.26 0 3 rsync (902) < read res=30 exepath=<NA>",
        "11 41.27 0 3 rsync (902) < read res=-5(EIO) name=/var/none",
        "12 42.0 2 3 make (903) < vfork res=904",
        "13 42.1 2 3 make (904) < execveat res=0 exe=./bin//lint cwd=/opt/tool",
        "14 42.2 2 3 make (904) > connect fd=9(<6t>fe80::1:70->fe80::2:8443)",
        "15 42.3 2 3 make (904) < connect res=0",
        "16 42.4 2 3 make (904) > open name=/var/log/old(deleted)",
        "17 42.5 2 3 make (904) < open fd=4(/proc/4) res=4 name=link(/var/log/new)",
        "not a line",
        "18 42.6 2 3 make (904) < futex res=0",
    ]
    (tmp_path / "t.log").write_text("\n".join(lines))
    read = sysdig.read_sysdig(spark, str(tmp_path))
    assert read.where("event is null").count() == 1
    events = sysdig.sysdig_events(read, "h")
    got = {r.event_id: r for r in events.collect()}
    assert set(got) == {f"sysdig:{k}" for k in (8, 10, 12, 13, 15, 17)}
    file = "sysdig:file:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "sysdig:h:file:/srv/out 1.tgz"))
    tar = "sysdig:process:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "sysdig:h:process:881"))
    a, b = got["sysdig:8"], got["sysdig:10"]
    assert (a.src, a.dst, a.relation, a.timestamp_ns, a.data_size, a.src_label) == (tar, file, "EVENT_WRITE", 40_000_000_900, 4096, "/usr/bin/tar")
    assert (b.src_label, b.relation, b.timestamp_ns, b.dst_label) == ("/var/backup/list", "EVENT_READ", 41_260_000_000, "rsync")
    assert got["sysdig:12"].dst_label == "904"
    assert got["sysdig:13"].dst_label == "/opt/tool/bin/lint"
    assert got["sysdig:15"].dst_label == "fe80::1:70->fe80::2:8443"
    assert got["sysdig:17"].dst_label == "/var/log/new"
    assert sysdig.latest_write(events, "/srv/out 1.tgz", 4096).first().event_id == "sysdig:8"
    assert sysdig.latest_write(events, "/srv/out 1.tgz", 1).first().event_id == "sysdig:8"


def write(tmp_path, name, content):
    (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(tmp_path / name)


def test_manifests(spark, tmp_path):
    import pytest

    from trailgrain.sources import manifests as M

    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(M.poi_manifest(spark, write(tmp_path, "a", "﻿# two\nx1\n\n x2 # second\n"))) == [("x1", None, None, None), ("x2", None, None, None)]
    assert rows(M.poi_manifest(spark, write(tmp_path, "b", ["x1"]))) == [("x1", None, None, None)]
    grouped = {"event_ids": ["a", "b"], "seed_event_groups": [{"group_id": "g", "seed_event_ids": ["a"], "window_start_ns": 1, "window_end_ns": 9}, {"group_id": "h", "seed_event_ids": ["b"]}]}
    assert rows(M.poi_manifest(spark, write(tmp_path, "c", grouped))) == [("a", "g", 1, 9), ("b", "h", None, None)]
    for bad in (["x", "x"], {"event_ids": ["z"], "seed_event_groups": grouped["seed_event_groups"]}, {"seed_event_groups": [{"group_id": "g", "seed_event_ids": ["a"], "window_start_ns": 1}]}):
        with pytest.raises(ValueError):
            M.poi_manifest(spark, write(tmp_path, "bad", bad))
    notes = {"name": "n", "seed_event_ids": ["a"], "attack_event_ids": ["b", "c"], "attack_node_uuids": ["u"], "attack_paths": [["b", "c"]]}
    got = M.annotations(spark, write(tmp_path, "d", notes))
    assert rows(got["events"]) == [("a", "seed"), ("b", "attack"), ("c", "attack")]
    assert rows(got["paths"]) == [(0, 0, "b"), (0, 1, "c")]
    with pytest.raises(ValueError):
        M.annotations(spark, write(tmp_path, "e", {"name": "n", "attack_event_ids": ["b"]}))
    line = {"event_ids": ["a", "b", "c"], "paths": [["a", "c"], ["b"]]}
    assert rows(M.timeline(spark, write(tmp_path, "f", line), 2)) == [(0, "a", 0, 0), (1, "b", 1, 0)]
    for paths in ([["c", "a"], ["b"]], [["a"], ["b"]], [["a", "b"], ["b", "c"]]):
        with pytest.raises(ValueError):
            M.timeline(spark, write(tmp_path, "bad", line | {"paths": paths}))
    assert rows(M.csv_labels(spark, write(tmp_path, "g.csv", "ab-1,\"{'k': \"\"v\"\", 'n': 1}\"\n\n"))) == [("AB-1", "{'k': \"v\", 'n': 1}")]
    assert M.properties(spark, write(tmp_path, "h", "# c\nPOI = /x=y\ndetectionSize=12\n")) == {"POI": "/x=y", "detectionSize": "12"}


def test_raw_corpus(spark, tmp_path):
    import pytest

    from trailgrain.sources import corpus as K

    (tmp_path / "in").mkdir()
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / "in" / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        lines = K.raw_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 5003
    assert all(r.value.split() == [r.file.rsplit("/", 1)[1], str(r.line)] for r in lines)
    frame = spark.createDataFrame([("1", "x", "h"), ("1", "x", "h"), ("2", "y", "h")], "id string, a string, host string")
    assert sorted(r.id for r in K.checked(frame, "id", ["a", "host"]).collect()) == ["1", "2"]
    for more in (("1", "z", "h"), ("3", " ", "h")):
        with pytest.raises(ValueError):
            K.checked(frame.union(spark.createDataFrame([more], frame.schema)), "id", ["a", "host"])
    nodes = spark.createDataFrame([("u", "old"), ("v", "own")], "uuid string, label string")
    labels = spark.createDataFrame([("f2", 1, "u", "late"), ("f1", 9, "u", "first"), ("f1", 10, "u", "second"), ("f1", 1, "U", "other")], "file string, line int, uuid string, name string")
    assert {r.uuid: r.label for r in K.labelled(nodes, labels).collect()} == {"u": "first", "v": "own"}
