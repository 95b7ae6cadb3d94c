"""Avro containers: splits, damage, codecs and the reader's schema, against values written by hand."""

import bz2
import gzip
import json
import lzma
import random
import zlib

import pyarrow as pa
import pytest

from trailgrain.sources import avro, cdm

SCHEMA = {
    "type": "record", "name": "D", "namespace": "x.y", "fields": [
        {"name": "datum", "type": [{"type": "record", "name": "Event", "fields": [
            {"name": "uuid", "type": {"type": "fixed", "name": "U", "size": 4}}, {"name": "n", "type": "long"}, {"name": "size", "type": ["null", "long"]}, {"name": "k", "type": {"type": "enum", "name": "K", "symbols": ["A", "B"]}},
            {"name": "m", "type": {"type": "map", "values": "string"}}, {"name": "l", "type": {"type": "array", "items": "double"}}, {"name": "b", "type": "boolean"}, {"name": "next", "type": ["null", "U"]},
        ]}, {"type": "record", "name": "Other", "fields": [{"name": "t", "type": "string"}]}, "string"]},
    ],
}


def values(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        body = {"uuid": f"{i:08x}", "n": rng.choice([0, -1, 63, 64, -65, 2**62, -(2**63)]), "size": rng.choice([None, i]), "k": rng.choice("AB"), "m": {"é": "ü" * (i % 5)} if i % 2 else {}, "l": [i / 3] * (i % 3), "b": i % 2 == 0, "next": None if i % 4 else "00ff00ff"}
        out.append({"datum": rng.choice([{"x.y.Event": body}, {"x.y.Other": {"t": f"t{i}"}}, f"plain {i}"])})
    return out


def container(rows, codec="null", a_block=7, sync=bytes(range(16))):
    pack = {
        "null": bytes, "deflate": lambda d: zlib.compress(d, wbits=-15), "bzip2": bz2.compress, "xz": lzma.compress,
        "snappy": lambda d: pa.Codec("snappy").compress(d).to_pybytes() + b"crc4",
    }
    encode, number = avro.encoder(SCHEMA), avro.encoder("long")
    out = avro.MAGIC + avro.encoder({"type": "map", "values": "bytes"})({"avro.schema": json.dumps(SCHEMA).encode().hex(), "avro.codec": codec.encode().hex()}) + sync
    places = []
    for i in range(0, len(rows), a_block):
        data = pack[codec](b"".join(encode(r) for r in rows[i : i + a_block]))
        places.append(len(out))
        out += number(len(rows[i : i + a_block])) + number(len(data)) + data + sync
    return out, places


def key(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


def got(frame):
    return key(json.loads(r.value) for r in frame.where("value is not null").collect())


def test_numbers_are_zigzag():
    assert [avro.encoder("long")(n) for n in (0, -1, 1, 64, -64)] == [b"\0", b"\1", b"\2", b"\x80\1", b"\x7f"]


@pytest.mark.parametrize("codec", ["null", "deflate", "bzip2", "xz", "snappy"])
def test_codecs_and_splits(spark, tmp_path, codec):
    rows = values(100)
    (tmp_path / "a.avro").write_bytes(container(rows, codec)[0])
    (tmp_path / "_hidden").write_bytes(b"no")
    for split in (50, 333, 10**9):
        frame = avro.read_avro(spark, str(tmp_path), split_bytes=split)
        assert got(frame) == key(rows)
    assert frame.where("v is null").isEmpty()


def test_gz_and_empty(spark, tmp_path):
    rows = values(30)
    (tmp_path / "a.avro.gz").write_bytes(gzip.compress(container(rows)[0]))
    (tmp_path / "b.avro").write_bytes(container([])[0])
    assert got(avro.read_avro(spark, f"file://{tmp_path}", split_bytes=40)) == key(rows)
    (tmp_path / "none").mkdir()
    assert avro.read_avro(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(Exception, match="FileNotFound"):
        avro.read_avro(spark, str(tmp_path / "absent")).collect()


def test_damage_is_counted(spark, tmp_path):
    rows = values(70)
    data, places = container(rows)
    (tmp_path / "cut.avro").write_bytes(data[: places[9] + 20])
    (tmp_path / "head.avro").write_bytes(b"text")
    broken = bytearray(data)
    broken[places[3] : places[3] + 2] = b"\x0e\x02"  # a size that ends before the marker
    (tmp_path / "mid.avro").write_bytes(bytes(broken))
    counts = {r.file.rpartition("/")[2]: (r.records, r.malformed) for r in cdm.malformed(avro.read_avro(spark, str(tmp_path), split_bytes=200)).collect()}
    assert counts == {"cut.avro": (63, 1), "head.avro": (0, 1), "mid.avro": (63, 1)}
    for name in counts:
        with pytest.raises(Exception, match="block at|Avro container"):
            avro.read_avro(spark, str(tmp_path / name), strict=True).collect()


def test_reader_schema(spark, tmp_path):
    rows = values(40)
    (tmp_path / "a.avro").write_bytes(container(rows)[0])
    event = {"type": "record", "name": "Event", "fields": [{"name": "n", "type": "long"}, {"name": "new", "type": "string", "default": "d"}]}
    wanted = {"type": "record", "name": "D", "namespace": "x.y", "fields": [{"name": "datum", "type": [event, "string", {"type": "record", "name": "Other", "fields": [{"name": "t", "type": "string"}]}]}]}
    want = [{"datum": {"x.y.Event": {"n": v["n"], "new": "d"}}} if (v := isinstance(r["datum"], dict) and r["datum"].get("x.y.Event")) else r for r in rows]
    assert got(avro.read_avro(spark, str(tmp_path), json.dumps(wanted))) == key(want)
    del event["fields"][1]["default"]
    with pytest.raises(Exception, match="no default"):
        avro.read_avro(spark, str(tmp_path), json.dumps(wanted)).collect()


def test_round_trip(spark, tmp_path):
    rows = values(500, 3)
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").repartition(3)
    avro.write_avro(frame, str(tmp_path / "out"), json.dumps(SCHEMA))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]) == 3
    back = avro.read_avro(spark, str(tmp_path / "out"), split_bytes=1000)
    assert got(back) == key(rows)
    kinds = cdm.records(back).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {k: sum(isinstance(r["datum"], dict) and f"x.y.{k}" in r["datum"] for r in rows) for k in ("Event", "Other")}
