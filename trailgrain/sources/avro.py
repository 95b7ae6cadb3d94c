"""Avro container files as lines of JSON for the CDM reader: a data source that splits files at their sync markers, and a writer.

A block belongs to the split in which the marker before it begins, so every block is read once however files are cut. Of a union,
records keep their full name ({"name": {..}}), other values stand for themselves; bytes become hex text.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "trailgrain_avro"
MAGIC, SYNC = b"Obj\x01", 16
SPLIT, CHUNK, BLOCK = 64 << 20, 1 << 20, 64 << 10  # bytes: of a split, of a search for a marker, of a written block
PLAIN = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
NAMED = ("record", "error", "enum", "fixed", "array", "map")
LINES = "file string, block long, position int, value string, fault string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


# Values. A schema is compiled to a function that reads one value from a stream.


def long(s: BinaryIO) -> int:
    n = shift = 0
    while True:
        b = s.read(1)
        if not b:
            raise EOFError("block ends within a number")
        n |= (b[0] & 127) << shift
        if b[0] < 128:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def raw(s: BinaryIO, n: int) -> bytes:
    out = s.read(n) if n >= 0 else b""
    if len(out) != n:
        raise EOFError("block ends within a value")
    return out


def full(schema: dict, space: str) -> tuple[str, str]:
    """The full name of a named schema and the name space in it."""
    name = schema["name"]
    own = name if "." in name else ".".join(x for x in (schema.get("namespace", space), name) if x)
    return own, own.rpartition(".")[0]


def decoder(schema: Any, wanted: Any = None, names: dict | None = None, targets: dict | None = None, space: str = "") -> Callable[[BinaryIO], Any]:
    """wanted: the reader's schema. Fields that it lacks are left out and fields that only it has get their default; other types must agree."""
    names, targets = {} if names is None else names, {} if targets is None else targets
    if isinstance(schema, str) and schema not in PLAIN:
        known = schema if schema in names else f"{space}.{schema}"
        return lambda s: names[known](s)
    if isinstance(schema, list):
        pick = lambda b: next((w for w in (wanted if isinstance(wanted, list) else [wanted]) if w is not None and _kind(w, targets) == _kind(b, {})), None)
        parts = [decoder(b, pick(b), names, targets, space) for b in schema]
        records = [full(b, space)[0] if isinstance(b, dict) and b["type"] == "record" else None for b in schema]

        def union(s: BinaryIO) -> Any:
            i = long(s)
            value = parts[i](s)
            return value if records[i] is None else {records[i]: value}

        return union
    kind = schema if isinstance(schema, str) else schema["type"]
    if not isinstance(kind, str) or (isinstance(schema, dict) and kind not in NAMED):
        return decoder(kind, wanted, names, targets, space)  # {"type": ..} around a schema, or a logical type
    if kind in ("record", "error"):
        name, inner = full(schema, space)
        names[name] = lambda s: read(s)
        if isinstance(wanted, str):
            wanted = targets.get(wanted.rpartition(".")[2])
        if isinstance(wanted, dict):
            targets[wanted["name"].rpartition(".")[2]] = wanted
        asked = {f["name"]: f for f in wanted["fields"]} if isinstance(wanted, dict) else None
        fields = [(f["name"], decoder(f["type"], asked[f["name"]]["type"] if asked and f["name"] in asked else None, names, targets, inner)) for f in schema["fields"]]
        extra = {n: f for n, f in (asked or {}).items() if n not in {x["name"] for x in schema["fields"]}}
        lacking = [n for n, f in extra.items() if "default" not in f]
        if lacking:
            raise ValueError(f"no default for fields {lacking} of {name}")

        def read(s: BinaryIO) -> dict:
            got = {n: f(s) for n, f in fields}
            return got if asked is None else {n: got[n] if n in got else f["default"] for n, f in asked.items()}

        return read
    if kind in ("enum", "fixed"):
        symbols, size = schema.get("symbols"), schema.get("size")
        names[full(schema, space)[0]] = own = (lambda s: symbols[long(s)]) if kind == "enum" else (lambda s: raw(s, size).hex())
        return own
    if kind in ("array", "map"):
        item = decoder(schema["items" if kind == "array" else "values"], None if not isinstance(wanted, dict) else wanted.get("items", wanted.get("values")), names, targets, space)
        one = item if kind == "array" else lambda s: (raw(s, long(s)).decode(), item(s))

        def many(s: BinaryIO) -> Any:
            out = []
            while n := long(s):
                if n < 0:
                    n = -n
                    long(s)
                out += [one(s) for _ in range(n)]
            return out if kind == "array" else dict(out)

        return many
    return {
        "null": lambda s: None, "boolean": lambda s: raw(s, 1) == b"\x01", "int": long, "long": long, "bytes": lambda s: raw(s, long(s)).hex(), "string": lambda s: raw(s, long(s)).decode(),
        "float": lambda s: struct.unpack("<f", raw(s, 4))[0], "double": lambda s: struct.unpack("<d", raw(s, 8))[0],
    }[kind]


def _kind(schema: Any, targets: dict) -> str:
    """What two branches of unions are matched by: the last part of a name, or the type."""
    if isinstance(schema, dict):
        return schema["name"].rpartition(".")[2] if "name" in schema else _kind(schema["type"], targets)
    return schema.rpartition(".")[2]


def encoder(schema: Any, names: dict | None = None, space: str = "") -> Callable[[Any], bytes]:
    """Of JSON values in the same form: a union's record as {"name": {..}}, other branches by their type."""
    names = {} if names is None else names
    number = lambda n: _bytes((n << 1) ^ (n >> 63))
    if isinstance(schema, str) and schema not in PLAIN:
        known = schema if schema in names else f"{space}.{schema}"
        return lambda v: names[known](v)
    if isinstance(schema, list):
        parts = [encoder(b, names, space) for b in schema]
        records = {full(b, space)[0]: i for i, b in enumerate(schema) if isinstance(b, dict) and b["type"] == "record"}
        other = [i for i, b in enumerate(schema) if i not in records.values() and b != "null"]

        def union(v: Any) -> bytes:
            if v is None:
                return number(schema.index("null"))
            name = next(iter(v)) if isinstance(v, dict) and len(v) == 1 else None
            i = records.get(name, other[0] if other else None)
            return number(i) + parts[i](v[name] if name in records else v)

        return union
    kind = schema if isinstance(schema, str) else schema["type"]
    if not isinstance(kind, str) or (isinstance(schema, dict) and kind not in NAMED):
        return encoder(kind, names, space)
    if kind in ("record", "error"):
        name, inner = full(schema, space)
        names[name] = lambda v: record(v)
        fields = [(f["name"], encoder(f["type"], names, inner)) for f in schema["fields"]]
        record = lambda v: b"".join(e(v.get(n)) for n, e in fields)
        return record
    if kind in ("array", "map"):
        item, text = encoder(schema["items" if kind == "array" else "values"], names, space), encoder("string")
        return lambda v: (number(len(v)) + b"".join(item(x) if kind == "array" else text(x) + item(v[x]) for x in v) if v else b"") + b"\0"
    if kind in ("enum", "fixed"):
        names[full(schema, space)[0]] = own = bytes.fromhex if kind == "fixed" else lambda v: number(schema["symbols"].index(v))
        return own
    text = lambda b: number(len(b)) + b
    return {
        "null": lambda v: b"", "boolean": lambda v: b"\x01" if v else b"\0", "int": number, "long": number, "string": lambda v: text(v.encode()), "bytes": lambda v: text(bytes.fromhex(v)),
        "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v),
    }[kind]


def _bytes(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


# Blocks.


def unpacked(codec: str, data: bytes) -> bytes:
    if codec == "snappy":  # the size in front, a checksum behind
        size = shift = i = 0
        while True:
            size |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return pa.Codec("snappy").decompress(data[:-4], size).to_pybytes()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {"null": bytes, "deflate": lambda d: zlib.decompress(d, -15), "bzip2": bz2.decompress, "xz": lzma.decompress}[codec](data)


def header(s: BinaryIO) -> tuple[dict, bytes]:
    if s.read(4) != MAGIC:
        raise ValueError("no Avro container")
    meta = decoder({"type": "map", "values": "bytes"})(s)
    return {k: bytes.fromhex(v) for k, v in meta.items()}, raw(s, SYNC)


def next_marker(s: BinaryIO, start: int, sync: bytes) -> int | None:
    """The place of the first marker from start on."""
    s.seek(start)
    held, at = b"", start
    while chunk := s.read(CHUNK):
        held += chunk
        found = held.find(sync)
        if found >= 0:
            return at + found
        at += max(0, len(held) - SYNC + 1)
        held = held[-(SYNC - 1) :]
    return None


def blocks(s: BinaryIO, start: int, end: int | None, sync: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(place, records, packed bytes) of the split's blocks; bytes are None where a block is broken, and reading goes on at the next marker."""
    at = next_marker(s, start, sync)
    while at is not None and (end is None or at < end):
        place = at + SYNC
        s.seek(place)
        if not s.read(1):
            return
        s.seek(place)
        try:
            count, data = long(s), raw(s, long(s))
            whole = s.read(SYNC) == sync
        except EOFError:
            whole = False
        if whole:
            yield place, count, data
            at = s.tell() - SYNC
        else:
            yield place, 0, None
            at = next_marker(s, place, sync)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.wanted, self.strict = options.get("readerschema"), options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Split]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in files:
            if f.type == fs.FileType.File and f.base_name[:1] not in "._":
                cuts = [0] if f.path.endswith(".gz") else range(0, max(1, f.size), self.split)
                out += [Split(f.path, c, None if f.path.endswith(".gz") or c + self.split >= f.size else c + self.split) for c in cuts]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f, gzip.open(f) if partition.path.endswith(".gz") else f as s:
            try:
                meta, sync = header(s)
                read = decoder(json.loads(meta["avro.schema"]), json.loads(self.wanted) if self.wanted else None)
            except (EOFError, ValueError, KeyError) as e:
                if self.strict or (self.wanted and isinstance(e, ValueError) and "no default" in str(e)):
                    raise
                if partition.start == 0:
                    yield partition.path, 0, 0, None, "header"
                return
            for place, count, data in blocks(s, partition.start, partition.end, sync):
                done = 0
                try:
                    if data is None:
                        raise EOFError("truncated block")
                    body = BytesIO(unpacked(meta.get("avro.codec", b"null").decode(), data))
                    for done in range(count):  # noqa: B007
                        yield partition.path, place, done, json.dumps(read(body)), None
                except Exception as e:  # what a damaged block raises depends on where and on the codec
                    if self.strict:
                        raise ValueError(f"block at {place} of {partition.path}: {e}") from e
                    yield partition.path, place, done, None, "truncated block" if data is None else "broken block"


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    """A container a task under a hidden name, which the commit makes visible; an aborted write leaves no visible file."""

    def __init__(self, options: dict) -> None:
        self.path, self.schema = options["path"], options["schema"]

    def write(self, rows: Iterator[Row]) -> Written:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        encode, sync, name = encoder(json.loads(self.schema)), uuid.uuid4().bytes, f"part-{uuid.uuid4().hex}.avro"
        with system.open_output_stream(f"{path}/.{name}") as out:
            meta = {"avro.schema": self.schema.encode().hex(), "avro.codec": b"deflate".hex()}
            out.write(MAGIC + encoder({"type": "map", "values": "bytes"})(meta) + sync)
            number, held, count = encoder("long"), bytearray(), 0

            def flush() -> None:
                packed = zlib.compress(bytes(held), wbits=-15)
                out.write(number(count) + number(len(packed)) + packed + sync)

            for r in rows:
                held += encode(json.loads(r[0]))
                count += 1
                if len(held) >= BLOCK:
                    flush()
                    held, count = bytearray(), 0
            if count:
                flush()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/.{m.name}", f"{path}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/.{m.name}")


class AvroSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def read_avro(spark: SparkSession, path: str, reader_schema: str | None = None, strict: bool = False, split_bytes: int = SPLIT) -> DataFrame:
    """Records of a container or a folder of them in the form of `cdm.read_lines`: file, value, v. .gz files are one split each.

    A broken block is a row without a record, which `cdm.malformed` counts, and so is a file without a header; strict raises instead. Empty files and
    names that begin with a dot or an underscore hold nothing.
    """
    spark.dataSource.register(AvroSource)
    own = spark.read.format(FORMAT).option("splitBytes", split_bytes).option("strict", str(strict).lower())
    rows = (own.option("readerSchema", reader_schema) if reader_schema else own).load(path)
    return rows.select("file", "value", F.expr("try_parse_json(value)").alias("v"))


def write_avro(lines: DataFrame, path: str, schema: str) -> None:
    """Write lines (value: JSON text, a union's record as {"name": {..}}) as deflated containers of an Avro schema."""
    lines.sparkSession.dataSource.register(AvroSource)
    lines.select("value").write.format(FORMAT).option("schema", schema).mode("append").save(path)
