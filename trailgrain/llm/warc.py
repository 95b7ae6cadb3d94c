"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id. The borders of the ranges, the parts, come from exact sums of bytes: ranges of ids that
hold too much are cut again until every part is near its share, so equal tables give equal parts whatever the session's
settings. A part's records go as gzip members to files under temporary names, and the next file begins where the compressed
size is reached. Headers and digests are made anew from the payload, without clock or chance, so that a task that runs
twice writes the same bytes. The driver renames the files that the finished tasks named and writes the manifest last; files
of lost attempts are deleted with the temporary folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrain.llm.shared import dropped, partitions, small_batches, stored

ROLL = 32 << 20
LEAST_PART, MOST_PARTS, CUTS = 16 << 20, 4096, 16
DATE = "2024-01-01T00:00:00Z"  # of all records; a parameter of write_warc
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*of: object) -> str:
    """A record's name, made from what tells it from all others."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, of)))}>"


def lined(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page: tuple, payload: bytes | None, digest: str, size: int, keeper: tuple | None, date: str) -> bytes:
    """One WARC record of a page (page_id, url, sha, how-manieth of equal rows); without payload it is a revisit of the keeper (page_id, url)."""
    page_id, url, sha, _ = page
    kind = "response" if payload is not None else "revisit"
    head = HTTP.format(size).encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(*page)}", f"WARC-Date: {date}"]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {urn(*keeper, sha, 0)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {keeper[0]}",
        ]
        if keeper[1] is not None:
            lines.append("WARC-Refers-To-Target-URI: " + lined(keeper[1]))
    if url is not None:
        lines.append("WARC-Target-URI: " + lined(url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_info(name: str, date: str) -> bytes:
    """The warcinfo record with which a file begins."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {urn('file', name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while version := stream.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {version[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, value = line.decode().split(": ", 1)
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def borders(sizes: DataFrame, roll: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where parts begin, from exact sums of sizes (id, sub, size).

    Three arrays: the first ids of ranges, the ranges that are one id with more than a part, which sub (0 .. 63) divides
    further, and the parts' first codes, a code being range * 64 + sub. There are at most about CUTS ranges a part.
    """
    row = sizes.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    lowest, highest, total = (int(x or 0) for x in row)
    part = max(LEAST_PART, min(4 * roll, total // 64), total // MOST_PARTS)
    firsts, widths = [lowest], [highest - lowest + 1]
    while True:
        sums = _sums(sizes, np.array(firsts, np.int64), np.zeros(0, np.int64))
        heavy = {r for r, n in sums.items() if n > part / 4 and widths[r // 64] > 1}
        if not heavy:
            break
        cut: list[tuple[int, int]] = []
        for k, (first, width) in enumerate(zip(firsts, widths, strict=True)):
            step = -(-width // CUTS) if k * 64 in heavy else width
            cut += [(first + i, min(step, width - i)) for i in range(0, width, step)]
        firsts, widths = [f for f, _ in cut], [w for _, w in cut]
    divided = np.array(sorted(r // 64 for r, n in sums.items() if n > part), np.int64)
    if len(divided):
        sums = _sums(sizes, np.array(firsts, np.int64), divided)
    begins, held = [], part
    for code in sorted(sums):
        if held + sums[code] > part and held:
            begins.append(code)
            held = 0
        held += sums[code]
    return np.array(firsts, np.int64), divided, np.array(begins or [0], np.int64)


def _codes(ids: np.ndarray, subs: np.ndarray, firsts: np.ndarray, divided: np.ndarray) -> np.ndarray:
    ranges = np.maximum(np.searchsorted(firsts, ids, "right") - 1, 0)
    return ranges * 64 + np.where(np.isin(ranges, divided), subs, 0)


def _sums(sizes: DataFrame, firsts: np.ndarray, divided: np.ndarray) -> dict[int, int]:
    """The sum of sizes for each code that occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, size = (b.column(c).to_numpy() for c in ("id", "sub", "size"))
            codes, at = np.unique(_codes(ids, subs, firsts, divided), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, at, size)
            yield pa.record_batch([pa.array(codes.astype(np.int64)), pa.array(total)], ["code", "size"])

    return {r.code: r["size"] for r in sizes.mapInArrow(count, "code long, size long").groupBy("code").agg(F.sum("size").alias("size")).collect()}


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, date: str = DATE) -> list[dict]:
    """Write pages (page_id, url, html) to folder, a URI that driver and executors share; returns the manifest.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads the one with the largest page_id is the
    response, and the others are revisits of it; rows that repeat its id and payload are responses too. Pages without any
    id among their equals are responses, and null ids sort first. Record names are made from page_id, url, digest and the
    number among equal rows, so they are unique. Other columns are ignored; no rows give no files.
    """
    import pyarrow.fs as fs

    spark = pages.sparkSession
    small_batches(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    names = stored(rows.select("page_id", "url", "sha", "size"), "names")
    found = names.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper.page_id is not null")
    verdicts = names.select("page_id", "sha").join(found.select("sha", "keeper"), "sha").distinct()
    sub = F.conv(F.substring("sha", 1, 2), 16, 10).cast("long") / 4
    lowest = F.coalesce("page_id", F.lit(names.agg(F.min("page_id")).first()[0] or 0).cast("long")).alias("id")
    firsts, divided, begins = borders(names.select(lowest, sub.cast("long").alias("sub"), (F.col("size") + 400).alias("size")), roll)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, subs: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, _codes(ids.to_numpy(), subs.to_numpy(), firsts, divided), "right") - 1).astype(np.int32)

    # A page's verdict is sorted just before it, so that payloads are shuffled once only.
    both = rows.withColumn("kind", F.lit(1)).unionByName(verdicts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("part", part_of(lowest, sub.cast("long")))
    ordered = both.repartition(partitions(spark), "part").sortWithinPartitions("part", "page_id", "sha", "kind", "url")
    attempt = f"{folder}/_tmp-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(attempt)
        store.create_dir(base, recursive=True)
        out, stream, state, verdict, last, turn = [], None, {}, None, None, 0

        def put(member: bytes) -> None:
            stream.write(member)
            state["bytes"] += len(member)
            state["sha"].update(member)

        def close() -> None:
            stream.close()
            out.append((*(state[c] for c in ("temporary", "name", "n", "bytes")), state["sha"].hexdigest(), state["first"], state["last"]))

        for b in batches:
            for page_id, url, payload, sha, size, keeper, kind, part in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "size", "keeper", "kind", "part")), strict=True):
                if kind == 0:
                    verdict = (page_id, sha, (keeper["page_id"], keeper["url"]))
                    continue
                keeper = verdict[2] if verdict and verdict[:2] == (page_id, sha) else None
                if keeper is not None and keeper[0] != page_id:
                    payload = None
                turn = turn + 1 if last == (page_id, url, sha) else 0
                last = (page_id, url, sha)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = gzip.compress(record((page_id, url, sha, turn), payload, digest, size, keeper, date), 6, mtime=0)
                if stream and (state["part"] != part or state["bytes"] + len(member) > roll):
                    close()
                    stream = None
                if not stream:
                    number = state["number"] + 1 if state and state["part"] == part else 0
                    name, temporary = f"part-{part:06d}-{number:04d}.warc.gz", f"{uuid.uuid4().hex}.open"
                    stream = store.open_output_stream(f"{base}/{temporary}")
                    state = {"temporary": temporary, "name": name, "part": part, "number": number, "n": 0, "bytes": 0, "sha": hashlib.sha256(), "first": page_id}
                    put(gzip.compress(file_info(name, date), 6, mtime=0))
                put(member)
                state["n"] += 1
                state["last"] = page_id
        if stream:
            close()
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["temporary", "name", "records", "bytes", "sha256", "first_id", "last_id"])

    written = stored(ordered.mapInArrow(write, "temporary string, name string, records long, bytes long, sha256 string, first_id long, last_id long"), "manifest")
    manifest = [r.asDict() for r in written.orderBy("name").collect()]  # a row for each file
    dropped(names)
    dropped(written)
    return commit(spark, folder, attempt, manifest)


def commit(spark: SparkSession, folder: str, attempt: str, manifest: list[dict]) -> list[dict]:
    """Give the named files their final names, delete the rest of the attempt, and write manifest.json last."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(conf)
    for row in manifest:
        if not store.rename(path(f"{attempt}/{row['temporary']}"), path(f"{folder}/{row['name']}")):
            raise OSError(f"{row['name']} could not be renamed")
    store.delete(path(attempt), True)
    rows = [{k: r[k] for k in r if k != "temporary"} for r in manifest]
    out = store.create(path(f"{folder}/manifest.json.open"), True)
    out.write(bytearray(json.dumps(rows, indent=1).encode()))
    out.close()
    store.rename(path(f"{folder}/manifest.json.open"), path(f"{folder}/manifest.json"))
    return rows


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in folder; block and payload digests are checked."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: None if text is None else int(text)
        for b in batches:
            for content in b.column("content"):
                rows = []
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as stream:
                    for head, block in records(io.BufferedReader(stream, 1 << 20)):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if base32_sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if base32_sha1(payload) != digest or len(payload) != size:
                                raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
                        rows.append((number(head.get("X-Page-ID")), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page"))))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
    return names.load(folder).select("content").mapInArrow(read, READ)
