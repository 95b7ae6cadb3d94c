"""Routing for repeated passages: windows of a fixed length meet in the block that their smallest gram names.

Every window of `window` units (bytes or words) holds window - gram + 1 grams; the one with the smallest hash, the
leftmost of equals, names the window's block. Equal windows choose equal grams, so they meet, whatever surrounds them.
Neighbouring windows with one chosen gram travel together as a piece. A block first collapses equal pieces (copies of
a passage, however many), and only where different pieces share a gram does it ask for their text, which goes to the
suffix array or FM-index of the operator. Blocks are records packed into binary columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm import arrays as A
from trailgrain.llm.shared import partitions, small_batches, stored

POSITION = A.U((1 << 20) - 1)
PIECE = np.dtype([("mini", "u8"), ("sk", "u8"), ("doc", "i8"), ("key", "i8"), ("start", "i4"), ("len", "i2"), ("many", "u1")])
SPAN = np.dtype([("key", "i8"), ("start", "i4"), ("end", "i4")])
ASK = np.dtype([("mini", "u8"), ("doc", "i8"), ("key", "i8"), ("start", "i4"), ("len", "i2"), ("judge", "u1")])
ROW = "block int, kind int, payload binary, units binary"
PIECES, SPANS, ASKS = 0, 1, 2
FLUSH = 300_000
NO_ID = np.iinfo(np.int64).min


def cut(codes: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The pieces of rows of units: chosen gram, content hash, row, first unit in the row, length."""
    found = []
    for base in range(0, max(len(codes) - window + 1, 0), A.CHUNK):
        sub = codes[base : base + A.CHUNK + window - 1]
        key = A.gram_hashes(sub, gram)[: len(sub) - gram + 1]
        key = (key & ~POSITION) | np.arange(len(key), dtype=np.uint64)
        least = A.sliding_min(key, window - gram + 1)
        n = len(least)
        lo, hi = np.maximum(offs[1:] - window + 1, offs[:-1]) - base, offs[1:] - base  # starts too near to their row's end
        step = np.bincount(np.clip(lo, 0, n), minlength=n + 1) - np.bincount(np.clip(hi, 0, n), minlength=n + 1)
        valid = np.flatnonzero(np.cumsum(step[:n]) == 0)
        if not len(valid):
            continue
        chosen = least[valid]
        new = np.ones(len(valid), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        heads = np.flatnonzero(new)
        first, last = valid[heads], valid[A.tails(heads, len(valid)) - 1]
        row = np.searchsorted(offs, first + base, "right") - 1
        found.append((chosen[heads] & ~POSITION, A.span_hashes(sub, first, last + window), row, first + base - offs[row], last - first + window))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A.BYTE_CODE[data], offs


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = A.words(data, offs)
    return A.word_hashes(data, starts, ends), rows


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans with the same key; touching spans join."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans["start"], spans["key"]))]
    _, row = np.unique(spans["key"], return_inverse=True)
    start, end = (row << 33) + spans["start"], (row << 33) + spans["end"]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(spans), bool)
    new[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    out = np.zeros(len(heads), SPAN)
    out["key"], out["start"] = spans["key"][heads], spans["start"][heads]
    tails = A.tails(heads, len(spans)) - 1
    out["end"] = reach[tails] - (row[tails] << 33)
    return out


def dealt(records: np.ndarray, block: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes, None]]:
    block = block.astype(np.int64)
    order = np.argsort(block, kind="stable")
    records, block = records[order], block[order]
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    for i, j in zip(heads, A.tails(heads, len(block)), strict=True):
        yield int(block[i]), kind, records[i:j].tobytes(), None


def batch(rows: list[tuple]) -> pa.RecordBatch:
    block, kind, payload, units = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary()), pa.array(units, pa.binary())], ["block", "kind", "payload", "units"])


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(rows)])


def records(payloads: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.to_pylist()), dtype)


def collapse(p: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Equal pieces become one: the earliest, marked as one of many. Second result: what is thereby known to be removed.

    keep_first: the earliest of equal pieces stays whole; else every piece that has an equal is removed.
    """
    order = np.argsort(A.mix(p["mini"] ^ (p["sk"] * A.U(0x9E3779B97F4A7C15))))
    p = p[order]
    new = np.ones(len(p), bool)
    new[1:] = (p["mini"][1:] != p["mini"][:-1]) | (p["sk"][1:] != p["sk"][:-1]) | (p["len"][1:] != p["len"][:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    alone = sizes[group] == 1
    rest = p[~alone]
    if not len(rest):
        return p, np.zeros(0, SPAN)
    rest_group = group[~alone]
    order = np.lexsort((rest["start"], rest["doc"], rest_group))
    rest, rest_group = rest[order], rest_group[order]
    first = np.diff(rest_group, prepend=-1) != 0
    out = rest[first].copy()
    out["many"] = 1
    least = np.repeat(rest[first], np.diff(np.append(np.flatnonzero(first), len(rest))))
    later = (rest["doc"] != least["doc"]) | (rest["start"] != least["start"]) if keep_first else np.ones(len(rest), bool)
    gone = rest[later]
    spans = np.zeros(len(gone), SPAN)
    spans["key"], spans["start"], spans["end"] = gone["key"], gone["start"], gone["start"] + gone["len"]
    return np.concatenate([p[alone], out]), merged(spans)


def repeated(documents: DataFrame, units: Callable, window: int, gram: int, keep_first: bool, judge: Callable) -> DataFrame:
    """Stored rows (block, payload of SPAN records): what the repeated windows cover, dealt by the document's key.

    documents: columns key, doc_id, text, block. judge(records, blob) finds the repeats among different pieces of one
    block and returns SPAN records.
    """
    blocks = 4 * partitions(documents.sparkSession)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            p, spans = collapse(np.concatenate(held), keep_first)
            return batch([*dealt(p, A.mix(p["mini"]) % A.U(blocks), PIECES), *dealt(spans, spans["key"] % blocks, SPANS)])

        for b in batches:
            data, offs = A.text_bytes(b.column("text"))
            doc = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            key = b.column("key").to_numpy(zero_copy_only=False)
            for i, j in A.row_chunks(offs):
                codes, unit_offs = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                mini, sk, row, start, length = cut(codes, unit_offs, window, gram)
                p = np.zeros(len(mini), PIECE)
                p["mini"], p["sk"], p["doc"], p["key"], p["start"], p["len"] = mini, sk, doc[i:j][row], key[i:j][row], start, length
                held.append(p)
                size += len(p)
                if size >= FLUSH:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    def matched(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rows = list(zip(t.column("block").to_pylist(), kind, t.column("payload").to_pylist(), t.column("units").to_pylist(), strict=True)) if (kind == SPANS).any() else []
        out = [r for r in rows if r[1] == SPANS]
        p = records(t.column("payload").filter(pa.array(kind == PIECES)), PIECE)
        if len(p):
            p, spans = collapse(p, keep_first)
            out += dealt(spans, spans["key"] % blocks, SPANS)
            p = p[np.argsort(p["mini"], kind="stable")]
            new = np.diff(p["mini"], prepend=p["mini"][:1] + A.U(1)) != 0
            run = np.cumsum(new) - 1
            p = p[np.bincount(run)[run] > 1]
            ask = np.zeros(len(p), ASK)
            for c in ("mini", "doc", "key", "start", "len"):
                ask[c] = p[c]
            ask["judge"] = 1 if keep_first else p["many"] == 0
            out += dealt(ask, ask["key"] % blocks, ASKS)
        return table(out)

    first = stored(documents.select("doc_id", "key", "text").mapInArrow(pieces_of, ROW).groupBy("block").applyInArrow(matched, ROW), "matched")

    def texts_of(docs: pa.Table, asks: pa.Table) -> pa.Table:
        ask = records(asks.column("payload"), ASK)
        if not len(ask) or not docs.num_rows:
            return table([])
        ask = ask[np.argsort(ask["key"], kind="stable")]
        docs = docs.combine_chunks()
        key = docs.column("key").to_numpy()
        _, kept = np.unique(key, return_index=True)
        docs = docs.take(pa.array(kept[np.isin(key[kept], ask["key"])]))
        out: list[tuple] = []
        for b in docs.to_batches():
            data, offs = A.text_bytes(b.column("text"))
            key = b.column("key").to_numpy(zero_copy_only=False)
            for i, j in A.row_chunks(offs, 4 * A.CHUNK):
                codes, unit_offs = (data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) if units is byte_units else units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                mine = ask[np.isin(ask["key"], key[i:j])]
                order = np.argsort(key[i:j])
                row = order[np.searchsorted(key[i:j], mine["key"], sorter=order)]
                block = (A.mix(mine["mini"]) % A.U(blocks)).astype(np.int64)
                by = np.argsort(block, kind="stable")
                mine, row, block = mine[by], row[by], block[by]
                length = mine["len"].astype(np.int64)
                at = np.repeat(unit_offs[row] + mine["start"] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                blob, ends = codes[at], np.append(0, np.cumsum(length))
                heads = np.flatnonzero(np.diff(block, prepend=-1))
                for x, y in zip(heads, A.tails(heads, len(block)), strict=True):
                    out.append((int(block[x]), PIECES, mine[x:y].tobytes(), blob[ends[x] : ends[y]].tobytes()))
        return table(out)

    unit_type = np.uint8 if units is byte_units else np.uint64

    def judged(t: pa.Table) -> pa.Table:
        ask = records(t.column("payload"), ASK)
        spans = merged(judge(ask, np.frombuffer(b"".join(t.column("units").to_pylist()), unit_type)))
        return table(list(dealt(spans, spans["key"] % blocks, SPANS)))

    asks = first.where(f"kind = {ASKS}")
    second = stored(documents.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(texts_of, ROW).groupBy("block").applyInArrow(judged, ROW), "judged")
    return first.where(f"kind = {SPANS}").select("block", "payload").union(second.select("block", "payload"))


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, a key of both (rows that are equal in both are treated alike) and the block that the key names."""
    small_batches(documents.sparkSession)
    blocks = 4 * partitions(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    return docs.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))


def runs_by_key(spans: pa.Table) -> dict[int, np.ndarray]:
    """For each document key its maximal removed runs, as rows (start, end)."""
    s = merged(records(spans.column("payload"), SPAN))
    if not len(s):
        return {}
    heads = np.flatnonzero(np.diff(s["key"], prepend=s["key"][:1] + 1) != 0)
    pairs = np.stack([s["start"], s["end"]], 1).astype(np.int64)
    return {int(s["key"][i]): pairs[i:j] for i, j in zip(heads, A.tails(heads, len(s)), strict=True)}


__all__ = ["ASK", "SPAN", "byte_units", "cut", "keyed", "merged", "repeated", "runs_by_key", "word_units"]
