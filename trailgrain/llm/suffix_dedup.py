"""Suffix-array deduplication: bytes under a long enough string that also starts earlier in the corpus go.

Different pieces that could share such a string meet in a block (see `pieces`); there, shards get suffix arrays by
Larsson-Sadakane refinement, Kasai's common prefixes group equal strings, and a string of one shard finds its group
in the shards before by binary search. The earliest start of a group stays, the others are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailgrain.llm import arrays as A
from trailgrain.llm.pieces import SPAN, byte_units, keyed, repeated, runs_by_key

SEPARATOR = 0xF8  # no UTF-8 text holds it
SHARD = 1 << 22


def suffix_deduplicate(documents: DataFrame, length: int = 100, gram: int = 24, shard: int = SHARD, as_text: bool = False) -> DataFrame:
    """Rows of documents (doc_id, text) with `kept` (binary), n_bytes, n_removed and n_spans.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a smaller doc_id, or in the
    same document before. Strings are judged on the input and never cross documents. Null text counts as empty, null
    doc_id as smaller than all others; rows equal in doc_id and text are treated alike, as the same document; other
    columns are ignored. Empty and short texts keep everything; an empty table gives no rows.

    as_text: instead, one row (key, kept) for each doc_id and text, kept being text from which characters that lost a byte are gone.
    """
    if not 1 <= gram < length:
        raise ValueError("gram must be from 1 to length - 1")
    docs = keyed(documents)
    spans = repeated(docs, byte_units, length, gram, True, lambda ask, blob: shard_repeats(ask, blob, length, shard))

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs = runs_by_key(found)
        ids, kept, sizes, removed, counts = [], [], [], [], []
        for doc_id, key, text in zip(*(texts.column(c) for c in ("doc_id", "key", "text")), strict=True):
            raw = (text.as_py() or "").encode()
            own = runs.get(key.as_py(), ())
            at, parts = 0, []
            for s, e in own:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            left = b"".join(parts)
            ids.append(doc_id.as_py()), kept.append(left), sizes.append(len(raw)), removed.append(len(raw) - len(left)), counts.append(len(own))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64())})

    def apply_text(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs = runs_by_key(found)
        kept: dict[int, str] = {}
        for key, text in zip(texts.column("key"), texts.column("text"), strict=True):
            if (k := key.as_py()) in kept:
                continue
            raw = (text.as_py() or "").encode()
            ends = [0, *np.ravel(runs.get(k, ())).astype(int).tolist(), len(raw)]
            kept[k] = "".join(raw[a:b].decode(errors="ignore") for a, b in zip(ends[::2], ends[1::2], strict=True))  # only the ends of a part can be broken
        return pa.table({"key": pa.array(kept.keys(), pa.int64()), "kept": pa.array(kept.values(), pa.string())})

    if as_text:
        return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(apply_text, "key long, kept string")
    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def shard_repeats(ask: np.ndarray, blob: np.ndarray, length: int, limit: int = SHARD) -> np.ndarray:
    """SPAN records of the strings in one block's pieces that also start earlier."""
    sizes = ask["len"].astype(np.int64)
    ends = np.cumsum(sizes + 1)
    first, shards, at = 0, [], np.append(0, np.cumsum(sizes))
    while first < len(ask):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
        shards.append(Shard(ask[first:after], blob[at[first] : at[after]], length))
        first = after
    groups = 0
    for j, own in enumerate(shards):  # a group keeps one number in all shards
        number = np.full(len(own.heads), -1)
        for before in shards[:j]:
            open_ = np.flatnonzero(number < 0)
            number[open_] = before.find(own, own.sa[own.heads[open_]])
        new = number < 0
        number[new] = groups + np.arange(new.sum())
        groups += int(new.sum())
        own.number = number
    where = [s.windows() for s in shards]
    if not where:
        return np.zeros(0, SPAN)
    group, doc, start, key = (np.concatenate(x) for x in zip(*where, strict=True))
    order = np.lexsort((start, doc, group))
    group, doc, start, key = group[order], doc[order], start[order], key[order]
    head = np.diff(group, prepend=-1) != 0
    least = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    later = (doc != doc[least]) | (start != start[least])
    out = np.zeros(int(later.sum()), SPAN)
    out["key"], out["start"], out["end"] = key[later], start[later], start[later] + length
    return out


class Shard:
    """Pieces with their suffix array; heads are the first ranks of groups of equal strings."""

    def __init__(self, ask: np.ndarray, blob: np.ndarray, length: int) -> None:
        sizes = ask["len"].astype(np.int64)
        self.ask, self.length = ask, length
        self.offs = np.cumsum(sizes + 1) - sizes - 1
        self.codes = np.full(int(sizes.sum()) + len(ask), SEPARATOR, np.uint8)
        self.codes[np.arange(len(blob)) + np.repeat(np.arange(len(ask)), sizes)] = blob
        sa, ranks = A.suffix_array(self.codes, 8, length, coarse=length)
        lcp = A.common_prefixes(self.codes, sa, length, ranks)
        piece = np.searchsorted(self.offs, sa, "right") - 1
        whole = self.offs[piece] + sizes[piece] - sa >= length  # equal strings are all whole or all not
        self.sa, self.piece, joins = sa[whole], piece[whole], lcp[:-1][whole] >= length
        if len(joins):
            joins[0] = False
        self.heads = np.flatnonzero(~joins)
        self.number = np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, ...]:
        sizes = A.tails(self.heads, len(self.sa)) - self.heads
        of = self.ask[self.piece]
        return np.repeat(self.number, sizes), of["doc"], of["start"] + self.sa - self.offs[self.piece], of["key"]

    def find(self, other: Shard, starts: np.ndarray) -> np.ndarray:
        """By binary search over this shard's groups, the group number of other's string at each start, or -1."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.heads))
        mine = self.sa[self.heads] if len(self.heads) else np.zeros(0, np.int64)
        while (lo < hi).any():
            open_ = np.flatnonzero(lo < hi)
            mid = (lo[open_] + hi[open_]) // 2
            less = self._compare(mine[mid], other, starts[open_]) < 0
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        out = np.full(len(starts), -1)
        inside = np.flatnonzero(lo < len(mine))
        hit = inside[self._compare(mine[lo[inside]], other, starts[inside]) == 0]
        out[hit] = self.number[lo[hit]]
        return out

    def _compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        sign, open_ = np.zeros(len(mine), np.int64), np.arange(len(mine))
        for i in range(self.length):
            a, b = self.codes[mine[open_] + i].astype(np.int64), other.codes[theirs[open_] + i].astype(np.int64)
            sign[open_] = np.sign(a - b)
            open_ = open_[a == b]
            if not len(open_):
                break
        return sign

