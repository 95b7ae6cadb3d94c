"""Substring deduplication with an FM-index: words in a window that also starts anywhere else go.

Pieces that could share a window meet in a block (see `pieces`). Each shard of a block gets an FM-index: the
Burrows-Wheeler transform of its word numbers in a wavelet matrix of packed bits with rank counts. Texts are streamed
through every shard's index from their last word to their first, all in step: backward search extends the match by a
word, and where it can't, the match falls back to the enclosing common-prefix interval. That gives at each word the
longest match that occurs often enough, the matching statistics; matches of a window or more are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailgrain.llm import arrays as A
from trailgrain.llm.pieces import SPAN, keyed, repeated, runs_by_key, word_units

SHARD = 1 << 20


def substring_deduplicate(documents: DataFrame, window: int = 35, gram: int = 8, shard: int = SHARD) -> DataFrame:
    """Rows of documents (doc_id, text) with `kept` (the kept words, joined by a space), n_words and n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`. A word is removed if a window of `window` words covers it whose words also start
    at another place of the corpus, in the same document or elsewhere; all copies go. Windows are judged on the input.
    Null text has no words; null doc_ids are documents like others; of rows equal in doc_id and text all are treated
    alike and each counts as a place; other columns are ignored. Texts of fewer words than a window stay whole, and
    an empty table gives no rows.
    """
    if not 1 <= gram < window:
        raise ValueError("gram must be from 1 to window - 1")
    docs = keyed(documents)
    spans = repeated(docs, word_units, window, gram, False, lambda ask, blob: index_repeats(ask, blob, window, shard))

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs = runs_by_key(found)
        ids, kept, sizes, removed = [], [], [], []
        for doc_id, key, text in zip(*(texts.column(c) for c in ("doc_id", "key", "text")), strict=True):
            words = (text.as_py() or "").encode().split()  # bytes.split() cuts at just these six characters
            at, left = 0, []
            for s, e in runs.get(key.as_py(), ()):
                left += words[at:s]
                at = e
            left += words[at:]
            ids.append(doc_id.as_py()), kept.append(b" ".join(left).decode()), sizes.append(len(words)), removed.append(len(words) - len(left))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.string()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(apply, "doc_id long, kept string, n_words long, n_removed long")


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time; bits are packed 64 to a word, with a count for each word."""

    def __init__(self, codes: np.ndarray, n_symbols: int) -> None:
        self.levels, self.bits = [], max(1, int(n_symbols - 1).bit_length())
        seq = codes.astype(np.uint32)
        for shift in range(self.bits - 1, -1, -1):
            bit = (seq >> np.uint32(shift)) & np.uint32(1)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.uint32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = int(len(seq) - bit.sum())
            self.levels.append((shift, packed, counts, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        symbols = np.arange(n_symbols)
        self.base = self._walk(symbols, np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((A.U(1) << (at & 63).astype(np.uint64)) - A.U(1)))
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._walk(symbols, at) - self.base[symbols]


class FMIndex:
    """Symbols 1 .. n_symbols - 1, with 0 after each piece; common prefixes are known up to cap."""

    def __init__(self, codes: np.ndarray, n_symbols: int, cap: int) -> None:
        self.n = len(codes)
        sa, _ = A.suffix_array(codes, max(2, int(n_symbols + 1).bit_length()))
        self.lcp = A.common_prefixes(codes, sa, cap).astype(np.uint8 if cap < 256 else np.int32)
        self.bwt = WaveletMatrix(np.where(sa > 0, codes[sa - 1], 0), n_symbols)
        self.first = np.append(0, np.cumsum(np.bincount(codes, minlength=n_symbols)))[:n_symbols]
        self.minima = [self.lcp]  # of 1, 2, 4 .. neighbours
        while (1 << len(self.minima)) <= self.n + 1:
            half = 1 << (len(self.minima) - 1)
            below = self.minima[-1]
            self.minima.append(np.minimum(below[: len(below) - half], below[half:]))

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + match from the intervals of the matches."""
        both = self.first[np.tile(symbols, 2)] + self.bwt.rank(np.tile(symbols, 2), np.concatenate([lo, hi]))
        return both[: len(lo)], both[len(lo) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest common-prefix interval with a shorter prefix, and that prefix's length."""
        size = np.maximum(self.lcp[lo], self.lcp[hi])
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            least, width = self.minima[k], 1 << k
            at = lo - width + 1
            go = (at >= 0) & (least[np.maximum(at, 0)] >= size) & (size > 0)
            lo[go] -= width
            go = (hi + width <= self.n + 1) & (least[np.minimum(hi, len(least) - 1)] >= size) & (size > 0)
            hi[go] += width
        whole = size == 0
        lo[whole], hi[whole] = 0, self.n
        return lo, hi, size.astype(np.int64)

    def matching_statistics(self, texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, often: int) -> np.ndarray:
        """For each place of texts[start : start + size] the length of the longest match there that occurs `often` times.

        Lengths over the cap may come out shorter, but not under the cap. Symbols from n_symbols on never match.
        """
        out = np.zeros(len(texts), np.int64)
        lo, hi, size = np.zeros(len(starts), np.int64), np.full(len(starts), self.n), np.zeros(len(starts), np.int64)
        left = sizes.astype(np.int64).copy()
        while True:
            lanes = np.flatnonzero(left > 0)
            if not len(lanes):
                return out
            left[lanes] -= 1
            at = starts + left
            while len(lanes):
                symbols = texts[at[lanes]]
                new_lo, new_hi = self.extend(symbols, lo[lanes], hi[lanes])
                fits = new_hi - new_lo >= often
                good = lanes[fits]
                lo[good], hi[good] = new_lo[fits], new_hi[fits]
                size[good] += 1
                out[at[good]] = size[good]
                lanes = lanes[~fits]
                stuck = size[lanes] == 0
                lo[lanes[stuck]], hi[lanes[stuck]] = 0, self.n
                lanes = lanes[~stuck]
                if len(lanes):
                    lo[lanes], hi[lanes], size[lanes] = self.parent(lo[lanes], hi[lanes])


def index_repeats(ask: np.ndarray, blob: np.ndarray, window: int, limit: int = SHARD) -> np.ndarray:
    """SPAN records of the windows of one block's judged pieces that occur at another place of its pieces."""
    if not len(ask):
        return np.zeros(0, SPAN)
    sizes = ask["len"].astype(np.int64)
    names, codes = np.unique(blob, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    judged = np.flatnonzero(ask["judge"] == 1)
    best = np.zeros(len(codes), np.int64)
    first, ends = 0, np.cumsum(sizes + 1)
    while first < len(ask):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
        own, n = np.arange(first, after), int(sizes[first:after].sum())
        seq = np.zeros(n + len(own), np.int64)
        seq[np.arange(n) + np.repeat(np.arange(len(own)), sizes[own])] = codes[begin[first] : begin[first] + n]
        index = FMIndex(seq, len(names) + 1, window)
        inside = (judged >= first) & (judged < after)
        for lanes, often in ((judged[inside], 2), (judged[~inside], 1)):  # a piece finds itself in its own shard
            if len(lanes):
                np.maximum(best, index.matching_statistics(codes, begin[lanes], sizes[lanes], often), out=best)
        first = after
    hit = np.flatnonzero(best >= window)
    piece = np.searchsorted(begin, hit, "right") - 1
    out = np.zeros(len(hit), SPAN)
    out["key"], out["start"] = ask["key"][piece], ask["start"][piece] + hit - begin[piece]
    out["end"] = out["start"] + best[hit]
    return out
