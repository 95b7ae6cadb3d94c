"""Texts of Arrow batches as numpy arrays: words, polynomial hashes, suffix arrays and common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_random = np.random.default_rng(20240607)
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit hashes over all bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        made = np.full(max(n, CHUNK) + 1, base, np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if n <= 4 * CHUNK:
            _POWERS[base] = have
    return have


_INVERSE = pow(_BASE, -1, 1 << 64)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[start:end] for each span, with its length mixed in. Spans lie within one chunk."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, _INVERSE)[starts] + (ends - starts).astype(np.uint64) * _ODD)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty), and the row offsets into them."""
    column = pc.fill_null(column, "").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - (offs[0] if len(offs) else 0)


def row_chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most limit bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each row, and row offsets into them."""
    inside = WORD_BYTE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(data):
        edges = offs[(offs > 0) & (offs < len(data))]
        before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of each word; long inputs are worked off in pieces, so that memory does not grow with a text."""
    if len(data) <= 2 * CHUNK:
        return span_hashes(table[data], starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        at = starts[i]
        out[i:j] = span_hashes(table[data[at : ends[j - 1]]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k codes, by doubling; the last k - 1 places are 0."""
    n, out = len(codes), np.zeros(len(codes), np.uint64)
    if n < k:
        return out
    pw, level, size, done = powers(64), codes, 1, 0
    total = np.zeros(n - k + 1, np.uint64)
    while True:
        if k & size:
            total = total * pw[size] + level[done : done + n - k + 1]
            done += size
        size *= 2
        if size > k:
            break
        half = size // 2
        level = level[: len(level) - half] * pw[half] + level[half:]
    out[: n - k + 1] = mix(total)
    return out


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of key[i : i + w] for each i with a whole window."""
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    rest = w - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def tails(heads: np.ndarray, n: int) -> np.ndarray:
    """Ends of the runs that start at heads, of n places in all."""
    return np.append(heads[1:], n)[: len(heads)].astype(np.int64)


def suffix_array(codes: np.ndarray, bits: int, depth: int | None = None, coarse: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: order suffixes by a packed prefix, then refine only groups that are still equal, doubling the length.

    codes: unsigned, under 2 ** bits - 1. depth: stop when suffixes are ordered by that many codes. Returns the suffix array and ranks;
    with coarse, those, the ranks by the longest prefix of at most that many codes, and its length.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, have = codes.astype(np.uint64) + U(1), 1
    while have * 2 * bits <= 64:
        ahead = np.zeros(n, np.uint64)
        ahead[: n - have] = key[have:]
        key = (key << U(have * bits)) | ahead
        have *= 2
    sa = np.argsort(key).astype(np.int64)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.zeros(n + 1, np.int64)
    heads = np.flatnonzero(new)
    rank[sa] = np.repeat(heads, (tails(heads, n) - heads)) + 1
    alive = np.ones(n, bool)
    alive[:-1] = ~(new[:-1] & new[1:])
    alive[-1] = not new[-1]
    where = np.flatnonzero(alive)
    early, early_have = rank[:n].copy() if coarse else rank[:0], have
    while len(where) and (depth is None or have < depth):
        at = sa[where]
        group = rank[at]
        ahead = np.where(at + have < n, rank[np.minimum(at + have, n)], 0)
        key = (group.astype(np.uint64) << U(32)) | ahead.astype(np.uint64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[where] = at
        new = np.ones(len(where), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        sizes = tails(heads, len(where)) - heads
        rank[at] = np.repeat(where[heads], sizes) + 1
        where = where[np.repeat(sizes > 1, sizes)]
        have *= 2
        if coarse and have <= coarse:
            early, early_have = rank[:n].copy(), have
    return (sa, (rank[:n], early, early_have)) if coarse else (sa, rank[:n])


def common_prefixes(codes: np.ndarray, sa: np.ndarray, cap: int, ranks: tuple | None = None, lanes: int = 4096) -> np.ndarray:
    """Kasai's algorithm over many stretches of the text in step: lcp[r] of the suffixes at r - 1 and r, up to cap.

    Each lane walks its stretch from left to right and keeps its common prefix less one, as Kasai does.
    ranks: those of a suffix array to a depth of cap or more, with coarse <= cap. Neighbours with different coarse ranks
    then get 0 (they share fewer than cap codes), and neighbours that are equal to the depth get cap; as their order is
    arbitrary, nothing is kept from them. The others start at the coarse length.
    """
    n = len(sa)
    lcp = np.zeros(n + 1, np.int64)
    if n < 2:
        return lcp
    least = 0
    if ranks is None:
        spots = np.sort(sa[1:])
    else:
        rank, coarse, least = ranks
        tied = rank[sa[1:]] == rank[sa[:-1]]
        lcp[1:n][tied] = cap
        spots = np.sort(sa[1:][~tied & (coarse[sa[1:]] == coarse[sa[:-1]])])
    if not len(spots):
        return lcp
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    lanes = max(1, min(lanes, len(spots) // 64))
    step = -(-len(spots) // lanes)
    padded = np.concatenate([codes.astype(np.int64), [-1]])
    at, stop = np.arange(lanes) * step, np.minimum((np.arange(lanes) + 1) * step, len(spots))
    go = at < stop
    at, stop = at[go], stop[go]
    held, last = np.zeros(len(at), np.int64), np.full(len(at), -2)
    while len(at):
        here = spots[at]
        r = isa[here]
        other = sa[r - 1]
        held[here != last + 1] = 0
        np.maximum(held, least, out=held)
        active = np.flatnonzero(held < cap)
        while len(active):
            a, b = here[active] + held[active], other[active] + held[active]
            same = (a < n) & (b < n)
            same &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
            active = active[same]
            held[active] += 1
            active = active[held[active] < cap]
        lcp[r] = held
        last = here
        held = np.maximum(held - 1, 0)
        at = at + 1
        go = at < stop
        if not go.all():
            at, stop, held, last = at[go], stop[go], held[go], last[go]
    return lcp


def spanning(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Links (node, root) with the same connected groups as the pairs (left[x], right[y])."""
    nodes, at = np.unique(np.concatenate([left[x], right[y]]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)
