"""Byte-level BPE encoding and decoding by recursive queries.

A partition's texts are cut into words by the tokenizer's pattern; each word that the worker has not met lately goes to
DuckDB as rows (word, position, token), one for each byte. A recursive query joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of minimum rank, until no pair is left; ordered aggregation gives the ids.
Decoding is a query of its own: rows (text, position, id) join the vocabulary, and ordered aggregation gives the bytes.

Words are first cut where no token of the vocabulary can cross, which changes no result: the parts are shorter and more
often met again. A recursion keeps a copy of a part for each contraction; so the few parts that are longer than LONG bytes
are contracted over a linked list with a heap instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.shared import Recent, small_batches

CACHE = 300_000  # words, and parts of words, in each of the two parts of their caches
BATCH = 10_000
CHARACTERS = 1_500_000  # of texts that are coded together
TOKENS = 500_000  # that are decoded together
LONG = 256  # bytes
_CODERS: dict = {}

# A row is a token with the position after it and the token there. The token after a contracted pair comes from the row of its second part.
STEP = """
  SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.after ELSE s.after END AS after,
    CASE WHEN s.pos = b.pos THEN b.merged ELSE s.token END AS token,
    CASE WHEN s.pos = b.pos THEN b.following WHEN s.after = b.pos THEN b.merged ELSE s.following END AS following, s.round + 1 AS round
  FROM {rows} s JOIN (
    SELECT c.word, c.pos, c.gone, c.merged, y.after, y.following FROM (
      SELECT p.word, min((m.merged << 32) | p.pos) & 4294967295 AS pos, min((m.merged << 32) | p.pos) >> 32 AS merged, arg_min(p.after, (m.merged << 32) | p.pos) AS gone
      FROM {rows} p JOIN merges m ON p.token = m.head AND p.following = m.tail GROUP BY p.word) c
    JOIN {rows} y ON y.word = c.word AND y.pos = c.gone) b
  ON s.word = b.word WHERE s.pos <> b.gone
"""
RECURSION = f"""
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE steps AS (
  SELECT word, pos, after, token, following, 0 AS round FROM start
  UNION ALL
  {STEP.format(rows="steps")})
SELECT s.word, s.pos, s.token FROM steps s JOIN (SELECT word, max(round) AS round FROM steps GROUP BY word) USING (word, round)
"""
GATHERED = "SELECT word, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) AS ids FROM done GROUP BY word"
DECODED = "SELECT list(v.bytes ORDER BY t.pos) AS bytes FROM tokens t JOIN vocabulary v USING (token)"


A8 = np.uint64(8)


def _hashed(runs: np.ndarray) -> np.ndarray:
    return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


class Coder:
    """Words to their ids, and ids to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.pattern = regex.compile(pattern)
        self.ranks, self.words, self.parts = ranks, Recent(self.learn, CACHE), Recent(self.contract, CACHE)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.merges = {(a, b): r for a, b, r in merges}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self._table("merges", **dict(zip(("head", "tail", "merged"), np.array(merges, np.int64).T, strict=True)))
        self._table("vocabulary", token=np.array(list(ranks.values()), np.int64), bytes=list(ranks))
        # Of tokens of two and of three bytes those bytes, of longer ones all runs of four, hashed.
        self.runs = [np.zeros(1 << 16, bool), np.zeros(1 << 24, bool), np.zeros(1 << 24, bool)]
        for t in ranks:
            if 2 <= len(t) <= 3:
                self.runs[len(t) - 2][int.from_bytes(t)] = True
        fours = {int.from_bytes(t[i : i + 4]) for t in ranks for i in range(len(t) - 3)}
        self.runs[2][_hashed(np.array(sorted(fours), np.uint64))] = True

    def _table(self, name: str, **columns: np.ndarray | list) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def cut(self, raw: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The parts of words, cut wherever no token can cross, and how many there are up to each word's end.

        A token that crosses is a run of two or three bytes there, or holds one of four.
        """
        lengths = np.array([len(x) for x in raw], np.int64)
        joined = b"".join(raw)
        data, ends = np.frombuffer(joined, np.uint8).astype(np.uint64), np.cumsum(lengths)
        inside = np.ones(len(data) - 1, bool)  # places between two bytes of one word
        inside[ends[:-1] - 1] = False
        crossed, runs, whole = np.zeros(len(data) - 1, bool), data, np.ones(len(data), bool)
        for k, known in enumerate(self.runs, 1):
            runs = (runs[:-1] << A8) | data[k:]
            whole = whole[:-1] & inside[k - 1 :]
            hit = known[_hashed(runs) if k == 3 else runs.astype(np.int64)] & whole
            for i in range(k):
                crossed[i : i + len(hit)] |= hit
        places = np.append(np.flatnonzero(~crossed) + 1, len(data))
        starts = [0, *places[:-1].tolist()]
        return [joined[i:j] for i, j in zip(starts, places.tolist(), strict=True)], np.searchsorted(places, ends, "right").tolist()

    def learn(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """Each word's ids, as decimals joined by commas; a word that is a token is that token."""
        others = []
        for w in words:
            rank = self.ranks.get(w.encode())
            if rank is None:
                others.append(w)
            else:
                yield w, str(rank)
        if others:
            parts, ends = self.cut([w.encode() for w in others])
            ids, i = self.parts.find([parts])[0], 0
            for w, j in zip(others, ends, strict=True):
                yield w, ids[i] if j == i + 1 else ",".join(ids[i:j])
                i = j

    def contract(self, parts: list[bytes]) -> Iterator[tuple[bytes, str]]:
        """Each part's ids."""
        todo = sorted((p for p in parts if len(p) <= LONG), key=len)
        i = 0
        while i < len(todo):
            j, size = i, 0
            while j < len(todo) and j - i < BATCH and (j == i or size * len(todo[j]) < 4_000_000):
                size += len(todo[j])
                j += 1
            yield from self._contracted(todo[i:j])
            i = j
        yield from ((p, self._by_heap(p)) for p in parts if len(p) > LONG)

    def _contracted(self, raw: list[bytes]) -> Iterator[tuple[bytes, str]]:
        lengths = np.array([len(x) for x in raw])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), lengths)
        at = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = self.of_byte[joined]
        same = np.append(word[1:] == word[:-1], False)
        self._table("start", word=word, pos=at, token=tokens, after=at + 1, following=np.where(same, np.append(tokens[1:], -1), -1))
        self.db.execute(RECURSION)
        for k, ids in self.db.execute(GATHERED).fetchall():
            yield raw[k], ids

    def _by_heap(self, raw: bytes) -> str:
        n = len(raw)
        token, after, before = [int(self.of_byte[x]) for x in raw], list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: self.merges.get((token[i], token[after[i]])) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if token[i] < 0 or pair(i) != rank:
                continue
            gone = after[i]
            token[i], token[gone], after[i] = rank, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return ",".join([str(t) for t in token if t >= 0])

    def encode(self, texts: list[str]) -> list[str]:
        """For each text its ids as decimals joined by commas."""
        return [",".join(ids) for ids in self.words.find([self.pattern.findall(t) for t in texts])]

    def decode(self, ids: list[str]) -> list[bytes]:
        """The bytes of each text's ids."""
        counts = np.array([x.count(",") + 1 if x else 0 for x in ids], np.int64)
        tokens = np.fromstring(",".join([x for x in ids if x]), np.int64, sep=",") if counts.any() else np.zeros(0, np.int64)
        self._table("tokens", pos=np.arange(len(tokens)), token=tokens)
        parts = self.db.execute(DECODED).to_arrow_table().column("bytes").combine_chunks().values
        if len(parts) != len(tokens):
            raise ValueError("an id is not in the vocabulary")
        if not len(tokens):
            return [b""] * len(ids)
        wide = pa.types.is_large_binary(parts.type)
        offsets = np.frombuffer(parts.buffers()[1], np.int64 if wide else np.int32)[parts.offset : parts.offset + len(parts) + 1]
        ends, data = offsets[np.append(0, np.cumsum(counts))].tolist(), parts.buffers()[2]
        return [bytes(data[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def coder(path: str, pattern: str) -> Coder:
    """One for each worker process, so that tasks share what it has learnt."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit in all, or one row."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def byte_bpe(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of documents: doc_id, ids (decimals joined by commas) and n_tokens.

    Each match of the pattern is encoded by itself, without special tokens. Null and empty texts have no tokens. Rows are
    treated one by one whatever their doc_id; columns other than doc_id and text are ignored; no rows give no rows.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = coder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices([len(t) for t in texts], CHARACTERS):
                ids = run.encode(texts[i:j])
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(ids, pa.string()), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(code, "doc_id long, ids string, n_tokens long")


def byte_bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of encoded texts with `decoded` (binary), which is read from their ids alone: doc_id, ids, n_tokens, decoded.

    Null and empty ids are no bytes. Ids that the vocabulary does not hold raise an error.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = coder(path, pattern)
        for b in batches:
            ids = [x or "" for x in b.column("ids").to_pylist()]
            for i, j in slices([len(x) for x in ids], 5 * TOKENS):
                yield pa.record_batch([*(b.column(c).slice(i, j - i) for c in ("doc_id", "ids", "n_tokens")), pa.array(run.decode(ids[i:j]), pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(code, "doc_id long, ids string, n_tokens long, decoded binary")
