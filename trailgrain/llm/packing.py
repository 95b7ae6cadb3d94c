"""Cost-balanced packing of token sequences.

Documents are tokenised once and stored. They are dealt by hash into groups of a few hundred sequences' worth of tokens;
a group opens as many sequences as its tokens fill and gives its documents, the most costly first, to the sequence of
the lowest cost so far that has room, the cost of a piece being linear plus quadratic in its length (attention within
pieces). Documents longer than a sequence are cut to whole sequences first, and what fits whole in no sequence is cut.
Equal rows are dealt to different groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.shared import Recent, small_batches, stored

CAPACITY = 4096
GROUP = 512  # sequences in a group, about
END = 2
CACHE = 350_000  # words in each of the two parts of the cache
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END_OF_LETTERS = re.compile(rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])")
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch  # words that the tokenizer neither changes nor cuts
#: How a byte-level vocabulary writes bytes: printable ones as themselves, the others in order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_TOKENIZERS: dict = {}


class WordTokenizer:
    """A tokenizer that lower-cases and drops white space, with a bounded cache of encoded words.

    Ids of a text are those of its words one after another, as no token, normal form or special token crosses ASCII
    white space. A-Z are lowered before, and words are cut where ASCII letters or digits end at an ASCII sign other than
    the apostrophe, where the tokenizer always cuts; that gives the same tokens and fewer different words. Texts that may
    hold special tokens are left as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), Recent(self.learn, CACHE)
        self.type, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, 16 bits each where the vocabulary allows."""
        cut = []
        for text in texts:
            raw = text.encode()
            if b"<|" not in raw:
                raw = END_OF_LETTERS.sub(b" ", raw.translate(LOWER))
            cut.append(raw.split())
        return [b"".join(ids) for ids in self.words.find(cut)]

    def learn(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Encode new words: those of lower-case letters by the model alone, the others many in one text whose offsets tell the words."""
        run, others = self.tokenizer.model.tokenize, []
        for w in words:
            if LETTERS(w.decode()):
                yield w, array(self.code, [t.id for t in run(w.decode("latin-1").translate(SHOWN))]).tobytes()
            else:
                others.append(w)
        for i in range(0, len(others), 2000):
            part = [w.decode() for w in others[i : i + 2000]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, self.type).tobytes()
            ends = np.cumsum([len(w) + 1 for w in part])
            at = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), np.append(0, ends)) * np.dtype(self.type).itemsize
            yield from ((w, ids[a:b]) for w, a, b in zip(others[i : i + 2000], at[:-1].tolist(), at[1:].tolist(), strict=True))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, row (a number of the row), n_tokens and ids (16 bits each where the vocabulary allows) of each text, with the end id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tokenizer(path)
        end = np.array([END], run.type).tobytes()
        for b in batches:
            ids = [x + end for x in run([t or "" for t in b.column("text").to_pylist()])]
            yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "row", "n_tokens", "ids"])

    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return docs.mapInArrow(encode, "doc_id long, row long, n_tokens long, ids binary")


def assign(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group of documents of these sizes.

    As many sequences as the tokens fill; all are full but for less than one sequence's room in all.
    """
    total = int(sizes.sum())
    n_sequences = -(-total // capacity)
    pieces: list[tuple[int, int, int, int, int]] = []
    whole, rest = 0, []
    for d, n in enumerate(sizes.tolist()):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, whole, 0))
            whole += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    used, cost = np.zeros(n_sequences - whole, np.int64), np.zeros(n_sequences - whole)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, whole + s, int(used[s])))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    def cheapest(room: int) -> int:
        """The sequence of the lowest cost among those with room, or -1."""
        s = int(np.argmin(np.where(used <= capacity - room, cost, np.inf)))
        return s if used[s] <= capacity - room else -1

    for n, d, start in rest:
        if (s := cheapest(n)) >= 0:
            put(d, start, n, s)
            continue
        while n:
            s = cheapest(1)
            take = min(n, capacity - int(used[s]))
            put(d, start, take, s)
            start, n = start + take, n - take
    return pieces


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Rows of pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (unsigned 32 bits).

    Null and empty texts are one token, the end id. Rows that are repeated are packed as often as they occur; null
    doc_ids are packed like others; columns other than doc_id and text are ignored. An empty table gives no pieces.
    """
    tokens = stored(tokenized(documents, path), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, total // (capacity * group))
    kind = tokenizer(path).type

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        number = t.column("g")[0].as_py()
        docs, sizes, ids = t.column("doc_id").to_pylist(), t.column("n_tokens").to_numpy(), t.column("ids")
        rows, raw, last = [], b"", -1
        for d, start, n, s, offset in sorted(assign(sizes, capacity)):
            if d != last:
                raw, last = np.frombuffer(ids[d].as_py(), kind).astype("<u4"), d
            piece = raw[start : start + n].tobytes()
            rows.append((docs[d], start, n, zlib.crc32(piece), int(sizes[d]), (number << 32) | s, offset, piece))
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        columns = list(zip(*rows, strict=True))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=False)} | {"ids": pa.array(columns[7], pa.binary())})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return tokens.withColumn("g", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups))).groupBy("g").applyInArrow(place, schema)
