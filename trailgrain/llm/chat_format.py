"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, `<|im_start|>role\\ntext<|im_end|>\\n` for each turn, encoded once with character offsets,
and the spans of its turns are intersected with those of its tokens by binary search. The control strings are tokens of their
own, so no token crosses a turn's end. Texts cannot forge them: each `<|` in them gets a backslash between its characters,
and `<\\|`, `<\\\\|` .. one more.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.shared import Recent, partitions, small_batches

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = 2_000_000  # characters after which a conversation goes on in another row
FLUSH = 1_000_000  # characters of finished conversations that are encoded and given out together
CACHE = 200_000  # pieces in each of the two parts of the cache
NUMBERS, SPANS, LOSS = "array<int>", "array<struct<start: int, end: int>>", "array<struct<first: int, last: int, start: int, end: int>>"
SCHEMA = f"conv_id long, segment int, text string, tokens {NUMBERS}, token_starts {NUMBERS}, token_ends {NUMBERS}, loss {LOSS}, roles array<string>, turns {SPANS}"
#: Where a byte-level tokenizer of this family cuts a text (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How a byte-level vocabulary writes bytes: printable ones as themselves, the others in order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_TOKENIZERS: dict = {}
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and where in it the text of each turn starts and ends."""
    parts, spans, at = [], np.zeros((len(turns), 2), np.int64), 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans[k] = at + len(head), at + len(head) + len(body)
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a formatted text."""
    out = []
    for part in text.split(START)[1:]:
        role, body = part[: part.rindex(END)].split("\n", 1)
        out.append((unescape_role(role), unescape(body)))
    return out


def intersect(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span the range (first, last) of the tokens that overlap it. Spans and tokens are sorted; empty spans have none."""
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    return np.stack([first, np.where(spans[:, 1] > spans[:, 0], last, first)], 1)


class Encoder:
    """A byte-level tokenizer with control tokens; pieces that were met lately are not encoded again."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        run = Tokenizer.from_file(path)
        self.model, self.cut, self.parts = run.model, regex.compile(PIECES), re.compile(f"({re.escape(START)}|{re.escape(END)})")
        self.control = {c: run.get_vocab_size() + k for k, c in enumerate((START, END))}
        self.pieces = Recent(self.learn, CACHE)

    def learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Rows (id, start, end) of the tokens of each piece, in characters of it; 32 bits each."""
        for piece in pieces:
            if piece in self.control:
                yield piece, array("i", (self.control[piece], 0, len(piece))).tobytes()
                continue
            raw = piece.encode()
            row, at = array("i"), 0
            of = range(len(raw)) if len(raw) == len(piece) else [k for k, c in enumerate(piece) for _ in c.encode()]
            for token in self.model.tokenize(raw.decode("latin-1").translate(SHOWN)):
                row.extend((token.id, of[at], of[at + len(token.value) - 1] + 1))
                at += len(token.value)
            yield piece, row.tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """For each text rows (id, start, end) of its tokens."""
        cut = [[p for k, part in enumerate(self.parts.split(t)) for p in ((part,) if k % 2 else self.cut.findall(part))] for t in texts]
        out = []
        for pieces, found in zip(cut, self.pieces.find(cut), strict=True):
            rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, 3).copy()
            starts = np.cumsum([0, *map(len, pieces)])[:-1]
            rows[:, 1:] += np.repeat(starts, np.array([len(x) for x in found], np.int64) // 12)[:, None].astype(np.int32)
            out.append(rows)
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def format_conversations(conversations: DataFrame, path: str, learn_from: str = "assistant") -> DataFrame:
    """Rows of formatted conversations: conv_id, segment, text, tokens with their spans, loss spans with their tokens, roles and turn spans.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null texts and
    roles count as empty; rows with null conv_id form a conversation. The loss mask covers what `learn_from` says. A
    conversation of more than SEGMENT characters continues in further segments, between turns, so that a task holds one
    segment and FLUSH characters at most. Control strings have the two ids after the vocabulary's. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        held: list[tuple[str, str]] = []
        conv, segment, size, done, waiting = None, 0, 0, [], 0

        def close() -> None:
            if held:
                done.append((conv, segment, list(held)))
                held.clear()

        for b in batches:
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if held and c != conv:
                    close()
                    segment, size = 0, 0
                elif held and size + len(text) > SEGMENT:
                    close()
                    segment, size = segment + 1, 0
                elif not held:
                    segment, size = 0, 0
                conv = c
                held.append((role, text))
                size += len(text)
                waiting += len(text) + 1
                if waiting > FLUSH and done:
                    yield _formatted(done, run, learn_from)
                    done, waiting = [], size
        close()
        yield _formatted(done, run, learn_from)

    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(write, SCHEMA)


def _lists(rows: list[np.ndarray], names: tuple[str, ...] = ()) -> pa.Array:
    """Lists of numbers, or of structs of the columns."""
    offsets = pa.array(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32))
    data = np.concatenate(rows).astype(np.int32) if rows else np.zeros((0, len(names) or 1), np.int32)
    values = pa.StructArray.from_arrays([pa.array(data[:, k].copy()) for k in range(len(names))], names) if names else pa.array(data.ravel())
    return pa.ListArray.from_arrays(offsets, values)


def _formatted(done: list[tuple], run: Encoder, learn_from: str) -> pa.RecordBatch:
    rendered = [render(turns) for _, _, turns in done]
    coded, loss = run([t for t, _ in rendered]), []
    for (_, _, turns), (_, spans), tokens in zip(done, rendered, coded, strict=True):
        learnt = spans[[role == learn_from for role, _ in turns]]
        loss.append(np.concatenate([intersect(learnt, tokens[:, 1], tokens[:, 2]), learnt], 1))
    columns = {
        "conv_id": pa.array([c for c, _, _ in done], pa.int64()), "segment": pa.array([s for _, s, _ in done], pa.int32()), "text": pa.array([t for t, _ in rendered], pa.string()),
        "tokens": _lists([t[:, 0] for t in coded]), "token_starts": _lists([t[:, 1] for t in coded]), "token_ends": _lists([t[:, 2] for t in coded]),
        "loss": _lists(loss, ("first", "last", "start", "end")), "roles": pa.array([[r for r, _ in turns] for _, _, turns in done], pa.list_(pa.string())), "turns": _lists([s for _, s in rendered], ("start", "end")),
    }
    return pa.record_batch(list(columns.values()), list(columns))


def masked_text(text: str, loss: list[dict], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text under the mask, unescaped: what the tokens of each loss span cover, cut to the span."""
    return "".join(unescape(text[max(starts[p["first"]], p["start"]) : min(ends[p["last"] - 1], p["end"])]) for p in loss if p["last"] > p["first"])


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation what its formatted rows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    in_order: the rows are as format_conversations leaves them, the segments of a conversation one after another in a
    partition; else they are brought into that order.
    """
    import hashlib

    rows = formatted.select("conv_id", "segment", "text", "token_starts", "token_ends", "loss")
    if not in_order:
        rows = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def close() -> None:
            if last is not None:
                out.append((last[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for b in batches:
            starts, ends = (b.column(c) for c in ("token_starts", "token_ends"))
            for k, (conv, segment, text, pieces) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss")), strict=True)):
                if segment == 0:
                    close()
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                last = (conv,)
                own, learnt = parse(text), masked_text(text, pieces, starts[k].values.to_numpy(), ends[k].values.to_numpy())
                for role, said in own:
                    turns.update(f"{role}\n{said}\n".encode())
                loss.update(learnt.encode())
                for i, n in enumerate((len(own), len(learnt), len(text))):
                    counts[i] += n
            yield _digests(out)
            out = []
        close()
        yield _digests(out)

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.record_batch([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names)
