"""Quality classifier: a linear hinge-loss model over n-gram indicators that are scaled by class log-count ratios.

Indicators are byte pairs, runs of four bytes and words, hashed to a table of fixed size. The ratios, the model (dual
coordinate descent) and the map from margins to probabilities are fitted in one task on a bounded sample of labelled
rows; `per_class` is the bound, taken for each class in the order of a hash of doc_id. Scores are computed for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrain.llm import arrays as A
from trailgrain.llm.shared import small_batches

BITS = 18
PER_CLASS = 3000
COST, EPOCHS, FOLDS = 1.0, 15, 3


def indicators(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of rows their distinct feature numbers, row after row, and the rows' offsets into them.

    A row longer than a chunk is worked off in overlapping parts whose features are then united.
    """
    for i, j in A.row_chunks(offs):
        part, rows = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if len(part) > 2 * A.CHUNK:
            cuts = range(0, len(part), A.CHUNK)
            ends = [min(c + A.CHUNK + 256, len(part)) for c in cuts]
            found = [_features(part[c:e], np.array([0, e - c]))[0] for c, e in zip(cuts, ends, strict=True)]
            feats = np.unique(np.concatenate(found))
            yield feats, np.array([0, len(feats)])
        else:
            yield _features(part, rows)


def _features(part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = A.BYTE_CODE[part]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows)).astype(np.uint64)
    keys = []
    for k in (2, 4):
        grams = A.gram_hashes(codes, k)
        ok = np.ones(len(part), bool)
        for back in range(1, k):
            at = rows[1:] - back
            ok[at[at >= rows[:-1]]] = False
        keys.append(((row << A.U(BITS)) | (grams >> A.U(64 - BITS)))[ok])
    starts, ends, at = A.words(part, rows)
    hashes = A.word_hashes(part, starts, ends)
    of = np.repeat(np.arange(len(rows) - 1), np.diff(at)).astype(np.uint64)
    keys.append((of << A.U(BITS)) | (hashes >> A.U(64 - BITS)))
    keys = np.sort(np.concatenate(keys))
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return (keys & A.U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(keys, np.arange(len(rows), dtype=np.uint64) << A.U(BITS))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature between the classes, with one count added."""
    counts = [np.ones(1 << BITS) for _ in range(2)]
    for f, c in zip(rows, y, strict=True):
        counts[int(c > 0)][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent over unit-length rows of scaled indicators, with a bias."""
    w, bias = np.zeros(1 << BITS), 0.0
    values = [r[f] for f in rows]
    norms = [float(np.sqrt(v @ v)) or 1.0 for v in values]
    values = [v / s for v, s in zip(values, norms, strict=True)]
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * COST
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def margins(rows: list[np.ndarray], model: tuple[np.ndarray, float], r: np.ndarray) -> np.ndarray:
    w, bias = model
    out = []
    for f in rows:
        v = r[f]
        out.append(float(w[f] @ v) / (float(np.sqrt(v @ v)) or 1.0) + bias)
    return np.array(out)


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1 at a margin, by Newton steps with a little shrinkage."""
    x, t, p = np.stack([m, np.ones(len(m))]), (y > 0) * 0.998 + 0.001, np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        g = x @ (weight * (q - t)) + 1e-3 * p
        h = (x * (weight * q * (1 - q))) @ x.T + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(h, g)
    return float(p[0]), float(p[1])


def fit(rows: list[np.ndarray], y: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Weights of the features, their ratios, and at the end the bias, slope and offset. totals: labelled rows of class 0 and 1."""
    r = ratios(rows, y)
    if len(set(y.tolist())) < 2:  # one class only: its share, for every text
        share = (totals[1] + 1) / (totals[0] + totals[1] + 2)
        return np.concatenate([np.zeros(1 << BITS), r, [0.0, 0.0, np.log(share / (1 - share))]])
    held = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[a].tolist())) < 2 or not len(b):
            continue
        own = ratios([rows[i] for i in a], y[a])
        held[b] = margins([rows[i] for i in b], descend([rows[i] for i in a], y[a], own), own)
    weight = np.where(y > 0, totals[1] / (y > 0).sum(), totals[0] / (y < 0).sum())
    slope, offset = logistic(held, y, weight)
    w, bias = descend(rows, y, r)
    return np.concatenate([w, r, [bias, slope, offset]])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> np.ndarray:
    """The fitted model, from at most per_class rows of each class."""
    small_batches(documents.sparkSession)
    names = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"), F.min(label).alias("y0"))
    names = names.where("y = y0 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    totals = {r.y: r.c for r in names.groupBy("y").agg(F.count("*").alias("c")).collect()}
    sample = None
    for c in (0, 1):
        own = names.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "y")
        sample = own if sample is None else sample.union(own)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = A.text_bytes(b.column("text"))
            found = [f[i:j].astype(np.uint32).tobytes() for f, at in indicators(data, offs) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "y", "f"])

    def model(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("f", "ascending")])
        rows = [np.frombuffer(x, np.uint32).astype(np.int64) for x in t.column("f").to_pylist()]
        y = np.where(t.column("y").to_numpy() == 1, 1, -1)
        perm = np.random.default_rng(11).permutation(len(y))
        return pa.table({"model": pa.array([fit([rows[i] for i in perm], y[perm], (totals.get(0, 0), totals.get(1, 0))).tobytes()], pa.binary())})

    found = rows.mapInArrow(extract, "doc_id long, y int, f binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(model, "model binary").collect()
    if not found:
        return np.concatenate([np.zeros(2 << BITS), [0.0, 0.0, 0.0]])
    return np.frombuffer(bytes(found[0].model), np.float64)


def score(documents: DataFrame, model: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """Rows of documents: doc_id, held_out, score and predicted.

    Null and empty texts have no indicators and get the score of the bias. Rows are scored by their text alone, so
    equal texts score alike; rows with null doc_id are held out. Other columns are ignored.
    """
    size = 1 << BITS
    shared = documents.sparkSession.sparkContext.broadcast((model[:size].astype(np.float32), model[size : 2 * size].astype(np.float32), model[2 * size :]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, r, (bias, slope, offset) = shared.value
        weighted, squares = (w * r).astype(np.float64), (r * r).astype(np.float64)
        for b in batches:
            data, offs = A.text_bytes(b.column("text"))
            out = []
            for f, at in indicators(data, offs):
                sums = [np.append(0.0, np.cumsum(x[f])) for x in (weighted, squares)]
                top, norm = (s[at[1:]] - s[at[:-1]] for s in sums)
                norm = np.sqrt(np.maximum(norm, 0))
                margin = np.where(np.diff(at) > 0, top / np.where(norm > 1e-9, norm, 1), 0) + bias
                out.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))
            p = np.round(np.concatenate(out), 9) if out else np.zeros(0)
            yield pa.record_batch([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(True))
    return texts.mapInArrow(scan, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """Train on labels whose crc32(doc_id as text) mod 5 is not 0, then score all documents. Contradicting labels of a doc_id are left out."""
    return score(documents, train(documents, labels, label, per_class), threshold)
