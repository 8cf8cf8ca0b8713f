"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings 0 < 1 < ... < K-1 share one weight vector over hashed text features;
ordered thresholds cut its score s into grades: P(y <= j) = logistic(t_j - s).
From it follow the expected grade and the tail probabilities P(y >= j).

The fit uses at most ``sample`` labelled documents, those of smallest hashed id
(the bound is what makes it safe to gather their features in one task); the
scores cover all documents, by one map over the table. A very long text is a
set of features like any other.

Cases. Null and empty texts have the constant feature only. Without labels, or
with one grade only, the weights are zero and all documents score alike: the
top grade. Null ids and repeated rows are scored as any other row. Other
columns, whatever their names, are kept by ``select_rows`` and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

BITS = 18


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: lower-cased words, words without
    punctuation around them and their first four and five bytes, last three bytes of words, and coarse shares of
    distinct words, capitals and symbols."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    low = set(raw.lower().split())
    found = set(map(zlib.crc32, low))
    bare = {w.strip(b".,;:!?\"'()[]#$%&*") for w in low}
    found.update(map(zlib.crc32, (b"b " + w for w in bare)))
    heads = {w[:4] for w in bare}
    heads.update({w[:5] for w in bare})
    found.update(map(zlib.crc32, (b"h " + w for w in heads)))
    tails = {w[-3:] for w in low}
    found.update(map(zlib.crc32, (b"t " + w for w in tails)))
    n = len(words)
    if n:
        letters = sum(map(len, words))
        capital = letters - len(raw.translate(None, b" \t\n\r\x0b\x0cABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbol = letters - len(raw.translate(None, b" \t\n\r\x0b\x0c#$%&*!|"))
        for name, share in ((b"d", len(low) / n), (b"c", capital / letters), (b"s", symbol / letters)):
            found.add(zlib.crc32(b"%s %d %d" % (name, min(n.bit_length(), 6), int(share * 20))))
    found.add(0)
    return np.unique(np.fromiter(found, np.uint32, len(found)) & np.uint32((1 << bits) - 1))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        return float(self.weights[features(text)].sum(dtype=np.float64))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(n, K-1): P(y >= 1), ..., P(y >= K-1)."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def thresholds_of(first: float, steps: np.ndarray) -> np.ndarray:
    """Ordered: the first one and positive distances exp(steps)."""
    return first + np.concatenate([[0], np.cumsum(np.exp(steps))])


def gradients(s: np.ndarray, y: np.ndarray, first: float, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood of grades y at scores s: by each
    score, and by (first, steps)."""
    t = thresholds_of(first, steps)
    f = _logistic(t[None, :] - s[:, None])
    up = np.concatenate([f, np.ones((len(y), 1))], axis=1)[np.arange(len(y)), y]
    lo = np.concatenate([np.zeros((len(y), 1)), f], axis=1)[np.arange(len(y)), y]
    p = np.maximum(up - lo, 1e-9)
    d = f * (1 - f)
    at_t = np.stack([((y == j + 1).astype(float) - (y == j)) * d[:, j] / p for j in range(len(t))], axis=1)
    gt = at_t.mean(axis=0)
    return (1 - up - lo) / len(y), np.array([gt.sum(), *(gt[j + 1 :].sum() * np.exp(steps[j]) for j in range(len(steps)))])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, steps_least: int = 2000, epochs: int = 20, batch: int = 256, rate: float = 1.0, threshold_rate: float = 0.2, l2: float = 1e-5, least_df: int = 4, least_z: float = 5.0, least_phi: float = 0.1, power: float = 1.5, bits: int = BITS, seed: int = 7) -> OrdinalModel:
    """Mini-batch adaptive-gradient descent on the cumulative-link likelihood.
    The thresholds are the first one plus positive steps, so they stay ordered.
    A feature's strength is the largest phi coefficient between its presence and
    the top grade against one lower grade. Features in fewer than ``least_df``
    documents, below ``least_phi``, or not significant by ``least_z`` standard
    errors, keep weight zero: groups of copies make many words go along with a
    grade, but weakly. The others enter with value strength ** ``power``, so that
    strong ones are learned first; values are folded into the weights."""
    w = np.zeros(1 << bits)
    if not len(rows) or len(set(grades.tolist())) < 2:
        return OrdinalModel(w.astype(np.float32), np.full(levels - 1, -5.0) + np.arange(levels - 1))
    by_grade = np.zeros((levels, 1 << bits), np.int64)
    for at in range(0, len(rows), 500):  # in parts, to bound memory
        for g in range(levels):
            some = [r for r, y in zip(rows[at : at + 500], grades[at : at + 500], strict=True) if y == g]
            if some:
                by_grade[g] += np.bincount(np.concatenate(some), minlength=1 << bits)
    df = by_grade.sum(axis=0)
    z, phi = np.zeros(1 << bits), np.zeros(1 << bits)
    for j in range(levels - 1):
        below, n = by_grade[j], max(1, int((grades == j).sum()))
        above, m = by_grade[levels - 1], max(1, int((grades == levels - 1).sum()))
        share = (below + above) / (n + m)
        zs = np.abs(below / n - above / m) / np.sqrt(np.maximum(share * (1 - share) * (1 / n + 1 / m), 1e-12))
        z, phi = np.maximum(z, zs), np.maximum(phi, zs / np.sqrt(n + m))
    use = (df >= least_df) & (z >= least_z) & (phi >= least_phi)
    use[0], phi[0] = True, 1
    value = np.where(use, phi, 0) ** power
    rows = [r[use[r]] for r in rows]
    share = np.array([np.mean(grades <= j) for j in range(levels - 1)]).clip(0.01, 0.99)
    t = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(t), 0.05))
    first = t[0]
    square, square_t = np.full(1 << bits, 1e-8), np.full(levels - 1, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-steps_least // -(-len(rows) // batch)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            n = np.array([len(rows[i]) for i in pick])
            idx = np.concatenate([rows[i] for i in pick]).astype(np.int64)
            own = np.repeat(np.arange(len(pick)), n)
            s = np.bincount(own, w[idx] * value[idx], len(pick))
            y = grades[pick]
            by_score, gt = gradients(s, y, first, steps)
            g = np.bincount(idx, by_score[own], 1 << bits)
            touched = np.flatnonzero(g)
            g = g[touched] * value[touched] + l2 * w[touched]
            square[touched] += g * g
            w[touched] -= rate * g / np.sqrt(square[touched])
            square_t += gt * gt
            move = threshold_rate * gt / np.sqrt(square_t)
            first -= move[0]
            steps -= move[1:]
    return OrdinalModel((w * value).astype(np.float32), thresholds_of(first, steps))


FITTED = "places binary, weights binary, thresholds array<double>"


def _fit(levels: int):
    """From (i, g, f) of all rated documents one row: the fitted model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        got.sort()
        rows, grades = [np.frombuffer(f, np.uint32) for _, _, f in got], np.array([g for _, g, _ in got], int)
        m = fit_ordinal(rows, grades, levels)
        at = np.flatnonzero(m.weights).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([m.weights[at].tobytes()], pa.binary()), pa.array([m.thresholds.tolist()], pa.list_(pa.float64()))], ["places", "weights", "thresholds"])

    return run


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel:
    """Fit on the at most ``sample`` rated documents of smallest hashed id, in one
    task; of rows with one id the least text counts. Only the model comes to the driver."""
    few = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(grade_col).cast("int").alias("g")).orderBy(F.xxhash64("i"), "i", "g").limit(sample)
    texts = docs.select(F.col(id_col).alias("j"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), F.col("i") == F.col("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["i", "g", "f"])

    rows = texts.groupBy("i", "g").agg(F.min("text").alias("text")).mapInArrow(lean(run), "i long, g int, f binary")
    m = rows.repartition(1).mapInArrow(lean(_fit(levels)), FITTED).first()
    weights = np.zeros(1 << BITS, np.float32)
    if m is None:
        return OrdinalModel(weights, np.full(levels - 1, -5.0) + np.arange(levels - 1))
    weights[np.frombuffer(m["places"], np.uint32)] = np.frombuffer(m["weights"], np.float32)
    return OrdinalModel(weights, np.array(m["thresholds"]))


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails: array<double>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = model.tails(np.array([model.score(t.as_py()) for t in b.column(1)], float)) if b.num_rows else np.empty((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1), pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(lean(run), "doc_id long, expected_grade double, tails array<double>")


def select_rows(docs: DataFrame, model: OrdinalModel, level: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with P(y >= level) >= least, all columns as they were.
    One map over the table; nothing is joined or shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py() or "") for t in b.column(place)], float)
            yield b.filter(pa.array(model.tails(s)[:, level - 1] >= least)) if b.num_rows else b

    return docs.mapInArrow(lean(run), docs.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels table: 0 poor, 1 sound but toxic, 2 clean."""
    return labels.where("quality is not null").select("doc_id", F.expr("case when quality = 0 then 0 when coalesce(toxic, 0) = 1 then 1 else 2 end").alias("grade"))
