"""Operator 6: quality classifier, naive Bayes support vectors.

Features are indicators of byte 3-grams and of word 1- and 2-grams, hashed into SLOTS places each. Each indicator is
scaled by the log ratio of its smoothed shares in the two classes, rows have unit length in the number of
features, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a
logistic curve fitted to cross-validated margins.

The fit uses at most `max_rows` labelled rows (SAMPLE, the ones with least hash of doc_id), in one task; the model is
two arrays of fixed size, which are broadcast. Scoring reads every row and whole text, and only texts.

Null and empty texts are scored by the intercept alone. Rows whose label or doc_id is null don't teach; with no row
of one class to learn from, every score is the share of class 1 (0.5 without any row). Repeated labels count as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS, SAMPLE, THRESHOLD = 1 << 18, 6000, 0.7
#: Features from which a set is marked in the flags of all slots instead of sorted; a matter of speed alone.
FEW_FEATURES = 2000


class Features:
    """Sets of hashed features of byte strings."""

    def __init__(self):
        self.memo = C.Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words], 100_000, 2 << 20)
        self.flags = np.zeros(2 * SLOTS, np.float32)

    def hashed(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Feature numbers of each text, repeats included; words and numbers of one text at a time, as they take many times its size."""
        for t in texts:
            s = t.split()
            known = self.memo.lookup(s)
            b = np.frombuffer(t, np.uint8).astype(np.uint32)
            grams = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(14) if len(b) > 2 else np.empty(0, np.uint32)
            w = np.fromiter(map(known.__getitem__, s), np.uint64, len(s))
            pairs = C.mix64(w[:-1] * np.uint64(3) + w[1:])
            words = np.concatenate([w, pairs]) >> np.uint64(46)
            yield np.concatenate([grams.astype(np.int64), words.astype(np.int64) + SLOTS])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in self.hashed(texts):
            self.flags[i] = 1
            out.append(np.flatnonzero(self.flags).astype(np.int32))
            self.flags[i] = 0
        return out

    def margins(self, texts: Iterable[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
        out = []
        for i in self.hashed(texts):
            if len(i) < FEW_FEATURES:
                i = np.unique(i)
                out.append(bias + weights[i].sum(dtype=np.float64) / np.sqrt(max(1, len(i))))
                continue
            self.flags[i] = 1
            out.append(bias + float(self.flags @ weights) / np.sqrt(self.flags.sum(dtype=np.float64)))
            self.flags[i] = 0
        return np.array(out)


def log_count_ratios(sets: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, 2 * SLOTS), smooth)
    for s, label in zip(sets, y):
        counts[label][s] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(sets: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float, rounds: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights (ratios included) and intercept of the hinge-loss model."""
    w, bias, sign = np.zeros(len(ratios)), 0.0, 2.0 * y - 1
    rows = [ratios[s] / np.sqrt(max(1, len(s))) for s in sets]
    square = np.array([r @ r + 1 for r in rows])
    alpha, draw = np.zeros(len(sets)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(len(sets)):
            s, x = sets[i], rows[i]
            slope = sign[i] * (w[s] @ x + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[s] += step * sign[i] * x
                bias += step * sign[i]
                worst = max(worst, abs(step))
        if worst < 1e-3 * cost:
            break
    return w * ratios, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(p - t) @ margins + 1e-6 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[v @ margins**2 + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(texts: list[bytes], labels: list[int], cost: float = 1.0, rounds: int = 20, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """weights (float32) and (bias, slope, intercept)."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(2 * SLOTS, np.float32), np.array([0.0, 1.0, np.log(share / (1 - share))])
    sets = Features().sets(texts)
    held = np.zeros(len(y))
    for k in range(folds):
        test = np.arange(len(y)) % folds == k
        own = [s for s, out in zip(sets, test) if not out]
        if len(set(y[~test])) < 2:
            continue
        w, b = dual_descent(own, y[~test], log_count_ratios(own, y[~test]), cost, rounds)
        for i in np.flatnonzero(test):
            held[i] = w[sets[i]].sum() / np.sqrt(max(1, len(sets[i]))) + b
    a, c = logistic(held, y)
    w, b = dual_descent(sets, y, log_count_ratios(sets, y), cost, rounds)
    return w.astype(np.float32), np.array([b, a, c])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE, teaches: Column | None = None):
    """A broadcast model (weights, bias, slope, intercept) from labelled rows for which `teaches` holds."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(teaches) if teaches is not None else known
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        rows = []
        for b in batches:
            rows += zip(b.column("doc_id").to_pylist(), C.raw_texts(b), b.column("label").to_pylist())
        rows.sort()
        w, rest = train([r[1] for r in rows], [r[2] for r in rows])
        yield {"weights": [w.tobytes()], "rest": [rest.astype(np.float64).tobytes()]}

    model = C.arrow_map(sample.repartition(1), run, "weights binary, rest binary").first()
    # An empty sample still makes one row: a partition without batches calls run once.
    w, rest = (np.frombuffer(model["weights"], np.float32), np.frombuffer(model["rest"])) if model else train([], [])
    return spark.sparkContext.broadcast((w, *map(float, rest)))


_features: list[Features] = []


def scores_of(texts: Iterable[bytes], model) -> np.ndarray:
    weights, bias, slope, intercept = model
    _features[:] = _features or [Features()]
    return 1 / (1 + np.exp(-np.clip(slope * _features[0].margins(texts, weights, bias) + intercept, -30, 30)))


def score_column(model, text: Column) -> Column:
    """The score as a column, for filters that keep all other columns as they are."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(scores_of(((x or "").encode() for x in t), model.value))

    return score(text)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text mod 4 is 2; a null id counts as empty text), score, predicted."""

    def run(batches):
        for b in batches:
            s = scores_of(C.raw_texts(b), model.value)
            yield {"doc_id": b.column(0), "held_out": [zlib.crc32(str("" if i is None else i).encode()) % 4 == 2 for i in b.column(0).to_pylist()], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return C.arrow_map(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def teaching_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
