"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its lower-cased characters, hashed. Each is scaled by the log of the
ratio of its (smoothed) document frequencies in toxic and other labelled documents; a logistic regression with an L1
penalty over the scaled features, both classes weighing the same, gives weights, and most n-grams none. Its output on
texts kept apart calibrates the score. Texts are read whole.

Null texts count as empty; an empty text has the score of no features. If labels of one class are missing, every score
is the rate of toxic labels (0 without any). Repeated rows get equal scores; a document labelled twice is toxic if one
label says so. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, lowest, text_of, texts

GRAMS, BUCKETS = (4, 5), 1 << 18
#: Fitted on at most so many labelled documents of a class, those whose ids hash lowest.
SAMPLE = 1200
#: Characters of a sampled text that the fit reads; predictions read texts whole.
PASSAGE = 20_000
#: An n-gram needs so many sampled documents; penalty, rounds of fitting, and score from which a text is toxic.
LEAST, PENALTY, ROUNDS, TOXIC = 4, 1e-3, 150, 0.7
PIECE = 1 << 17
_ODD, _ODD2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins + self.bias) + self.shift, -30, 30)))


def features(found: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row number and bucket of every n-gram occurrence of the texts, or of those whose bucket is used."""
    lowered = [f" {t.lower()} " for t in found]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    places, buckets = [], []
    for at in range(0, len(codes), PIECE):  # pieces that stay in the processor's cache
        piece = codes[at:at + PIECE + GRAMS[-1] - 1]
        value, done = np.zeros(len(piece), np.uint32), 0
        for n in GRAMS:
            for j in range(done, n):  # value[i] hashes the n characters from i on
                value = value[:max(0, len(piece) - j)] * _ODD + piece[j:]
            done = n
            bucket = (value[:PIECE] ^ (value[:PIECE] >> np.uint32(15))) * _ODD2
            bucket >>= np.uint32(32 - BUCKETS.bit_length() + 1)
            place = np.arange(len(bucket)) if used is None else np.flatnonzero(used[bucket])
            bucket = bucket[place]
            place = place + at
            whole = place + n <= ends[np.searchsorted(ends, place, side="right")]
            places.append(place[whole])
            buckets.append(bucket[whole].astype(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.searchsorted(ends, np.concatenate(places), side="right"), np.concatenate(buckets)


def _distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows.astype(np.int64) * BUCKETS + buckets)
    return (key // BUCKETS).astype(np.int32), (key % BUCKETS).astype(np.int32)


def fit(found: list[tuple[str, int]]) -> Model:
    """Fit to (text, label) pairs; every fifth is kept apart for the calibration."""
    y = np.array([label for _, label in found], float)
    flat = Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else -30.0)
    if not len(y) or y.min() == y.max():
        return flat
    rows, cols = [], []
    for at in range(0, len(found), 64):
        r, c = _distinct(*features([t for t, _ in found[at:at + 64]]))
        rows.append(r + at)
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    apart = np.arange(len(y)) % 5 == 4
    fitted = ~apart if len(set(y[~apart])) == 2 and len(set(y[apart])) == 2 else np.ones(len(y), bool)
    apart = apart if not fitted.all() else fitted
    mine = fitted[rows]
    toxic = np.bincount(cols[mine], weights=y[rows[mine]], minlength=BUCKETS)
    clean = np.bincount(cols[mine], weights=1 - y[rows[mine]], minlength=BUCKETS)
    n1, n0 = y[fitted].sum(), (1 - y[fitted]).sum()
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((clean + 1) / (n0 + 2))
    ratio[toxic + clean < LEAST] = 0
    used = ratio[cols] != 0
    rows, cols = rows[used], cols[used]
    names, cols = np.unique(cols, return_inverse=True)
    values = ratio[names][cols].astype(np.float32)
    weight = np.where(fitted, np.where(y > 0, 0.5 / n1, 0.5 / n0), 0.0)
    size = len(names)
    times = lambda w: np.bincount(rows, weights=values * w[cols], minlength=len(y))
    back = lambda v: np.bincount(cols, weights=values * v[rows], minlength=size)
    probe = np.ones(size) / max(1, size) ** 0.5
    for _ in range(8):  # the largest curvature sets the step
        probe = back(weight * times(probe))
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    step = 4 / (1.1 * top + 1.0)
    w, b = np.zeros(size), 0.0
    ahead, ahead_b, momentum = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(times(ahead) + ahead_b, -30, 30)))
        d = weight * (p - y)
        fresh = ahead - step * back(d)
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * PENALTY, 0)
        fresh_b = ahead_b - step * d.sum()
        after = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        ahead, ahead_b = fresh + (momentum - 1) / after * (fresh - w), fresh_b + (momentum - 1) / after * (fresh_b - b)
        w, b, momentum = fresh, fresh_b, after
    margins = times(w)[apart] + b
    slope, shift = _calibrated(margins, y[apart])
    full = np.zeros(BUCKETS, np.float32)
    full[names] = (w * ratio[names]).astype(np.float32)
    return Model(full, float(b), slope, shift)


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, both classes weighing the same, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (weight * (p - goal))
        curve = (x * (weight * p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        theta -= np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def samples(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Labelled documents outside the held-out fold, at most SAMPLE of a class, PASSAGE characters of each."""
    told = labels.where(F.col("toxic").isNotNull() & (fold(3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = lowest(told, "toxic", SAMPLE, "toxicity")
    # at most 2 * SAMPLE ids are broadcast
    rows = docs.select("doc_id", F.substring(text_of("text"), 1, PASSAGE).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    ordered = sorted({(r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows})
    return [(text, label) for _, text, label in np.random.default_rng(3).permutation(np.array(ordered, object)).tolist()] if ordered else []


def margins(model: Model, found: list[str]) -> np.ndarray:
    """Sum of the weights of each text's distinct n-grams."""
    rows, buckets = _distinct(*features(found, model.weights != 0))
    return np.bincount(rows, weights=model.weights[buckets], minlength=len(found))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 4096, 2_000_000):
            value = model.score(margins(model, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.round(6), pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`, learned from `labels` (doc_id, toxic)."""
    scored = score(docs, fit(samples(docs, labels)))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
