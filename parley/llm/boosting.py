"""Gradient-boosted trees of depth three for a yes/no label over small whole-number features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, DEPTH, ROUNDS, RATE, RIDGE = 32, 3, 60, 0.2, 1.0
#: Derivatives are whole numbers of 1 / SCALE: below 2**53 in all for 2**33 rows, so their sums are exact.
SCALE = 1 << 20


@dataclass
class Trees:
    """Each tree: feature and cut per inner node (heap order), value per leaf."""

    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def sums(model: Trees, feature: np.ndarray, cut: np.ndarray, depth: int, x: np.ndarray, no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """First and second derivatives of the loss by node of a depth of the tree in growth, feature and level: (2, nodes, features, LEVELS).

    They are whole multiples of 1 / SCALE, so sums of them do not depend on the order or the partitions of the rows.
    """
    p, n = 1 / (1 + np.exp(-model.margin(x))), no + yes
    g, h = yes * float(SCALE) - n * np.rint(p * SCALE), n * np.rint(p * (1 - p) * SCALE)
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    features, width = x.shape[1], 2 ** depth
    place = (((node - (width - 1))[:, None] * features + np.arange(features)) * LEVELS + x).ravel()
    return np.stack([np.bincount(place, weights=np.repeat(v, features), minlength=width * features * LEVELS) for v in (g, h)]).reshape(2, width, features, LEVELS)


def grow(yes: float, no: float, told: Callable[[Trees, np.ndarray, np.ndarray, int], np.ndarray]) -> Trees:
    """Newton boosting of the logistic loss; features are cut at whole numbers below LEVELS. `told` adds `sums` up over all rows."""
    rate = (yes + 0.5) / (yes + no + 1.0)
    model = Trees(start=float(np.log(rate / (1 - rate))))
    if not yes or not no:
        return model
    inner = 2 ** DEPTH - 1
    for _ in range(ROUNDS):
        feature, cut = np.zeros(inner, np.int64), np.full(inner, LEVELS)
        for depth in range(DEPTH):
            base, width = 2 ** depth - 1, 2 ** depth
            g, h = told(model, feature, cut, depth).cumsum(axis=3) / SCALE
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g ** 2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g ** 2 / (total_h + RIDGE)
            best = gain.reshape(width, -1).argmax(axis=1)
            useful = gain.reshape(width, -1).max(axis=1) > 1e-9
            feature[base:base + width] = best // LEVELS
            cut[base:base + width] = np.where(useful, best % LEVELS, LEVELS)
        at = np.arange(width), best // LEVELS, np.where(useful, best % LEVELS, LEVELS - 1)  # an uncut node goes left whole
        left = [v[at] for v in (g, h)]
        sides = [np.stack([v, t[:, 0, 0] - v], axis=1).ravel() for v, t in zip(left, (total_g, total_h))]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(RATE * sides[0] / (sides[1] + RIDGE))
    return model


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Trees:
    """Fit to rows in memory; `times` tells how often each row stands."""
    times = np.ones(len(y)) if times is None else times
    yes, no = y * times, (1 - y) * times
    return grow(yes.sum(), no.sum(), lambda *tree: sums(*tree, x, no, yes))


def arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and the counts of rows of label 0 and 1, of rows (x binary, n0 long, n1 long)."""
    x = batch.column("x").to_pylist()
    return (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1).astype(np.int64),
            *(np.asarray(batch.column(n), float) for n in ("n0", "n1")))


def fit_table(rows: DataFrame) -> Trees:
    """Fit to all rows (x binary, n0 long, n1 long) of a stored table, however many: every depth of every tree reads them once, and a
    task passes on its sums only."""
    total = rows.agg(F.sum("n1"), F.sum("n0")).first()

    def told(model: Trees, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [sums(model, feature, cut, depth, *arrays(b)) for b in batches if b.num_rows]
            if found:
                part = np.sum(found, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.size)), pa.array(part.ravel())], names=["place", "v"])

        added = rows.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(added))
        out[[r["place"] for r in added]] = [r["v"] for r in added]
        return out.reshape(2, 2 ** depth, -1, LEVELS)

    return grow(float(total[0] or 0), float(total[1] or 0), told)
