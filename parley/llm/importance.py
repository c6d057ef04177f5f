"""Importance resampling towards a target distribution.

Words are found by an untrained `Split` pre-tokeniser over ASCII-lowered text, which tells their offsets. A window over
consecutive offset pairs is a feature, its CRC-32 modulo the number of buckets its bucket. The histograms of the raw and
of the target texts give every bucket a gain, a document's weight is the sum of its features' gains, and seeded Gumbel
noise on the weight turns "the highest scores" into a draw without replacement.

Null and empty texts have no words: no features, weight 0, never drawn. Null ids hash like the empty text and come last
among equal scores; repeated rows are rows of their own, with ranks of their own. An empty table gives an empty result,
an empty target a histogram of zeros. Extra columns are not read. Texts are read whole, in pieces that end between words.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from parley.llm.common import keep, parts, text_of, texts

BUCKETS, WIDTHS, SEED = 10_000, (1, 1), 2024
LEAST_WORDS, PERCENT = 20, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters handed to the pre-tokeniser at once; its cost grows faster than the piece.
PIECE = 2_000
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_CODED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                    ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()),
                     ("score", pa.int64()), ("_row", pa.int64())])


@functools.lru_cache(maxsize=1)
def _splitter() -> Split:
    return Split(Regex(WORD), "removed", invert=True)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of consecutive pieces; no word lies in two of them."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(" ", start + 1, start + PIECE)
        if cut < 0:
            found = _BETWEEN.search(text, start + PIECE)
            cut = found.start() if found else len(text)
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


def windows(text: str, widths: tuple[int, int] = WIDTHS) -> Iterator[tuple[int, list[str]]]:
    """Per piece of an ASCII-lowered text: its number of words, and the features that end in it."""
    low, high = widths
    held: list[tuple[int, int]] = []
    for base, piece in _pieces(text):
        pairs = held + [(base + a, base + b) for _, (a, b) in _splitter().pre_tokenize_str(piece)]
        words, old = [text[a:b] for a, b in pairs], len(held)
        found = []
        for n in range(low, high + 1):
            found += words[old:] if n == 1 else [" ".join(words[i - n:i]) for i in range(max(old + 1, n), len(words) + 1)]
        yield len(words) - old, found
        held = pairs[max(0, len(pairs) - high + 1):] if high > 1 else []


class _Buckets(dict):
    """Buckets of the features met by a task; forgotten when they are many."""

    def __init__(self, number: int) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, feature: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[feature] = zlib.crc32(feature.encode()) % self.number
        return found


def _coder(widths: tuple[int, int], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in texts(batches, 500):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = features = 0
                tally = np.zeros(buckets, np.int64)
                for n, found in windows(text.encode().lower().decode(), widths):
                    words, features = words + n, features + len(found)
                    tally += np.bincount(np.fromiter((known[f] for f in found), np.int64, len(found)), minlength=buckets)
                at = np.flatnonzero(tally)
                rows.append((key, words, features, at, tally[at]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CODED.types)], schema=_CODED)

    return run


def coded(docs: DataFrame, id_column: str = "doc_id", widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features of every row, and how many of its features fall into which bucket."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(_coder(widths, buckets), "doc_id long, n_words long, n_features long, bucket array<int>, times array<long>")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all rows: at most `buckets` sums reach the driver."""
    cells = rows.select(F.explode(F.arrays_zip("bucket", "times")).alias("c")).groupBy("c.bucket").agg(F.sum("c.times").alias("n"))
    out = [0] * buckets
    for bucket, n in cells.collect():
        out[bucket] = n
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the raw texts."""
    all_raw, all_target, n = sum(raw), sum(target), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + float(n)) / ((s + 1.0) * (all_target + float(n)))))
                     for s, t in zip(raw, target)], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate hashed from seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = batch.column("bucket"), batch.column("times")
            sizes = np.diff(bucket.offsets.to_numpy())
            sums = np.concatenate([[0], np.cumsum(gain[bucket.flatten().to_numpy()] * times.flatten().to_numpy())])
            stops = np.cumsum(sizes)
            weight = sums[stops] - sums[stops - sizes]
            keys = batch.column("doc_id").to_pylist()
            score = weight + np.array([noise(k, seed) for k in keys], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                                              pa.array(weight, pa.int64()), pa.array(score, pa.int64()), batch.column("_row")], schema=_SCORED)

    return run


def scored(docs: DataFrame, target: DataFrame, target_id: str, widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS,
           seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and `_row`, which tells repeated rows apart."""
    cells = keep(coded(docs, "doc_id", widths, buckets).withColumn("_row", F.monotonically_increasing_id()), "features")
    gain = gains(histogram(cells, buckets), histogram(coded(target, target_id, widths, buckets), buckets))
    return cells.mapInArrow(_scorer(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long, _row long")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add `rank`: 1, 2, 3 ... by falling score over the drawn share of the rows with enough words, null for the others.

    Ranges of the order are sorted apart and shifted by the rows before them: no task holds all rows, nor all rows of a score.
    """
    rows = keep(rows, "scores")
    drawn = percent * rows.where(F.col("n_words") >= least_words).count() // 100
    order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ordered = keep(rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
                   .select("*", F.spark_partition_id().alias("_range"),
                           F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ordered")
    sizes = sorted(map(tuple, ordered.groupBy("_range").count().collect()))  # one row a range
    starts, before = [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    shift = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.col("_at") + F.col("_before") + 1
    return (ordered.join(F.broadcast(shift), "_range")
            .select(*rows.columns, F.when(place <= drawn, place).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS,
             seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text); `target` holds (target_id, text)."""
    return (ranked(scored(docs, target, target_id, widths, buckets, seed), least_words, percent)
            .select("doc_id", "n_features", "weight", "score", "rank"))
