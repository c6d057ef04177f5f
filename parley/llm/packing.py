"""Best-fit packing: patterns of few documents fitted to the length histogram by non-negative least squares.

Documents become token ids and an end id; only those longer than a sequence are cut, the short piece first. The
histogram of piece lengths (at most `room` counts) is all that reaches the driver. There, patterns of up to three length
bins that fill a sequence are enumerated, their repeat counts are fitted to the histogram, rounded, and turned into
runs of exact lengths whose last member is the best fit; what is left is packed best fit decreasing, run by run, into
the space that remains and new sequences. The plan says where the n-th piece of a length goes; pieces are numbered
within their length in slices, so no length gathers in one task.

Null texts are empty and become one piece of the end id. Repeated rows are packed like any others. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.llm.common import keep, text_of, texts

ROOM, END, BINS, MEMBERS, SLICE = 2048, 0, 256, 3, 1_000_000


def pieces(docs: DataFrame, room: int = ROOM, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every document."""
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 4096):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.append(tokens.ids(text, vocabulary), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(found) % room or room, len(found) + 1, room)]
                for i, (a, b) in enumerate(itertools.pairwise(cuts)):
                    part = found[a:b]
                    for column, value in zip(rows, (doc_id, i, a, b - a, zlib.crc32(part.tobytes()), part if with_ids else None)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], types)], names=list(names[:n]))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return narrow.mapInArrow(run, columns + (", ids array<int>" if with_ids else ""))


@functools.lru_cache(maxsize=4)
def patterns(bins: int, members: int) -> np.ndarray:
    """All multisets of at most `members` bin numbers that sum to `bins`: one column each, counts per bin."""
    found: list[list[int]] = []

    def grow(rest: int, most: int, chosen: list[int]) -> None:
        if not rest:
            found.append(chosen)
        elif len(chosen) < members:
            for b in range(min(rest, most), 0, -1):
                if b * (members - len(chosen)) < rest:
                    break
                grow(rest - b, b, [*chosen, b])

    grow(bins, bins, [])
    table = np.zeros((bins, len(found)))
    for j, chosen in enumerate(found):
        for b in chosen:
            table[b - 1, j] += 1
    return table


def nnls(table: np.ndarray, goal: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """Least squares with non-negative weights, by an active set: a column enters while it lowers the error."""
    n = table.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(3 * table.shape[0]):
        gain = table.T @ (goal - table @ x)
        gain[free] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance * scale:
            break
        free[j] = True
        while True:
            cols = np.flatnonzero(free)
            s = np.linalg.lstsq(table[:, cols], goal, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            bad = s <= 0
            step = np.min(x[cols][bad] / np.maximum(x[cols][bad] - s[bad], 1e-300))
            x[cols] += step * (s - x[cols])
            drop = cols[bad & (x[cols] <= 1e-12 * scale)]
            if not len(drop):
                drop = cols[[int(np.argmin(np.where(bad, x[cols], np.inf)))]]
            x[drop] = 0
            free[drop] = False
    return x


class Plan:
    """Where the n-th piece of each length goes, as runs: (length, first, last + 1, per sequence, sequence, offset)."""

    def __init__(self, counts: np.ndarray, room: int) -> None:
        self.room, self.left, self.taken = room, counts.astype(np.int64).copy(), np.zeros(room + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.space: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        self.sequences = 0

    def put(self, length: int, per: int, base: int, n: int, offset: int) -> None:
        rows, first = per * n, int(self.taken[length])
        self.runs.append((length, first, first + rows, per, base, offset))
        self.taken[length] += rows
        self.left[length] -= rows

    def largest(self, low: int, high: int, used: dict[int, int]) -> int:
        """The largest length in [low, high] of which pieces are left."""
        for length in range(min(high, self.room), max(low, 1) - 1, -1):
            if self.left[length] > used.get(length, 0):
                return length
        return 0

    def repeat(self, chosen: list[int], times: int, width: int) -> None:
        """Fill `times` sequences by a pattern of bins, as long as its members last."""
        while times > 0:
            used: dict[int, int] = {}
            total = 0
            for i, b in enumerate(chosen):
                last = i == len(chosen) - 1
                length = self.largest(1 if last else (b - 1) * width + 1, self.room - total if last else b * width, used)
                if not length:
                    return
                used[length] = used.get(length, 0) + 1
                total += length
            n = int(min([times, *(self.left[x] // k for x, k in used.items())]))
            offset = 0
            for length, k in used.items():
                self.put(length, k, self.sequences, n, offset)
                offset += k * length
            self.space[self.room - total].append((self.sequences, n))
            self.sequences += n
            times -= n

    def rest(self) -> None:
        """Best fit decreasing for what is left: the tightest space first, as many of a length as it holds."""
        for length in range(self.room, 0, -1):
            fit = length
            while self.left[length]:
                while fit < self.room and not self.space[fit]:
                    fit += 1
                if self.space[fit]:
                    base, n = self.space[fit].pop()
                else:
                    base, n = self.sequences, int(-(-self.left[length] // (self.room // length)))
                    self.sequences += n
                per = min(fit // length, int(self.left[length]))
                m = min(n, int(self.left[length]) // per)
                self.put(length, per, base, m, self.room - fit)
                self.space[fit - per * length].append((base, m))
                if m < n:
                    self.space[fit].append((base + m, n - m))


def plan(histogram: dict[int, int], room: int = ROOM, bins: int = BINS, members: int = MEMBERS) -> Plan:
    """Patterns fitted to the histogram, rounded, then the rest."""
    counts = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    made, width = Plan(counts, room), -(-room // bins)
    goal = np.array([counts[b * width + 1:(b + 1) * width + 1].sum() for b in range(bins)], float)
    table = patterns(bins, members)
    times = np.floor(nnls(table, goal) + 0.5).astype(np.int64)
    for j in sorted(np.flatnonzero(times), key=lambda j: (-times[j], j)):
        chosen = [b + 1 for b in range(bins - 1, -1, -1) for _ in range(int(table[b, j]))]
        made.repeat(chosen, int(times[j]), width)
    made.rest()
    return made


def place(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) -> with sequence_id and offset."""
    spark = cut.sparkSession
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {int(r["length"]): int(r["n"]) for r in counts}
    slices = 1 + sum(histogram.values()) // SLICE
    runs = plan(histogram, room).runs
    schema = "_length long, _first long, _last long, _per long, _base long, _offset long"
    table = spark.createDataFrame(runs, schema)  # a few runs per length and pattern, whatever the number of pieces
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (sliced.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["length", "_slice"])
              .withColumn("_rank", F.col("_row") + F.col("_start")))
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    turn = F.col("_rank") - F.col("_first")
    return (ranked.join(F.broadcast(table), on)
            .withColumn("sequence_id", (F.col("_base") + F.floor(turn / F.col("_per"))).cast("long"))
            .withColumn("offset", (F.col("_offset") + turn % F.col("_per") * F.col("length")).cast("long"))
            .select(*cut.columns, "sequence_id", "offset"))


def pack(docs: DataFrame, room: int = ROOM, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(keep(pieces(docs, room, vocabulary, with_ids), "pieces"), room)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id and its ids in order; a sequence holds at most `room` of them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
