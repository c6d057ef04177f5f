"""Document fingerprints by a randomised edit embedding.

A walk shared by all documents reads a text from its start: at each step a random function of the step and of the two
characters at hand moves it on by one or two characters and gives a bit. Two walks that an edit has parted drift until
they meet again, so few edits change few bits: edit distance becomes Hamming distance. Steps are sampled evenly within
each doubling of the walk's length, so a fingerprint of some hundred bits covers the whole text, and each bit stands for
as many steps as its doubling has per sample. Bands of sampled bits propose similar documents, and the fingerprints
verify them.

The next document is the one with the next lower id, after the lowest the highest; null ids come last; rows of one id
are ordered by text. A single row is its own next one. Null texts count as empty, empty texts are alike. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import keep, mix, parts, text_of, texts
from parley.llm.components import components

#: Samples of a doubling, doublings (walks of up to 2**34 steps), steps between two looks at which walks have ended.
SAMPLES, DOUBLINGS, STRIDE = 32, 34, 32
#: Times that bands which hold several components of similar documents are tried with new heads, before all their pairs are.
ROUNDS = 2
COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, part_first long, edge boolean")


@functools.cache
def sampled() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps, rising, and how many steps each stands for."""
    rng = np.random.default_rng(11)
    steps, weights = [0], [1.0]
    for k in range(DOUBLINGS):
        width = 1 << k
        chosen = np.arange(width) if width <= SAMPLES else np.unique(rng.integers(0, width, SAMPLES))
        steps.extend((width + chosen).tolist())
        weights.extend([width / len(chosen)] * len(chosen))
    return np.array(steps), np.array(weights)


def _random(steps: np.ndarray, kind: int) -> np.ndarray:
    return mix(steps.astype(np.uint64) * np.uint64(4) + np.uint64(kind + 0x5851F42D4C957F2D))


def fingerprints(found: list[str]) -> list[str]:
    """A fingerprint per text: the number of sampled bits that its walk reached, and the bits in hexadecimal."""
    if not found:
        return []
    order = sorted(range(len(found)), key=lambda i: -len(found[i]))
    gap = "\0" * (2 * STRIDE + 2)
    codes = np.frombuffer("".join(found[i] + gap for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    symbols = mix(codes[:-1] + (codes[1:] << np.uint64(21)))
    sizes = np.array([len(found[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    ends = starts + sizes
    steps, _ = sampled()
    bits = np.zeros((int(np.searchsorted(steps, int(sizes[0]) + 2 * STRIDE)) + 1, len(order)), np.uint8)
    reached = np.zeros(len(order), np.int64)
    alive = np.flatnonzero(sizes)
    at, step, sample = starts[alive], 0, 0
    while len(alive):
        block = np.arange(step, step + STRIDE)
        factor, shift = _random(block, 0) | np.uint64(1), _random(block, 1)
        factor2, shift2 = _random(block, 2) | np.uint64(1), _random(block, 3)
        stop = ends[alive]
        for j in range(STRIDE):
            seen = symbols[at]
            if step == steps[sample]:
                inside = at < stop
                bits[sample, alive[inside]] = ((seen[inside] * factor2[j] + shift2[j]) >> np.uint64(63)).astype(np.uint8)
                reached[alive[inside]] += 1
                sample += 1
            at = at + ((seen * factor[j] + shift[j]) >> np.uint64(63)).astype(np.int64) + 1
            step += 1
        going = at < stop
        alive, at = alive[going], at[going]
    out = [""] * len(order)
    for column, i in enumerate(order):
        n = int(reached[column])
        out[i] = f"{n:x}:{np.packbits(bits[:n, column]).tobytes().hex()}"
    return out


def _bits(fingerprint: str) -> np.ndarray:
    count, _, told = fingerprint.partition(":")
    return np.unpackbits(np.frombuffer(bytes.fromhex(told), np.uint8))[:int(count, 16)]


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, about 0 for unrelated texts: steps that agree beyond chance, of the longer walk's."""
    if a == b:
        return 1.0
    x, y = _bits(a), _bits(b)
    weights = sampled()[1]
    n = min(len(x), len(y))
    differ = float(weights[:n][x[:n] != y[:n]].sum())
    whole = float(weights[:max(len(x), len(y))].sum())
    return round(max(0.0, (float(weights[:n].sum()) - 2 * differ) / whole), 6) if whole else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _described(found: list[str]) -> list[tuple]:
    """For each text but the last: n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    changed = [edited(a, b) for a, b in zip(found, found[1:])]
    prints = fingerprints(found + changed)
    own, other = prints[:len(found)], prints[len(found):]
    return [(len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), a, e, likeness(a, e), likeness(a, b))
            for t, c, a, e, b in zip(found, changed, own, other, own[1:])]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition -> its rows; the last one, whose next is elsewhere, is an edge without values."""
    first, held, started = None, None, False
    for batch in texts(batches, 2048, 1_500_000):
        ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not started:
            first, started = ids[0], True
        if held is not None:
            ids, found = [held[0], *ids], [held[1], *found]
        held = (ids[-1], found[-1])
        if len(ids) > 1:
            yield _batch([(i, *d, None, False) for i, d in zip(ids, _described(found))])
    if held is not None:
        yield _batch([(held[0], len(held[1]), None, None, None, None, None, first, True)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in COLUMNS.split(", ")])


def _edge(frame: pd.DataFrame) -> pd.DataFrame:
    """An edge and its next row, of each id the last or first text."""
    own = frame[frame["role"] == 0].sort_values("text", key=lambda s: s.map(lambda t: t.encode("utf-8", "surrogatepass")))
    after = frame[frame["role"] == 1].sort_values("text", key=lambda s: s.map(lambda t: t.encode("utf-8", "surrogatepass")))
    row = own.iloc[-1]
    told = _described([row["text"], after.iloc[0]["text"]])[0]
    return pd.DataFrame([(None if pd.isna(row["doc_id"]) else int(row["doc_id"]), *told, None, True)], columns=[c.split()[0] for c in COLUMNS.split(", ")])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The table is dealt out by ranges of ids once; only the last row of each range waits for its next one.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    dealt = narrow.repartitionByRange(4 * parts(spark), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    told = keep(dealt.mapInArrow(_walk, COLUMNS), "fingerprints")
    # one row a partition: its first and last id
    ranges = [(r["part_first"], r["doc_id"]) for r in told.where("edge").select("part_first", "doc_id").collect()]
    ranges.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
    if not ranges:
        return told.drop("part_first", "edge")
    ids = [(k, 0, last) for k, (_, last) in enumerate(ranges)] + [((k - 1) % len(ranges), 1, first) for k, (first, _) in enumerate(ranges)]
    asked = spark.createDataFrame(ids, "pair int, role int, _id long")
    edges = narrow.join(F.broadcast(asked), F.col("doc_id").eqNullSafe(F.col("_id"))).select("pair", "role", "doc_id", "text")
    pick = edges.groupBy("pair", "role", "doc_id").agg(F.when(F.col("role") == 0, F.max("text")).otherwise(F.min("text")).alias("text"))
    # two texts a pair, one pair a range: dealt out, as a whole text may be long
    dealt_pairs = pick.repartition(parts(spark), "pair").groupBy("pair")
    whole = told.where("NOT edge").unionByName(dealt_pairs.applyInPandas(_edge, COLUMNS))
    return whole.drop("part_first", "edge")


def band_keys(fingerprint: str, least: float, bands: int, width: int) -> list[str]:
    """Keys of a fingerprint's bands. Walks that can be `least` alike differ in weight by 1 / least at most, so they are in
    one class of lengths or in neighbouring ones; every walk has the bands of its class and of the one below."""
    found = _bits(fingerprint)
    if not len(found):
        return []
    base = 1 / max(least - 1e-6, 0.01)
    level = int(np.floor(np.log(sampled()[1][:len(found)].sum()) / np.log(base)))
    return [f"{c}:{k}:{''.join(map(str, found[pick].tolist()))}" for c in range(max(0, level - 1), level + 1) for k, pick in enumerate(_picks(c, base, bands, width))]


@functools.cache
def _picks(level: int, base: float, bands: int, width: int) -> list[np.ndarray]:
    """Bits of every band of a class, drawn by the steps they stand for from all bits that each of its walks has reached."""
    weights = sampled()[1]
    total = np.cumsum(weights)
    shared = max(1, int(np.searchsorted(total, base ** level, "right")))
    return [np.unique(np.random.default_rng([12, level, k]).choice(shared, width, p=weights[:shared] / total[shared - 1])) for k in range(bands)]


def similar(prints: DataFrame, least: float = 0.8, bands: int = 16, width: int = 24) -> DataFrame:
    """Pairs of documents (doc_id, fingerprint), doc_id the higher one, that share a band and are `least` or more alike:
    doc_id, head_id, likeness. A band samples up to `width` bits of the whole walk.

    Not every such pair is given, but as many as leave nothing apart that these pairs connect: equal fingerprints are one,
    each band's rows are compared with its least id, then ROUNDS times those outside its largest component with the least
    of them, and what is still apart with all rows of the band's other components.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = band_keys(p, least, bands, width)
                keys += own
                owners += [(i, p)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([o[0] for o in owners], pa.int64()), pa.array([o[1] for o in owners], pa.string())], names=["band", "doc_id", "fingerprint"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [likeness(a, b) for a, b in zip(batch.column("fingerprint").to_pylist(), batch.column("_print").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "likeness"])

    def alike(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().mapInArrow(verify, "doc_id long, fingerprint string, head_id long, _print string, likeness double").where(F.col("likeness") >= least)

    def other(t: DataFrame, *more: str) -> DataFrame:
        return t.select("band", F.col("doc_id").alias("head_id"), F.col("fingerprint").alias("_print"), *[F.col(c).alias(f"_{c}") for c in more])

    own = prints.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")
    first = keep(own.groupBy("fingerprint").agg(F.min("doc_id").alias("head_id")), "firsts")
    rows = keep(first.select(F.col("head_id").alias("doc_id"), "fingerprint").mapInArrow(cut, "band string, doc_id long, fingerprint string"), "bands")
    columns = ("doc_id", "fingerprint", "head_id", "_print")
    least_of = lambda t: F.min(F.struct("doc_id", "fingerprint", *t)).alias("_least")
    heads = rows.groupBy("band").agg(least_of(())).select("band", "_least.*")
    found = keep(alike(rows.join(other(heads), "band").where("fingerprint <> _print").select(*columns)), "alike")
    for k in range(ROUNDS + 1):
        roots = keep(components(found.select(F.col("fingerprint").alias("u"), F.col("_print").alias("v"))), "roots")
        placed = (rows.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
                  .select("band", "doc_id", "fingerprint", F.coalesce("root", "fingerprint").alias("root")))
        main = (placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("band")
                .agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "main"))
        mixed = keep(placed.join(main, "band"), "mixed")
        stray = mixed.where("root <> main")
        if k < ROUNDS:
            met = other(stray.groupBy("band").agg(least_of(("root",))).select("band", "_least.*"), "root")
            pairs = stray.join(met, "band").where("root <> _root")
        else:
            pairs = stray.join(other(mixed, "root"), "band").where("root <> _root AND (_root = main OR fingerprint < _print)")
        found = keep(found.unionByName(alike(pairs.select(*columns))), "alike")
    copies = own.join(first, "fingerprint").select("doc_id", "head_id", F.lit(1.0).alias("likeness"))
    linked = found.select(F.greatest("doc_id", "head_id").alias("doc_id"), F.least("doc_id", "head_id").alias("head_id"), "likeness")
    return copies.unionByName(linked).where("doc_id <> head_id").distinct()
