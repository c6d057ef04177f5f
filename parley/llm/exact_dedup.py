"""Exact dedup by a Golomb-coded fingerprint exchange.

Every block of rows sends its sorted distinct fingerprints, Golomb coded, to the owners of their ranges. An owner
answers each list with a bitmap of the fingerprints that it saw more than once. Rows with a marked fingerprint are the
suspects; only their texts are shuffled, grouped by their bytes, and so verified.

Null texts count as empty. Of equal texts the row with the largest id stays; a null id is smaller than any other; of
repeated rows with that id one stays. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import digest, flag_maybe, keep, maybe_in, parts, text_of

#: Bits of a fingerprint: a false suspect costs a look at its text, never a wrong answer.
BITS = 48
#: Rows of a block and, about, fingerprints of an owner.
BLOCK, OWNED = 200_000, 2_000_000


def encode(values: np.ndarray) -> bytes:
    """Golomb code (power-of-two divisor) of sorted distinct integers: divisor, quotients in unary, remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(values[-1]) / len(values)
    k = max(0, int(np.ceil(np.log2(max(1.0, mean * 0.6931)))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(payload: bytes, n: int) -> np.ndarray:
    """The `n` integers of `encode`."""
    if not n:
        return np.zeros(0, np.uint64)
    k, raw = payload[0], np.frombuffer(payload, np.uint8, offset=1)
    ends = np.flatnonzero(np.unpackbits(raw) == 0)[:n]
    high = np.diff(ends, prepend=-1) - 1
    start = (int(ends[-1]) + 8) // 8
    low = np.unpackbits(raw[start:])[:n * k].reshape(n, k).astype(np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps)


def _blocks(owners: int):
    """Rows (id, text_sha256) -> per block and owner: the coded list, and the rows behind each fingerprint."""
    schema = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()),
                        ("repeats", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        serial = TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            nonlocal serial
            found = np.array(held, dtype="S32")
            values = np.array([int.from_bytes(x[:8], "big") for x in held], np.uint64) >> np.uint64(64 - BITS)
            order = np.argsort(values, kind="stable")
            found, values = found[order], values[order]
            distinct, first, repeats = np.unique(values, return_index=True, return_counts=True)
            owner = ((distinct >> np.uint64(BITS - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)
            rows = []
            for o in np.unique(owner):
                a, b = np.searchsorted(owner, [o, o + 1])
                lo, hi = first[a], first[b - 1] + repeats[b - 1]
                rows.append((serial, int(o), int(b - a), encode(distinct[a:b]), repeats[a:b].tolist(),
                             [x.ljust(32, b"\0") for x in found[lo:hi].tolist()]))
            serial += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            held.extend(batch.column("raw").to_pylist())
            if len(held) >= BLOCK:
                yield flush()
        if held:
            yield flush()

    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's lists -> for each list, a bitmap of the fingerprints that other lists hold too."""
    lists = [decode(p, n) for p, n in zip(frame["payload"], frame["n"])]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    bitmaps = []
    for x in lists:
        at = np.searchsorted(twice, x)
        hit = np.zeros(len(x), np.uint8)
        inside = at < len(twice)
        hit[inside] = twice[at[inside]] == x[inside]
        bitmaps.append(np.packbits(hit).tobytes())
    return pd.DataFrame({"block": frame["block"], "owner": frame["owner"], "bitmap": bitmaps})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with their bitmaps -> the digests of suspect rows, each once per list."""
    for batch in batches:
        for row in batch.to_pylist():
            repeats = np.array(row["repeats"])
            hit = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[:len(repeats)].astype(bool) | (repeats > 1)
            found = {d for d, h in zip(row["digests"], np.repeat(hit, repeats)) if h}
            if found:
                yield pa.RecordBatch.from_pydict({"raw": pa.array(sorted(found), pa.binary())})


def suspects(narrow: DataFrame) -> DataFrame:
    """Digests (column text_sha256) whose fingerprint occurs more than once among the rows of `narrow`."""
    spark = narrow.sparkSession
    owners = max(parts(spark), 1 + narrow.count() // OWNED)
    raw = narrow.select(F.unhex("text_sha256").alias("raw"))
    blocks = keep(raw.mapInArrow(_blocks(owners), "block long, owner int, n int, payload binary, repeats array<int>, digests array<binary>"), "blocks")
    lists = blocks.select("block", "owner", "n", "payload")
    answers = lists.groupBy("owner").applyInPandas(_answer, "block long, owner int, bitmap binary")
    back = blocks.select("block", "owner", "repeats", "digests").join(answers, ["block", "owner"])
    return (back.select("repeats", "digests", "bitmap").mapInArrow(_suspects, "raw binary")
            .select(F.lower(F.hex("raw")).alias("text_sha256")))


def copies(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """Verified groups of two rows or more: text_sha256, keep_id, group_size. `narrow` holds (doc_id, text_sha256)."""
    seen = keep(suspects(narrow).distinct(), "suspects")
    wide = docs.select("doc_id", text_of("text").alias("text")).withColumn("text_sha256", digest(F.col("text")))
    # grouping by the text itself compares its bytes; equal texts of a task become one row before the shuffle
    groups = (maybe_in(wide, F.col("text_sha256"), seen, "text_sha256").groupBy("text_sha256", "text")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    one = (groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                             F.max("group_size").alias("group_size")))
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("group_size"))
    return one.select("text_sha256", "keep_id", clash.cast("long").alias("group_size")).where("group_size > 1")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_of("text")).alias("text_sha256")), "digests")
    groups = keep(copies(docs, narrow), "copies")
    place = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id"))
    return (narrow.withColumn("_place", place).join(groups, "text_sha256", "left")
            .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_place") == 1))).alias("kept"),
                    "text_sha256"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows of unique texts are not shuffled."""
    narrow = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_of("text")).alias("text_sha256")), "digests")
    groups = keep(copies(docs, narrow), "copies").select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_copied"))
    marked = flag_maybe(docs.withColumn("_sha", digest(text_of("text"))), F.col("_sha"), groups, "_sha")
    kept = (marked.where("_maybe").join(groups, "_sha", "left")
            .where(F.col("_copied").isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col("_keep"))))
    # repeated rows with the id that stays: a third of all rows may be one such text, so each task keeps one of them first
    single = kept.withColumn("_place", F.row_number().over(Window.partitionBy("_sha", "doc_id").orderBy("doc_id"))).where("_place = 1")
    return marked.where("NOT _maybe").select(docs.columns).unionByName(single.select(docs.columns))
