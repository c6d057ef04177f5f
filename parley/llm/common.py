"""Shared helpers: intermediate tables, narrow input columns, and a bounded filter in front of wide shuffles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of the bitmap in front of a wide shuffle: 2**17 words of 64 bits, about 2 MB whatever the input.
FILTER_WORDS = 1 << 17


def configure(spark: SparkSession) -> SparkSession:
    """Arrow batches of a thousand rows: ten thousand long texts at once are tens of megabytes, several times per task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names in spark.checkpoint.dir.

    A session with a single local JVM that names none gets a temporary one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="parley-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str | Column) -> Column:
    """A text, empty for null."""
    return F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, lower-case hex."""
    return F.sha2(text, 256)


def id_key(col: str = "doc_id") -> Column:
    """An id as text, empty for null: what folds and slots are hashed from."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_key(col).cast("binary")) % F.lit(modulus)


def flag_maybe(df: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """Add `_maybe`: false only where the key is surely not among `keys`.

    What is broadcast is a bitmap of FILTER_WORDS words, so its size is bounded whatever the number of keys.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))
    bits = keys.select(spot(F.col(column)).alias("_spot"))
    words = (bits.select((F.col("_spot") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, int(_spot % 64))").alias("_mask"))
             .groupBy("_word").agg(F.bit_or("_mask").alias("_mask")))
    marked = df.withColumn("_spot", spot(key)).withColumn("_word", (F.col("_spot") / 64).cast("int"))
    hit = F.expr("(shiftright(coalesce(_mask, 0L), int(_spot % 64)) & 1L) = 1L")
    return marked.join(F.broadcast(words), "_word", "left").withColumn("_maybe", hit).drop("_word", "_spot", "_mask")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key may be among `keys`: no row of a listed key is lost, most others go before any shuffle."""
    return flag_maybe(df, key, keys, column).where("_maybe").drop("_maybe")


def texts(batches: Iterator[pa.RecordBatch], rows: int, volume: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `rows` rows and, above one row, about `volume` bytes of its last column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.num_columns - 1)
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1, offset=4 * column.offset)
                        if not pa.types.is_large_string(column.type)
                        else np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset))
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or size + n > volume):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back to the system: a worker is used again by later tasks, beside an executor near its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def strings_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them (nulls are empty)."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1, offset=np.dtype(kind).itemsize * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Groups that hold at least one row in so many are cut by their count before any exchange: there are at most that many.
LARGE_GROUPS = 10_000


def lowest(rows: DataFrame, group: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows (group, doc_id) of each group, those whose ids hash lowest.

    Rows are cut where they are read: of a large group, whose count is broadcast, only a few times `most` rows are ranked.
    Smaller groups, with less than one row in LARGE_GROUPS each, are ranked whole.
    """
    counts = keep(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "groups")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    large = counts.where(F.col("_n") * LARGE_GROUPS >= total)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = (rows.withColumn("_chance", chance).join(F.broadcast(large), group, "left")
            .where(F.col("_n").isNull() | (F.col("_chance") * F.col("_n") <= 2 * most + 200)))
    order = Window.partitionBy(group).orderBy("_chance", "doc_id")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(group, "doc_id")
