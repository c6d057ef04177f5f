"""Helpers that keep plans safe at scale: checked broadcasts, lineage cuts, sliced running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from parley.settings import DEFAULTS


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULTS.broadcast_rows, max_bytes: int = DEFAULTS.broadcast_bytes) -> bool:
    """Whether a frame holds at most `max_rows` rows and `max_bytes` characters."""
    width = F.length(F.to_json(F.struct(*df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_checked(df: DataFrame, max_rows: int = DEFAULTS.broadcast_rows, max_bytes: int = DEFAULTS.broadcast_bytes) -> DataFrame:
    """Broadcast hint only when the side is proven to hold at most `max_rows` rows and `max_bytes` characters.

    Beyond the bound the frame is returned without a hint and the join shuffles; the adaptive
    planner then splits hot partitions. Callers `keep` the frame first where the check would
    otherwise be a second computation.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


#: Words of 64 bits of the bitmap in front of a wide shuffle: 2**20, some 16 MB whatever the input.
FILTER_WORDS = 1 << 20


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose 64-bit hash may be among `keys` (same column): no listed one is lost, most others go before any shuffle."""
    word, bit = F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)).cast("int"), F.pmod(key, F.lit(64)).cast("int")
    words = (keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_mask"))
             .groupBy("_word").agg(F.bit_or("_mask").alias("_mask")))
    marked = df.withColumn("_word", word).join(F.broadcast(words), "_word")
    return marked.filter(F.call_function("shiftright", F.col("_mask"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1).select(*df.columns)


def work_folder(spark: SparkSession) -> str:
    """Shared folder named by the cluster in spark.checkpoint.dir.

    Where it is unset, a session with one local JVM gets a temporary folder; on a cluster every executor would write to a
    disk of its own, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/parley-{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Reused intermediate, written once as a table in the shared folder and read back.

    This cuts lineage (plans stay small), survives the loss of executors, and tells the planner the
    real size, so that joins with it broadcast only when it is small.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete the tables this application wrote. Frames that read them must not be used afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def allow_limit(spark: SparkSession, n: int) -> None:
    """Let the planner prune `rank <= n` windows before the shuffle for limits of this size."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "1000")) < n:
        spark.conf.set(key, str(n))


def by_range(df: DataFrame, order: list[str], name: str = "_range") -> DataFrame:
    """Rows in ranges of an order, numbered in that order: a `slice_of` for `running` that suits any spacing of the values.

    There are as many ranges as shuffle partitions, each small enough for one task. They are written once, so that all
    reads see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], slice_of: Column,
            sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key that never bring a whole key into one task.

    `slice_of` must be a non-decreasing function of the first order column. Rows are summed inside
    (key, slice) windows; slice totals, one small row per slice, are then accumulated and added back.
    """
    staged = df.withColumn("_slice", slice_of)
    for name, value in sums.items():
        staged = staged.withColumn(f"_v_{name}", value)
    totals = staged.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = staged.select(*df.columns, "_slice", *[
        F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in sums])
    joined = rows.join(offsets, [*keys, "_slice"])
    return joined.select(*df.columns, *[
        (F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def previous(df: DataFrame, keys: list[str], order: list[str], slice_of: Column,
             value: str, name: str) -> DataFrame:
    """`lag(value)` per key, sliced like `running`: the last value of the nearest earlier slice fills in."""
    staged = df.withColumn("_slice", slice_of)
    last = staged.groupBy(*keys, "_slice").agg(
        F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_slice", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    rows = staged.withColumn("_lag", F.lag(value).over(
        Window.partitionBy(*keys, "_slice").orderBy(*order)))
    return rows.join(carried, [*keys, "_slice"]).select(
        *df.columns, F.coalesce("_lag", "_carry").alias(name))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """1, 2, 3 ... over the distinct values in sorted order, without a single-task sort.

    Range partitions are numbered locally, written once (so that both reads below see the same
    partitioning even after an executor loss), and shifted by the sizes of the partitions before.
    """
    part = (df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
            .select(column, F.spark_partition_id().alias("_part"),
                    F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    part = keep(part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return part.join(F.broadcast(shift), "_part").select(
        column, (F.col("_at") + F.col("_shift") + 1).alias(name))


def slots(spark: SparkSession) -> int:
    """Tasks that narrow rows with costly expressions are dealt to: as many as run at once, or as a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Use all task slots when a scan has fewer splits than slots; larger inputs stay where they are.

    Text operators cost far more per row than the scan, so one shuffle of a small input pays off.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
