"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME = {
    # adaptive planning: merges small shuffle partitions, splits hot ones, turns small joins to broadcasts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wide conditional expressions make the planner's constraint inference exponential
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local(cores: str = "8", partitions: str = "8") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("parley")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", partitions))
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
