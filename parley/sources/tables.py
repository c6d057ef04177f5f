"""Inputs derived from the given parquet tables: catalogues, sessions, turns and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.plans import scale

ROOT_CATEGORY = "Clothing, Shoes & Jewelry"

# Scalar SQL that reads the same in Spark and in the checking engine.
SCENARIO = """CASE WHEN session_id % 20 < 8 THEN 'buying' WHEN session_id % 20 < 16 THEN 'browsing'
 WHEN session_id % 20 < 19 THEN 'intent_override' ELSE 'boundary' END"""
OVERRIDE_TURN = "CASE WHEN session_id % 20 BETWEEN 16 AND 18 THEN 3 + session_id % 2 ELSE 1 END"
MESSAGE = """CASE
 WHEN turn = 1 AND scenario_type = 'buying'
  THEN 'I''m looking for ' || p_type || ' ' || split_part(p_name, ' ', 2) || '. A key requirement is: ' || p_name || '.'
 WHEN turn = 1 AND scenario_type = 'intent_override'
  THEN 'I''m looking for ' || p_type || ' ' || split_part(p_name, ' ', 2) || '. ' || p_brand
 WHEN turn = 1
  THEN 'I''m looking for ' || p_type || ' ' || split_part(p_name, ' ', 2) || ', but I''m still exploring.'
 WHEN scenario_type = 'intent_override' AND turn = override_turn
  THEN 'Actually, ignore my earlier preference. What I need is: ' || p_name || '.'
 WHEN scenario_type = 'boundary' AND turn = 2
  THEN 'I don''t have a preference for size; please use your judgment.'
 WHEN (session_id + turn) % 7 = 0 THEN 'I don''t have an additional preference for style.'
 WHEN (session_id + turn) % 7 = 1 AND session_id % 2 = 0
  THEN 'Maybe size ' || p_size || ' department ' || p_type || ' would do'
 WHEN (session_id + turn) % 7 = 1 THEN 'Could you show me a ' || p_name || ' perhaps'
 WHEN (session_id + turn) % 7 = 2 THEN 'Those options are not quite right yet. Ask me about one specific attribute.'
 WHEN (session_id + turn) % 7 = 3
  THEN 'For that, what matters is: color: ' || split_part(p_name, ' ', 1) || '; ' || p_brand || '.'
 ELSE 'For that, what matters is: ' || p_name || '.' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scale.spread(df) if name == "documents" else df


def items(spark: SparkSession, d: str) -> DataFrame:
    """Long-text catalogue: documents as items."""
    none = F.expr("cast(array() as array<string>)")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), first.alias("title"), none.alias("features"),
        F.array(F.expr("substr(text, length(split_part(text, '\n', 1)) + 2)")).alias("description"),
        F.array("lang").alias("categories"), F.expr("cast(map() as map<string,string>)").alias("details"),
        F.col("source").alias("store"), F.lit(None).cast("double").alias("price"),
        F.col("n_chars").alias("rating_number"))


def products(spark: SparkSession, d: str) -> DataFrame:
    """Short-field catalogue: parts as items, order lines as reviews."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    # narrow rows that cost much each: the adaptive planner would merge them into a task or two
    return table(spark, d, "part").join(n, "p_partkey", "left").repartition(scale.slots(spark), "p_partkey").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.array("p_name", "p_type").alias("features"),
        F.expr("cast(array() as array<string>)").alias("description"),
        F.array(F.lit(ROOT_CATEGORY), F.col("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("categories"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("department"), F.col("p_type")).alias("details"),
        F.col("p_brand").alias("store"), F.col("p_retailprice").alias("price"),
        F.coalesce("n", F.lit(0)).alias("rating_number"))


#: Turns of a session; an order with more lines becomes several sessions, PART apart.
TURNS, PART = 10, 10 ** 15


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their session, turn and part of the order. Rows stay dealt by order, so what is grouped by order and part is not
    dealt again."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").alias("price"), "l_linenumber", "l_quantity", "l_shipdate")
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "item_id", "price", "l_quantity", "l_shipdate")) - 1
    rows = rows.withColumn("_line", line)
    part = F.floor(F.col("_line") / TURNS)
    return rows.select("l_orderkey", part.alias("part"), (F.col("_line") % TURNS + 1).cast("int").alias("turn"), "item_id", "price")


def _session_id():
    return (F.col("l_orderkey") + F.col("part") * F.lit(PART)).cast("bigint").alias("session_id")


def session_lines(spark: SparkSession, d: str) -> DataFrame:
    """One candidate item per session and turn, from every order line."""
    return _lines(spark, d).select(_session_id(), "turn", "item_id", "price")


_TARGET = "min_by(item_id, struct(-price, item_id))"


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """One row per session: its distinct items, its target, and the item of its first turn."""
    return _lines(spark, d).groupBy("l_orderkey", "part").agg(
        F.collect_set("item_id").alias("items"), F.expr(_TARGET).alias("target"),
        F.min_by("item_id", F.col("turn")).alias("first_item")).select(_session_id(), "items", "target", "first_item")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the 40/40/15/5 scenario mix; the target is the dearest line."""
    best = _lines(spark, d).groupBy("l_orderkey", "part").agg(F.expr(_TARGET).alias("target")).select(_session_id(), "target")
    return best.select("session_id", "target", F.expr(SCENARIO).alias("scenario_type"),
                       F.expr(OVERRIDE_TURN).cast("int").alias("override_turn"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Logged recommendations, one row each, with an unknown id and repeats for the normaliser."""
    rows = session_lines(spark, d)
    out = F.filter(F.array(
        F.struct(F.col("turn").alias("turn"), F.lit(1).alias("pos"), F.lit(-1).cast("bigint").alias("item_id")),
        F.struct(F.col("turn").alias("turn"), F.lit(2).alias("pos"), F.col("item_id").alias("item_id")),
        F.struct(F.col("turn").alias("turn"), F.lit(3).alias("pos"), F.col("item_id").alias("item_id")),
        F.struct((F.col("turn") - 1).alias("turn"), F.lit(4).alias("pos"), F.col("item_id").alias("item_id"))),
        lambda r: r["turn"] >= 1)
    return rows.select("session_id", F.inline(out))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One customer message per session and turn, covering every shape. Scenario and override turn follow from the session's id."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type", "p_brand", "p_size")
    rows = session_lines(spark, d).filter("session_id is not null").join(part, "item_id")
    rows = rows.withColumn("scenario_type", F.expr(SCENARIO)).withColumn("override_turn", F.expr(OVERRIDE_TURN))
    return rows.select("session_id", "turn", F.expr(MESSAGE).alias("user_message"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """The customer's turns of the given conversations, numbered from 1."""
    rows = table(spark, d, "conversations").filter("role = 'user'")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return rows.select(F.col("conv_id").alias("session_id"), turn.alias("_turn"), "text").select(
        "session_id", F.col("_turn").alias("turn"), F.col("text").alias("user_message"))


def free_messages(spark: SparkSession, d: str) -> DataFrame:
    """Free text for mining."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("message_id"), F.col("text").alias("user_message"))


def act_scores(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("label")) for i, a in enumerate(fixed.ACTS)])
    return table(spark, d, "events").select(
        F.col("event_id").alias("message_id"), (1 + F.col("event_id") % 10).cast("int").alias("turn"),
        F.inline(labels)).withColumn(
        "score", ((F.col("message_id") * (7 * F.col("ord") + 3)) % 101) / F.lit(10.0))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative token totals per user, accumulated over hourly slices."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts")
    run = scale.running(ev, ["session_id"], ["ts", "event_id"], hour_of(), {"prompt_total": F.col("event_id") % 17})
    return run


def hour_of():
    return F.floor(F.col("ts").cast("timestamp").cast("double") / 3600)
