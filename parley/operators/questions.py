"""Question choice: which attribute splits the candidate pool best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx
from parley.settings import DEFAULTS, Settings


def _told(pool: DataFrame, disclosed: DataFrame) -> DataFrame:
    """The pool with what each query was told; a pool that has it already stays."""
    if "told" in pool.columns:
        return pool.select("query_id", "item_id", "told")
    # disclosures grow with the queries, and the planner cannot tell the size of lists: never broadcast
    return pool.select("query_id", "item_id").join(disclosed.select("query_id", F.col("vals").alias("told")).hint("merge"), "query_id", "left")


def reply_signatures(pool: DataFrame, by_attribute: DataFrame, disclosed: DataFrame | None = None,
                     normalize: bool = False, by_query: bool = False) -> DataFrame:
    """(query, item, attribute) -> first two undisclosed values the item would answer with.

    `disclosed` holds (query_id, vals), or the pool a list `told` of its own. Items that cannot answer have two null values.
    Matching is by exact string; with `normalize` values and disclosures are compared as token phrases. With `by_query` a query's
    items meet before they become a row an attribute, so that `expected_pool` deals nothing out again.
    """
    attrs = F.array(*[F.lit(a) for a in fixed.QUESTION_ORDER if a not in fixed.NEVER_ASKED])
    packed = by_attribute.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("attribute", "vals"))).alias("m"))
    none = F.expr("cast(array() as array<string>)")
    # what was told is shorter than an item's values: it goes to the items, and values travel no further
    met = _told(pool, disclosed).join(packed.hint("merge"), "item_id", "left")
    rows = ((met.repartition("query_id") if by_query else met)
            .withColumn("told", F.coalesce("told", none)).withColumn("attribute", F.explode(attrs))
            .withColumn("vals", F.coalesce(F.try_element_at("m", F.col("attribute")), none)))

    def seen(v):
        return F.array_contains("told", tx.phrase_of(tx.tokens(v)) if normalize else v)

    left = F.filter("vals", lambda v: ~seen(v))
    if not normalize:  # most values are not told, and a test of the whole list is compiled
        left = F.when((F.size("told") > 0) & ~F.arrays_overlap("told", "vals"), F.col("vals")).otherwise(left)
    return rows.select("query_id", "item_id", "attribute", left.alias("left")).select(
        "query_id", "item_id", "attribute", F.try_element_at("left", F.lit(1)).alias("first"),
        F.try_element_at("left", F.lit(2)).alias("second"))


def expected_pool(signatures: DataFrame) -> DataFrame:
    """Expected surviving pool per question: sum(n^2) / N over the signature blocks."""
    blocks = signatures.groupBy("query_id", "attribute", "first", "second").agg(F.count("*").alias("n"))
    return blocks.groupBy("query_id", "attribute").agg(
        F.sum("n").alias("pool_size"),
        (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("expected"))


def _place(order) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in order]), F.col("attribute"))


def next_question(expected: DataFrame, options: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(query, attribute, expected) x askable options -> the question to ask.

    The least expected pool wins, ties in question order; a pool of fewer than two items, or an
    empty one, falls back to the fixed order.
    """
    rows = options.filter(~F.col("attribute").isin(*fixed.NEVER_ASKED)).join(
        expected, ["query_id", "attribute"], "left")
    small = F.coalesce(F.col("pool_size"), F.lit(0)) < 2
    key = F.struct(F.when(~small, F.round("expected", cfg.score_digits)).alias("e"),
                   F.when(small, _place(fixed.FALLBACK_ORDER)).otherwise(_place(fixed.QUESTION_ORDER)).alias("p"))
    return rows.groupBy("query_id").agg(F.min_by("attribute", key).alias("ask_attribute"))


def fallback_question(options: DataFrame) -> DataFrame:
    """First askable attribute of the fixed order."""
    return options.filter(~F.col("attribute").isin(*fixed.NEVER_ASKED)).groupBy("query_id").agg(
        F.min_by("attribute", _place(fixed.FALLBACK_ORDER)).alias("ask_attribute"))


def attribute_payout(values: DataFrame) -> DataFrame:
    """Share of items that hold a value of each family."""
    fams = values.select("item_id", F.explode(F.array_distinct(
        F.transform("vals", tx.family))).alias("family"))
    total = values.agg(F.count("*").alias("n"))
    return fams.groupBy("family").agg(F.count("*").alias("n_items")).withColumn(
        "share", F.col("n_items") / total.scalar())


def replay_questions(turns: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(session_id, turn, expected map) -> the question of every turn, each typed one asked once.

    `expected` maps attribute -> (pool_size, expected); null means an empty pool. The choice of a turn
    depends on the questions before it, so a session (at most `max_turns` turns) folds in one row.
    """
    options = [a for a in fixed.QUESTION_ORDER if a not in fixed.NEVER_ASKED]
    fallback = [a for a in fixed.FALLBACK_ORDER if a not in fixed.NEVER_ASKED]

    def choice(asked, expected):
        def free(a):
            return F.lit(True) if a == fixed.REPEATABLE else ~F.array_contains(asked, a)

        small = F.coalesce(F.try_element_at(expected, F.lit(fixed.REPEATABLE))["pool_size"], F.lit(0)) < 2
        scored = F.array_min(F.array(*[F.when(free(a), F.struct(
            F.round(F.try_element_at(expected, F.lit(a))["expected"], cfg.score_digits).alias("e"),
            F.lit(i).alias("i"), F.lit(a).alias("a"))) for i, a in enumerate(options)]))["a"]
        first = F.coalesce(*[F.when(free(a), F.lit(a)) for a in fallback])
        return F.when(small, first).otherwise(scored)

    state = "struct<asked:array<string>,out:array<struct<turn:int,ask:string>>>"
    zero = F.expr(f"cast(named_struct('asked', array(), 'out', array()) as {state})")

    def step(acc, t):
        return tx.let(choice(acc["asked"], t["expected"]), lambda a: F.struct(
            F.array_union(acc["asked"], F.array(a)).alias("asked"),
            F.concat(acc["out"], F.array(F.struct(t["turn"].cast("int").alias("turn"), a.alias("ask")))).alias("out")
        )).cast(state)

    per = turns.filter(F.col("turn") <= cfg.max_turns).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "expected")), lambda a, b: a["turn"] - b["turn"]).alias("ts"))
    return per.select("session_id", F.inline(F.aggregate("ts", zero, step, lambda a: a["out"]))).withColumnRenamed(
        "ask", "ask_attribute")
