"""Evaluation of logged sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.retrieval import top
from parley.settings import DEFAULTS, Settings


def explode_recommendations(turns: DataFrame) -> DataFrame:
    """(session, turn, recommendations array) -> one row per recommendation; a missing list is an empty turn."""
    return turns.select("session_id", "turn", F.posexplode("recommendations").alias("pos", "item_id"))


def normalize_recommendations(recs: DataFrame, catalogue: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(session, turn, pos, item) -> known, distinct items in first-appearance order, first k, with rank.

    Blank and unknown ids are dropped; repeats collapse inside each task before the shuffle.
    """
    kind = catalogue.schema["item_id"].dataType.simpleString()
    rows = recs
    if recs.schema["item_id"].dataType.simpleString() == "string":
        rows = rows.withColumn("item_id", F.btrim("item_id")).filter("item_id <> ''")
        rows = rows if kind == "string" else rows.withColumn("item_id", F.col("item_id").try_cast(kind))
    first = rows.groupBy("session_id", "turn", "item_id").agg(F.min("pos").alias("pos"))
    known = first.join(catalogue.select("item_id"), "item_id", "left_semi")
    return top(known, ["session_id", "turn"], [F.asc("pos")], cfg.top_k, "rank")


def first_hits(ranked: DataFrame, sessions: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per session: hit, first hit turn, best rank, reciprocal rank.

    A hit counts from the override turn on and up to the turn cap.
    """
    hit = (ranked.filter(F.col("turn").between(1, cfg.max_turns))
           .join(sessions.select("session_id", "target", "override_turn"), "session_id")
           .filter((F.col("item_id") == F.col("target")) & (F.col("turn") >= F.col("override_turn")))
           .groupBy("session_id").agg(F.min(F.struct("turn", "rank")).alias("h")))
    rank = F.col("h.rank")
    return sessions.join(hit, "session_id", "left").select(
        "session_id", "scenario_type", F.col("h").isNotNull().alias("hit"),
        F.col("h.turn").cast("int").alias("first_hit_turn"), rank.cast("int").alias("best_rank"),
        F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal_rank"))


def _measures(cfg: Settings) -> list[Column]:
    turn = F.coalesce("first_hit_turn", F.lit(cfg.miss_turn))
    return [F.count("*").alias("sample_count"),
            F.bround(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)), 6).alias("hit_rate_at_10"),
            F.bround(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"),
            F.bround(F.avg(turn), 6).alias("mttc")]


def summary(results: DataFrame, by: list[str] | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    return (results.groupBy(*by) if by else results.groupBy()).agg(*_measures(cfg))


def summary_rollup(results: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Overall and per scenario in one aggregation; the overall row is named `overall`."""
    rolled = results.rollup("scenario_type").agg(F.grouping("scenario_type").alias("_all"), *_measures(cfg))
    return rolled.withColumn("scenario_type", F.when(F.col("_all") == 1, "overall").otherwise(
        F.col("scenario_type"))).drop("_all")


def composite(summaries: DataFrame) -> DataFrame:
    """Efficiency and the composite score, from the rounded metrics; null when there is no session."""
    eff = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - F.col("mttc")) / 10.0))
    eff = F.when(F.col("mttc").isNotNull(), eff)
    return summaries.withColumn("efficiency", F.bround(eff, 6)).withColumn(
        "technical_score",
        F.bround(0.50 * F.col("hit_rate_at_10") + 0.30 * F.col("mrr") + 0.20 * eff, 6))


def token_totals(usage: DataFrame) -> DataFrame:
    """(prompt_tokens, completion_tokens) of all turns; missing and negative counts are ignored.

    In variant columns, which know the types of the JSON, only whole numbers count: numeric strings and fractions do not.
    """
    kinds = dict(usage.dtypes)

    def total(name):
        c = F.col(name)
        if kinds[name] == "variant":
            c = F.when(F.schema_of_variant(c) == "BIGINT", F.try_variant_get(c, "$", "bigint"))
        c = c.cast("string")
        n = F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
        return F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(name)
    return usage.agg(total("prompt_tokens"), total("completion_tokens")).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def compare_runs(left: DataFrame, right: DataFrame, on: str = "scenario_type") -> DataFrame:
    """Metric differences of two runs per suite; suites of only one run are kept."""
    names = ["hit_rate_at_10", "mrr", "mttc"]
    a = left.select(on, *[F.col(n).alias(f"{n}_a") for n in names])
    b = right.select(on, *[F.col(n).alias(f"{n}_b") for n in names])
    return a.join(b, on, "full").select(
        on, *[c for n in names for c in (f"{n}_a", f"{n}_b")],
        *[F.bround(F.col(f"{n}_b") - F.col(f"{n}_a"), 6).alias(f"{n}_delta") for n in names])


def weighted_sample(items: DataFrame, exponent: float, n: int, seed: str = "fold") -> DataFrame:
    """n items without replacement, P proportional to review_count ^ exponent, repeatable.

    Exponential race: every item draws -ln(u)/w from a hash of its id and the n smallest win.
    Each task keeps only its own n best before they are merged.
    """
    scale_ = float(16 ** 13)
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("item_id").cast("string")), 256),
                            1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(scale_)
    w = F.pow(F.greatest(F.col("rating_number").cast("double"), F.lit(1.0)), F.lit(float(exponent)))
    return (items.select("item_id", "rating_number", (-F.log(u) / w).alias("key"))
            .orderBy("key", "item_id").limit(n))
