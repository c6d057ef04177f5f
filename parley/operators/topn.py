"""Best items of many queries without walking whole posting lists.

Every list is cut into levels of falling impact: an entry's level says how far its score is below the list's best one, so
no list is sorted or numbered. Per query, list maxima and level counts give

  * a floor: some list alone holds n entries of at least that score, so the n-th best total is no lower;
  * the lists to skip: those whose maxima together stay below the floor can only add to items found elsewhere;
  * how deep to read each other list: an entry counts only if the other maxima can lift it to the floor.

Items found that way have all their scores from the lists that were read; the skipped lists are looked up for those items
that can still reach the floor. What is dropped at any step has a proof that it is not among the first n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.plans import scale
from parley.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class ImpactLists:
    entries: DataFrame   # phrase, level, item_id, s
    levels: DataFrame    # phrase, peak (best score), level, entries, low (least score of the level)


def level_of(score: Column, peak: Column, cfg: Settings = DEFAULTS) -> Column:
    """0 for the best scores of a list; `impact_steps` levels per halving, the last level holds all the rest."""
    steps = F.floor(F.log2(peak / score) * cfg.impact_steps).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(cfg.impact_levels - 1), steps))


def impact_lists(scored: DataFrame, cfg: Settings = DEFAULTS) -> ImpactLists:
    """Lists of (phrase, item_id, s) entries with s > 0, by level. A long list is parted by its levels and never sorted."""
    rows = scored.filter("s > 0").select("phrase", "item_id", "s")
    peaks = scale.keep(rows.groupBy("phrase").agg(F.max("s").alias("peak")))
    few = scale.broadcast_checked(peaks, cfg.broadcast_rows)
    entries = scale.keep(rows.join(few, "phrase").select("phrase", "item_id", "s", "peak", level_of(F.col("s"), F.col("peak"), cfg).alias("level")))
    levels = entries.groupBy("phrase", "peak", "level").agg(F.count("*").alias("entries"), F.min("s").alias("low"))
    return ImpactLists(entries.drop("peak"), scale.keep(levels))


def _plan(lists: ImpactLists, asked: DataFrame, cfg: Settings) -> DataFrame:
    """Per query and phrase: floor, peak, whether its list is read, least score worth reading, maxima of the skipped lists."""
    upto = Window.partitionBy("phrase").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # at most `impact_levels` rows
    ladder = lists.levels.withColumn("upto", F.sum("entries").over(upto))
    ladder = ladder.groupBy("phrase", "peak").agg(F.sort_array(F.collect_list(F.struct("level", "upto", "low"))).alias("ladder"))
    rows = asked.join(ladder, "phrase")
    full = F.filter("ladder", lambda x: x["upto"] >= F.col("n"))
    rows = rows.withColumn("alone", F.coalesce(F.get(full, F.lit(0))["low"], F.lit(0.0))).drop("ladder")
    query = Window.partitionBy("query_id")
    rising = query.orderBy("peak", "phrase").rowsBetween(Window.unboundedPreceding, 0)
    margin = 2 * 10.0 ** -cfg.score_digits  # totals that round alike must all be seen
    rows = rows.withColumn("floor", F.max("alone").over(query) - margin).withColumn("below", F.sum("peak").over(rising))
    rows = rows.withColumn("read", F.col("below") >= F.col("floor")).withColumn("all", F.sum("peak").over(query))
    skipped = F.sum(F.when(~F.col("read"), F.col("peak")).otherwise(0.0)).over(query)
    return rows.select("query_id", "phrase", "n", "floor", "peak", "read", (F.col("floor") - (F.col("all") - F.col("peak"))).alias("least"),
                       skipped.alias("skipped"))


def candidates(lists: ImpactLists, plan: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(query_id, item_id, raw, n, floor, skipped): items whose total can reach their query's floor, with what was read of it."""
    deepest = F.when(F.col("least") > 0, level_of(F.col("least"), F.col("peak"), cfg)).otherwise(cfg.impact_levels - 1)
    wanted = plan.filter(F.col("read") & (F.col("least") <= F.col("peak"))).select(
        "query_id", "phrase", "n", "floor", "skipped", "least", F.explode(F.sequence(F.lit(0), deepest)).alias("level"))
    found = (wanted.join(lists.entries, ["phrase", "level"]).filter(F.col("s") >= F.col("least"))
             .groupBy("query_id", "item_id", "n", "floor", "skipped").agg(F.sum("s").alias("raw")))
    return found.filter(F.col("raw") + F.col("skipped") >= F.col("floor"))


def bounded_search(lists: ImpactLists, queries: DataFrame, n: int | Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """First n items of every query (query_id, phrase) by summed score, with place `rk`; n may be a column of `queries`.

    Equals scoring all entries of all phrases: totals are rounded, then ties go to the lesser item.
    """
    n = F.lit(n) if isinstance(n, int) else n
    asked = scale.keep(queries.select("query_id", "phrase", n.cast("bigint").alias("n")).distinct())
    most = asked.agg(F.max("n")).first()[0] or 1
    scale.allow_limit(asked.sparkSession, most)
    plan = scale.keep(_plan(lists, asked, cfg))
    found = scale.keep(candidates(lists, plan, cfg))
    # what was read of the n-th best item raises the floor for those still to be looked up
    by_raw = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc("item_id"))
    head = found.withColumn("_r", F.row_number().over(by_raw)).filter((F.col("_r") <= F.col("n")) & (F.col("_r") <= most))
    raised = head.filter(F.col("_r") == F.col("n")).select("query_id", (F.col("raw") - 2 * 10.0 ** -cfg.score_digits).alias("higher"))
    able = found.join(raised, "query_id", "left").filter(F.col("raw") + F.col("skipped") >= F.coalesce("higher", "floor"))
    able = scale.keep(able.select("query_id", "item_id", "n", "raw"))
    lookup = able.select("query_id", "item_id").join(plan.filter("not read").select("query_id", "phrase"), "query_id")
    more = (lookup.join(lists.entries.select("phrase", "item_id", "s"), ["phrase", "item_id"])
            .select("query_id", "item_id", F.lit(None).cast("bigint").alias("n"), F.col("s").alias("raw")))
    total = able.unionByName(more).groupBy("query_id", "item_id").agg(F.max("n").alias("n"), F.sum("raw").alias("raw"))
    rows = total.select("query_id", "item_id", "n", F.round("raw", cfg.score_digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return (rows.withColumn("rk", F.row_number().over(order)).filter((F.col("rk") <= F.col("n")) & (F.col("rk") <= most))
            .drop("n"))
