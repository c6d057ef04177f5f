"""Catalogue-grounded mining of messages and exact span lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import phrases as ph
from parley.operators.index import PhraseIndex
from parley.plans import scale
from parley.settings import DEFAULTS, Settings

HIT = "struct<start:int,n:int,phrase:string,df:bigint>"


def _greedy(hits: Column) -> Column:
    """Left-to-right pick of non-overlapping hits from a list sorted by start."""
    zero = F.expr(f"named_struct('free', 1, 'out', cast(array() as array<{HIT}>))")
    return F.aggregate(
        hits, zero,
        lambda acc, h: F.when(h["start"] >= acc["free"], F.struct(
            (h["start"] + h["n"]).alias("free"),
            F.concat(acc["out"], F.array(h)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"])


def mine(messages: DataFrame, indexed: DataFrame | PhraseIndex, cfg: Settings = DEFAULTS) -> DataFrame:
    """(text_id, user_message, picks): greedy longest-match segmentation of every distinct message text.

    At each position the longest n-gram with 0 < df <= cap is taken and its tokens are consumed. Repeated texts are mined
    once. Grams carry the text's digest, not the text. A hit that starts where no earlier one reaches opens a new block;
    blocks are independent, so the fold sees only hits that overlap in a chain. Over texts that are not indexed, only grams whose
    first tokens stand in some item are made.
    """
    texts = scale.keep(messages.select(F.coalesce("user_message", F.lit("")).alias("user_message")).distinct()
                       .withColumn("text_id", tx.digest(F.col("user_message"))))
    size = min(cfg.mine_min, cfg.head_tokens)
    heads = None if isinstance(indexed, PhraseIndex) else ph.met_heads(texts, indexed, size)
    grams = ph.message_grams(texts, "text_id", cfg.mine_min, cfg.mine_max, heads, size)
    freq = ph.document_frequency(indexed, grams, cfg.mine_min, cfg)
    usable = scale.keep(freq.filter(F.col("df").between(1, cfg.df_cap)))
    longest = (grams.join(scale.broadcast_checked(usable.select("phrase", "df"), cfg.broadcast_rows), "phrase")
               .groupBy("text_id", "start").agg(F.max(F.struct("n", "phrase", "df")).alias("h")))
    own = Window.partitionBy("text_id").orderBy("start")
    reach = F.max(F.col("start") + F.col("h.n")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    blocks = (longest.withColumn("opens", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
              .withColumn("block", F.sum("opens").over(own)))
    hits = blocks.groupBy("text_id", "block").agg(F.sort_array(F.collect_list(
        F.struct("start", F.col("h.n").alias("n"), F.col("h.phrase").alias("phrase"),
                 F.col("h.df").alias("df")).cast(HIT))).alias("hits"))
    picks = hits.select("text_id", F.inline(_greedy(F.col("hits")))).groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "phrase", "df"))).alias("picks"))
    return texts.join(picks, "text_id")


def mined_rows(mined: DataFrame, key: str = "user_message") -> DataFrame:
    return mined.select(key, F.posexplode("picks").alias("i", "p")).select(
        key, "i", "p.start", "p.n", "p.phrase", "p.df")


def span_category(texts: DataFrame, key: str, categories: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Longest category phrase per token list (ties: smallest phrase, then first place) and the rest.

    `texts` holds (key, toks). Result: key, category, at, width, rest; category is null when absent.
    Windows are as wide as the longest category.
    """
    table = scale.keep(ph.phrase_table(categories, cfg))
    max_n = ph.longest(table)
    win = ph.text_windows(texts, "toks", [key], max_n)
    found = ph.only(ph.occurrences(win, table, ph.head_sizes(cfg.category_min_tokens, max_n, cfg), cfg),
                    table, cfg)
    best = found.groupBy(key).agg(F.min(F.struct(
        (-F.col("n")).alias("neg"), F.col("phrase"), F.col("start"))).alias("b"))
    width = -F.col("b.neg")
    rest = F.when(F.col("b").isNull(), F.col("toks")).otherwise(F.concat(
        F.slice("toks", 1, F.col("b.start") - 1),
        F.slice("toks", F.col("b.start") + width, F.greatest(F.size("toks"), F.lit(1)))))
    return texts.join(best, key, "left").select(
        key, F.col("b.phrase").alias("category"), F.col("b.start").alias("at"), width.alias("width"),
        rest.alias("rest"))


def span_attributes(texts: DataFrame, key: str, attributes: DataFrame,
                    cfg: Settings = DEFAULTS) -> DataFrame:
    """(key, phrase, start, n): distinct short dictionary values in `toks`, at their first place."""
    table = scale.keep(ph.phrase_table(attributes, cfg))
    win = ph.text_windows(texts, "toks", [key], cfg.attribute_tokens)
    found = ph.only(ph.occurrences(win, table, ph.head_sizes(1, cfg.attribute_tokens, cfg), cfg), table, cfg)
    return found.groupBy(key, "phrase", "n").agg(F.min("start").alias("start"))


def span_stats(categories: DataFrame, attributes: DataFrame, category_hits: DataFrame,
               attribute_hits: DataFrame) -> DataFrame:
    """One row: vocabulary sizes and hit counts of the two lookups."""
    parts = [("categories", categories), ("attributes", attributes),
             ("category_hits", category_hits.filter("category is not null")),
             ("attribute_hits", attribute_hits)]
    rows = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stat"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows
