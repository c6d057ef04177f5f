"""Catalogue enrichment: disclosable values, cards, vocabularies, index fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx
from parley.plans import scale
from parley.settings import DEFAULTS, Settings


def field_entries(items: DataFrame, name: str) -> Column:
    return tx.entries(F.col(name), items.schema[name].dataType)


def field_text(items: DataFrame, name: str) -> Column:
    return tx.flatten_text(field_entries(items, name))


def searchable_text(items: DataFrame) -> Column:
    """All text of an item in searchable-text order; absent fields leave no gap."""
    parts = F.array(*[field_text(items, f) for f in fixed.SEARCH_FIELDS])
    return F.btrim(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def catalogue_ids(items: DataFrame) -> DataFrame:
    """Id and category list of every item."""
    return items.select("item_id", F.transform(
        field_entries(items, "categories"), lambda e: e["value"]).alias("categories"))


def disclosable_values(items: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per item: cleaned title, the two hard values, the two soft values and their ordered union."""
    base = F.concat(tx.flatten_values(field_entries(items, "features")),
                    tx.flatten_values(field_entries(items, "details")))
    price = F.nullif(F.col("price").cast("string"), F.lit(""))
    title = tx.clean_value(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("product")), cfg.value_chars)
    null = F.lit(None).cast("string")

    def cards(listed):
        hard = F.slice(listed, 1, cfg.hard_values)
        soft = F.slice(listed, cfg.hard_values + 1, cfg.soft_values)
        return F.struct(hard.alias("hard"), F.when(F.size(soft) > 0, soft).otherwise(
            F.slice(listed, 1, 1)).alias("soft"))

    def ordered(words_):
        # absent parts are inserted as nulls, which the cleaning below drops
        listed = F.when(words_["material"].isNotNull(), F.concat(F.array(words_["material"]), base)).otherwise(base)
        listed = F.array_insert(listed, 2, F.concat(F.lit("color: "), words_["colour"]))
        listed = F.concat(listed, F.array(F.concat(F.lit("budget around $"), price)))
        clean = F.array_distinct(F.filter(
            F.transform(listed, lambda v: tx.clean_value(v, cfg.value_chars)),
            lambda v: v.isNotNull() & (v != "")))
        return tx.let(clean, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(title)))

    found = tx.let(searchable_text(items), lambda text: F.struct(
        F.coalesce(tx.first_word(text, fixed.MATERIALS), null).alias("material"),
        F.coalesce(tx.first_word(text, fixed.COLOURS), null).alias("colour")))
    card = tx.let(tx.let(found, ordered), cards)
    return items.select("item_id", title.alias("card_title"), card.alias("card")).select(
        "item_id", "card_title", "card.hard", "card.soft",
        F.array_distinct(F.concat("card.hard", "card.soft")).alias("vals"))


def intent_cards(items: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return disclosable_values(items, cfg).select(
        "item_id", F.col("card_title").alias("target_category"),
        F.col("hard").alias("hard_constraints"), F.col("soft").alias("soft_preferences"))


def fill_cards(sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """Keep a supplied card; otherwise take the one of the target item."""
    c = cards.select(F.col("item_id").alias("target"), *[
        F.col(n).alias(f"_{n}") for n in ("target_category", "hard_constraints", "soft_preferences")])
    supplied = F.col("target_category").isNotNull()
    return sessions.join(c, "target", "left").select(
        *[n for n in sessions.columns if n not in c.columns[1:] and n not in (
            "target_category", "hard_constraints", "soft_preferences")],
        *[F.when(supplied, F.col(n)).otherwise(F.col(f"_{n}")).alias(n)
          for n in ("target_category", "hard_constraints", "soft_preferences")])


def value_ids(values: DataFrame) -> DataFrame:
    """Dense id of every distinct disclosable value, in sorted order."""
    return scale.dense_ids(values.select(F.explode("vals").alias("value")), "value", "value_id")


def values_by_attribute(values: DataFrame) -> DataFrame:
    """(item, attribute) -> the item's values of that family, in order; the repeatable one takes all."""
    def of(tagged, attribute):
        kept = F.filter(tagged, lambda t: t["family"] == attribute)
        return F.transform(kept, lambda t: t["value"])

    tagged = F.transform("vals", lambda v: F.struct(v.alias("value"), tx.family(v).alias("family")))
    rows = tx.let(tagged, lambda t: F.array(*[F.struct(
        F.lit(a).alias("attribute"), (F.col("vals") if a == fixed.REPEATABLE else of(t, a)).alias("vals"))
        for a in fixed.QUESTION_ORDER]))
    return values.select("item_id", F.inline(rows)).filter(F.size("vals") > 0)


def category_vocabulary(items: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Distinct coarse-category phrases of at least two tokens."""
    cats = catalogue_ids(items).select(tx.coarse_category(F.col("categories")).alias("category")).distinct()
    toks = tx.tokens(F.col("category"))
    return cats.filter(F.size(toks) >= cfg.category_min_tokens).select(
        tx.phrase_of(toks).alias("phrase")).distinct()


def attribute_vocabulary(values: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Short disclosable values (one to three tokens) that are not facet names."""
    toks = tx.tokens(F.col("value"))
    return (values.select(F.explode("vals").alias("value")).select(toks.alias("toks"))
            .filter(F.size("toks").between(1, cfg.attribute_tokens))
            .select(tx.phrase_of(F.col("toks")).alias("phrase")).distinct()
            .filter(~F.col("phrase").isin(*fixed.FACET_NAMES)))


def index_fields(items: DataFrame) -> DataFrame:
    """Item, one token list per index field, popularity. The narrow input of every phrase operator."""
    return items.select(
        "item_id", *[tx.tokens(field_text(items, f)).alias(f) for f in fixed.INDEX_FIELDS],
        tx.popularity(F.col("rating_number")).alias("pop"))


def all_tokens() -> Column:
    return F.concat(*[F.col(f) for f in fixed.INDEX_FIELDS])


def blobs(indexed: DataFrame) -> DataFrame:
    """Padded token blob of the whole item and of its title."""
    return indexed.select("item_id", tx.padded(all_tokens()).alias("blob"),
                          tx.padded(F.col("title")).alias("title_blob"), "pop")


def _positions(toks: Column) -> Column:
    """(term, positions) of every distinct token of a list: sorted by term, cut where the term changes."""
    def cut(s):
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s), F.lit(1)) - 1),
                          lambda i: ~F.get(s, i)["term"].eqNullSafe(F.get(s, i - 1)["term"]))
        return tx.let(starts, lambda b: F.transform(b, lambda at, k: F.struct(
            F.get(s, at)["term"].alias("term"),
            F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at)["pos"].alias("positions"))))

    return tx.let(F.sort_array(F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))), cut)


def postings(indexed: DataFrame) -> DataFrame:
    """Fielded inverted index: (term, field, item) -> ordered positions.

    A row holds all tokens of its item, so its lists are made where it is read. Only items with several rows are shuffled.
    """
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("toks"))
                      for f in fixed.INDEX_FIELDS])

    def listed(rows):
        return (rows.select("item_id", F.inline(lists)).filter(F.size("toks") > 0)
                .select("item_id", "field", F.inline(_positions(F.col("toks")))).select("term", "field", "item_id", "positions"))

    several = scale.keep(indexed.groupBy("item_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("item_id").alias("_several")))
    if several.isEmpty():
        return listed(indexed)
    several, same = scale.broadcast_checked(several), F.col("item_id").eqNullSafe(F.col("_several"))
    merged = listed(indexed.join(several, same, "left_semi")).groupBy("term", "field", "item_id").agg(
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return listed(indexed.join(several, same, "left_anti")).unionByName(merged)


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """Item count, mean item length and mean length per field: one row."""
    return indexed.agg(
        F.count("*").alias("n_items"), F.avg(F.size(all_tokens())).alias("mean_len"),
        F.max("pop").alias("max_pop"),
        *[F.avg(F.size(f)).alias(f"mean_{f}") for f in fixed.INDEX_FIELDS])
