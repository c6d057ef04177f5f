"""Stored positional index of the catalogue.

Three tables, written once and kept by bucket, so that reading them moves only the phrases asked for:

  terms   term -> places, items holding it, parts its places are dealt to        bucketed by term
  places  (term, part) -> item, place in it, neighbours, tokens left and right   bucketed by term and part
  fields  item -> token list of every field, popularity                          bucketed by item

A phrase is looked for at the places of its rarest token. The neighbours stored with a place settle phrases of two tokens,
and of three around their middle one; of longer phrases only places with fitting neighbours are compared with the item's
tokens. Phrases with a token the catalogue lacks cost nothing. `open_index` reads an index again in another session.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.operators import catalogue as cat
from parley.plans import scale
from parley.settings import DEFAULTS, Settings

KEYS = {"terms": ["term"], "places": ["term", "part"], "fields": ["item_id"]}


@dataclass(frozen=True)
class PhraseIndex:
    terms: DataFrame
    places: DataFrame
    fields: DataFrame
    stats: DataFrame   # n_items, mean_len, max_pop and a mean length per field: one row
    folder: str

    def document_frequency(self, phrases: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
        """(phrase, n, df) of every distinct phrase, df capped: as `phrases.document_frequency` over the catalogue.

        A single token's frequency is stored. Of other phrases each task passes on at most cap + 1 items, those whose hashes
        are least: together they are the least of all tasks, so the count is exact up to the cap and bounded beyond it.
        """
        table = scale.keep(_phrases(phrases))
        asked = _anchors(table, self.terms)
        alone = asked.filter("n = 1").select("phrase", F.col("items").alias("found"))
        rows = self._found(scale.keep(asked.filter("n > 1"))).filter("inside").select("phrase", "item_id")
        scale.allow_limit(rows.sparkSession, cfg.df_cap + 1)
        order = Window.partitionBy("phrase").orderBy(F.xxhash64("item_id"), "item_id")
        least = rows.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= cfg.df_cap + 1)
        several = least.groupBy("phrase").agg(F.max("_r").cast("bigint").alias("found"))
        return table.join(alone.unionByName(several), "phrase", "left").select(
            "phrase", "n", F.least(F.coalesce("found", F.lit(0)), F.lit(cfg.df_cap + 1)).cast("bigint").alias("df"))

    def hits(self, phrases: DataFrame) -> DataFrame:
        """(phrase, item, freq, len, pop): weighted in-field count; 0 when only the whole item's tokens span it."""
        rows = self._found(scale.keep(_anchors(_phrases(phrases), self.terms)))
        return rows.groupBy("phrase", "item_id", "len", "pop").agg(
            F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("freq"))

    def _found(self, asked: DataFrame) -> DataFrame:
        """Every place of every phrase: phrase, item_id, weight, len, pop, inside (one field holds it)."""
        wanted = asked.select("phrase", "n", "term", "at", "prior", "next",
                              F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        start = F.col("place") - F.col("at")
        fits = ((start >= 1) & (start + F.col("n") - 1 <= F.col("len"))
                & ((F.col("at") == 0) | (F.col("before") == F.col("prior")))
                & ((F.col("at") == F.col("n") - 1) | (F.col("after") == F.col("next"))))
        seen = F.lit(1) + (F.col("at") > 0).cast("int") + (F.col("at") < F.col("n") - 1).cast("int")
        rows = self.places.join(wanted, ["term", "part"]).filter(fits).select(
            "phrase", "n", "item_id", start.alias("start"), "weight", "len", "pop", (seen == F.col("n")).alias("sure"),
            ((F.col("left") >= F.col("at")) & (F.col("right") >= F.col("n") - 1 - F.col("at"))).alias("inside"))
        if asked.filter("n > 2").isEmpty():
            return rows.select("phrase", "item_id", "weight", "len", "pop", "inside")
        toks = self.fields.select("item_id", cat.all_tokens().alias("toks"))
        same = F.array_join(F.slice("toks", F.col("start"), F.col("n")), " ") == F.col("phrase")
        checked = rows.filter("not sure").join(toks, "item_id").filter(same).drop("toks")
        return rows.filter("sure").unionByName(checked).select("phrase", "item_id", "weight", "len", "pop", "inside")


def _phrases(phrases: DataFrame) -> DataFrame:
    """Distinct non-empty phrases and their number of tokens."""
    return (phrases.select("phrase").filter(F.col("phrase") != "").distinct()
            .withColumn("n", F.size(F.split("phrase", " "))))


def _anchors(table: DataFrame, terms: DataFrame) -> DataFrame:
    """Phrases whose tokens all occur, with the rarest one (`term`, at `at` from 0) and its neighbours in the phrase."""
    words = table.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    rarest = words.join(terms, "term").groupBy("phrase", "n").agg(
        F.count("*").alias("known"), F.min(F.struct("places", "at", "term", "items", "parts")).alias("a"))
    split = F.split("phrase", " ")
    return rarest.filter("known = n").select(
        "phrase", "n", "a.term", "a.at", "a.items", "a.parts",
        F.when(F.col("a.at") > 0, F.get(split, F.col("a.at") - 1)).alias("prior"),
        F.get(split, F.col("a.at") + 1).alias("next"))


def _field_places(blob: Column, size: Column, offset: Column, weight: float) -> Column:
    """One struct per token of a field; null for an empty field."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.struct(
        F.get(blob, offset + i - 1).alias("term"), (offset + i).alias("place"), (i - 1).alias("left"), (size - i).alias("right"),
        F.lit(weight).alias("weight"), F.get(blob, offset + i - 2).alias("before"), F.get(blob, offset + i).alias("after"))))


def _places(indexed: DataFrame) -> DataFrame:
    """Every token of every item: term, item_id, place in the item (from 1), tokens left and right of it in its field,
    field weight, neighbours, length and popularity of the item."""
    rows = indexed.withColumn("_all", cat.all_tokens()).withColumn("len", F.size("_all")).filter("len > 0")
    parts, offset = [], F.lit(0)
    for f in fixed.INDEX_FIELDS:
        parts.append(_field_places(F.col("_all"), F.size(f), offset, fixed.FIELD_WEIGHTS[f]))
        offset = offset + F.size(f)
    empty = F.expr("cast(array() as array<struct<term:string,place:int,left:int,right:int,weight:double,before:string,after:string>>)")
    return rows.select("item_id", "len", "pop", F.inline(F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _register(spark: SparkSession, folder: str, name: str, ddl: str, buckets: int) -> DataFrame:
    """A session table over stored files, known to be bucketed."""
    table, keys = f"parley_{name}_{uuid.uuid4().hex}", ", ".join(KEYS[name])
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS "
              f"LOCATION '{folder}/{name}'")
    return spark.table(table)


def _store(df: DataFrame, folder: str, name: str, buckets: int) -> DataFrame:
    """Write a table in buckets, one file each, and read it as such."""
    keys, table = KEYS[name], f"parley_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", f"{folder}/{name}").saveAsTable(table))
    return df.sparkSession.table(table)


def build_index(indexed: DataFrame, folder: str | None = None, buckets: int | None = None, cfg: Settings = DEFAULTS) -> PhraseIndex:
    """Index `catalogue.index_fields` rows. A term of many places is dealt to parts by item, so none fills one bucket."""
    spark = indexed.sparkSession
    folder = folder or f"{scale.work_folder(spark)}/index-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = _store(indexed, folder, "fields", buckets)
    places = _places(fields)
    counted = places.groupBy("term").agg(F.count("*").alias("places"), F.count_distinct("item_id").alias("items"))
    terms = _store(counted.withColumn("parts", (F.col("places") / cfg.part_places).cast("int") + 1), folder, "terms", buckets)
    dealt = places.join(terms.filter("parts > 1").select("term", "parts"), "term", "left")
    part = F.pmod(F.xxhash64("item_id"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = _store(dealt.withColumn("part", part).drop("parts"), folder, "places", buckets)
    stats = cat.corpus_stats(fields)
    stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/stats")
    return PhraseIndex(terms, placed, fields, spark.read.parquet(f"{folder}/stats"), folder)


def open_index(spark: SparkSession, folder: str) -> PhraseIndex:
    """An index that `build_index` wrote to a folder."""
    stats = spark.read.parquet(f"{folder}/stats")
    buckets = stats.first()["buckets"]
    told = {name: _register(spark, folder, name, _ddl(spark.read.parquet(f"{folder}/{name}")), buckets) for name in KEYS}
    return PhraseIndex(told["terms"], told["places"], told["fields"], stats, folder)


def fields_of(indexed: DataFrame | PhraseIndex) -> DataFrame:
    """Token lists per item, of a stored index or as they are."""
    return indexed.fields if isinstance(indexed, PhraseIndex) else indexed
