"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words; a target stops at three times
its source's words and the excess is shared again by weight. The mix is cut into blocks of BLOCK words. Blocks go to
the sources, and within a source to its shards, by the highest quotients target / (2k + 1), so every quota is a whole
number. In a shard the documents are laid in an order hashed from seed, id and text; from a seeded block on, round and
round, the quota takes blocks, so a document is taken up to three times and at most two documents of a shard are cut.
A source has a shard for every SHARD_WORDS words and every SHARD_ROWS rows.

Null texts have no words; null sources are a source of their own; null ids hash like empty ones, and their rows are told
apart by text; repeated rows are laid one after another, in one shard. Empty texts are taken zero times and laid
nowhere. An empty table gives an empty result. Extra columns are not read by `mix`; `mixed_texts` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import id_key, keep, text_of

BLOCK, SHARD_WORDS, SHARD_ROWS, MOST, SEED = 32, 1 << 22, 1 << 13, 3, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def hashed(seed: str, text: Column) -> Column:
    """60 bits of an MD5, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), text).cast("binary")), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def print_of(text: Column) -> Column:
    """64 bits of a text's MD5, in hex."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def targets(sizes: DataFrame) -> DataFrame:
    """Sources (source, source_size) -> with weight and target; one small row a source.

    Sources fill in the order of their cap per weight: the first that the common level leaves below its cap ends the
    filling, and the level holds for it and all later ones.
    """
    everything = Window.partitionBy()
    order = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    table = (sizes.withColumn("weight", ((order - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST)
             .withColumn("total", F.sum("source_size").over(everything)))
    filling = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    table = (table.withColumn("_full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_left", F.sum("weight").over(after))
             .withColumn("_level", (F.col("total") - F.col("_full")).cast("double") / F.col("_left")))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))
    level = F.max(fits).over(everything)
    return (table.withColumn("_common", level)
            .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_common") * F.col("weight"), F.col("cap").cast("double"))))
            .select(*sizes.columns, "weight", "target", "total"))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë seats per party: the `seats` highest quotients votes / (2k + 1) of a group, ties by key.

    The seats of a party differ from its rounded share by less than its part of the number of parties, so only
    quotients within that distance are ranked; what lies below is certain.
    """
    own = Window.partitionBy(*group)
    share = F.when(F.sum(votes).over(own) > 0, F.col(votes) / F.sum(votes).over(own)).otherwise(F.lit(0.0))
    near = (parties.withColumn("_share", share).withColumn("_n", F.count(F.lit(1)).over(own))
            .withColumn("_r", (F.ceil(F.col("_share") * F.col("_n")) + 2).cast("long"))
            .withColumn("_base", F.greatest(F.lit(0), F.round(F.col("_share") * F.col(seats)).cast("long") - F.col("_r")))
            .withColumn("_open", F.col(seats) - F.sum("_base").over(own)))
    ranked = (near.where(F.col(votes) > 0).select(*group, key, votes, "_base", "_open", F.explode(F.sequence("_base", F.col("_base") + 2 * F.col("_r"))).alias("_k"))
              .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
              .withColumn("_rank", F.row_number().over(own.orderBy(F.col("_q").desc(), key, "_k"))).where("_rank <= _open"))
    names = [*group, key]
    won = ranked.groupBy(*names).agg(F.count(F.lit(1)).alias("_won")).select(*[F.col(c).alias(f"_own_{c}") for c in names], "_won")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    quota = (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")
    return near.join(won, same, "left").select(*parties.columns, quota)


def laid(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, source, size, print, and any others) -> with source_size, target and taken; the latter is `times` times the
    document, its first `head_to` words, and its words from `run_from` to `run_to`."""
    cells = Window.partitionBy("source", "shard")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goal = targets(sizes).withColumn("_seats", F.round(F.col("total") / block).cast("long")).withColumn("_all", F.lit(0)).withColumn("_place", F.row_number().over(Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    quotas = keep(apportion(goal, ["_all"], "_place", "target", "_seats").withColumnRenamed("quota", "source_quota").drop("_all", "_seats"), "source-quotas")
    told = quotas.select(F.col("source").alias("_s"), "source_size", "source_rows", "target", "source_quota")
    text = F.concat(id_key(), F.lit("|"), F.col("print"))
    several = (F.floor(F.col("source_size") / SHARD_WORDS) + F.floor(F.col("source_rows") / SHARD_ROWS) + 1).cast("long")
    rows = (docs.join(told, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
            .withColumn("_hash", hashed(SEED, text)).withColumn("shard", F.pmod(hashed(SEED + "/shard", text), several)))
    filled, empty = rows.where("size > 0"), rows.where("size = 0")
    shards = filled.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("_words"))
    per = (apportion(shards, ["source"], "shard", "_words", "source_quota")
           .withColumn("_blocks", F.ceil(F.col("_words") / block).cast("long")).withColumn("_quota", F.least("quota", F.col("_blocks") * MOST))
           .withColumn("_full", F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / F.col("_blocks"))).otherwise(0).cast("long"))
           .withColumn("_rest", (F.col("_quota") - F.col("_full") * F.col("_blocks")).cast("long"))
           .withColumn("_first", F.when(F.col("_blocks") > 0, F.pmod(hashed(SEED + "/first", F.concat(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), F.lit("|"), F.col("shard").cast("string"))), F.col("_blocks"))).otherwise(0).cast("long"))
           .select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "_words", "_blocks", "_full", "_rest", "_first"))
    order = cells.orderBy("_hash", "doc_id", "size")
    lines = (filled.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left"))
    # the chosen blocks are one run on the circle, [first, first + rest), which may wrap once
    last, low = F.col("_first") + F.col("_rest"), F.col("_end") - F.col("size")
    inside = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), at * block - low)).cast("long")
    found = (lines.withColumn("times", F.col("_full").cast("int"))
            .withColumn("head_to", inside(F.greatest(F.lit(0), last - F.col("_blocks"))))
            .withColumn("run_from", inside(F.col("_first"))).withColumn("run_to", inside(F.least(last, F.col("_blocks"))))
            .withColumn("taken", (F.col("times") * F.col("size") + F.col("head_to") + F.col("run_to") - F.col("run_from")).cast("long"))
            .drop("_s", "_h", "_words", "_blocks", "_full", "_rest", "_first", "_end", *(own := ("_hash", "shard", "source_quota", "source_rows"))))
    nothing = {"times": F.lit(0), **{c: F.lit(0).cast("long") for c in ("head_to", "run_from", "run_to", "taken")}}
    return found.unionByName(empty.withColumns(nothing).drop(*own))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of `docs` (doc_id, text, source)."""
    narrow = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              print_of(text_of("text")).alias("print"), words(text_of("text")).alias("size")), "sizes")
    return laid(narrow).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of `docs`: whole documents as often as they are taken whole, and cut ones.

    A cut text is its words joined by blanks. Rows equal in id, source and text are taken alike. n_chars follows the text.
    """
    key = ["doc_id", "_source", "print"]
    told = docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("_print", print_of(text_of("text")))
    narrow = keep(told.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "_source", F.col("_print").alias("print"), words(text_of("text")).alias("size")), "sizes")
    share = (laid(narrow).groupBy(*key).agg(*[F.max(c).alias(f"_{c}") for c in ("times", "head_to", "run_from", "run_to", "taken")])
             .where("_taken > 0"))
    share = share.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_times", "_head_to", "_run_from", "_run_to")
    same = told["doc_id"].cast("long").eqNullSafe(F.col("_k0")) & (F.col("_source") == F.col("_k1")) & (F.col("_print") == F.col("_k2"))
    found = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    cut = lambda a, b: F.when(F.col(b) > F.col(a), F.when((F.col(a) == 0) & (F.col(b) == F.size(found)), F.col("text")).otherwise(F.array_join(F.slice(found, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), " ")))
    parts = F.filter(F.array(cut("_zero", "_head_to"), cut("_run_from", "_run_to")), lambda t: t.isNotNull())
    whole = told.join(share, same).withColumn("_zero", F.lit(0)).withColumn("_out", F.explode(F.concat(F.array_repeat("text", F.col("_times")), parts)))
    columns = [F.col("_out").alias(c) if c == "text" else F.length("_out").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return whole.select(*columns)
