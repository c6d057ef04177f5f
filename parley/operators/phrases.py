"""Phrase analytics: where do given phrases occur in given texts, and in how many items.

One primitive serves document frequency, attestation, mining, span lookup and retrieval: every text
position becomes a window of at most `max_n` tokens, windows are matched on their head (the first
one to four tokens) against the heads of the wanted phrases, and only matching windows are expanded
to the lengths wanted for that head. Texts never shuffle before that filter unless the phrase set
is too large to broadcast. Given a stored index in place of the catalogue, document frequency and hits
are read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx
from parley.operators import catalogue as cat
from parley.operators.index import PhraseIndex
from parley.plans import scale
from parley.settings import DEFAULTS, Settings


def phrase_table(phrases: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Distinct non-empty phrases with token count and head."""
    n = F.size(F.split("phrase", " "))
    return (phrases.select("phrase").filter(F.col("phrase") != "").distinct()
            .withColumn("n", n)
            .withColumn("head", F.substring_index("phrase", " ", cfg.head_tokens)))


def longest(table: DataFrame) -> int:
    """Tokens of the longest phrase: windows of that width miss nothing."""
    return table.agg(F.max("n")).first()[0] or 1


def _spans(toks: Column, length: Column, max_n: int) -> Column:
    """One struct per token position: position, tokens left, window text."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(
        i.alias("start"), (length - i + 1).alias("room"),
        F.array_join(F.slice(toks, i, F.lit(max_n)), " ").alias("ctx")))


def _field_spans(blob: Column, size: Column, offset: Column, weight: float, max_n: int) -> Column:
    """Spans of one field whose window text is read from the whole item; null for an empty field."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.struct(
        F.lit(weight).alias("weight"), (offset + i).alias("start"), (size - i + 1).alias("room"),
        F.array_join(F.slice(blob, offset + i, F.lit(max_n)), " ").alias("ctx"))))


def text_windows(texts: DataFrame, toks: str, keys: list[str], max_n: int) -> DataFrame:
    """Windows over one token list per row."""
    return texts.filter(F.size(toks) > 0).select(
        *keys, F.inline(_spans(F.col(toks), F.size(toks), max_n)))


def item_windows(indexed: DataFrame, max_n: int, across_fields: bool = False) -> DataFrame:
    """Windows over item fields. `room` counts tokens left in the field; with `across_fields` the
    window text runs on into the next fields, as a whole-item blob does."""
    if not across_fields:
        fields = F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f).alias("toks"))
                           for f, w in fixed.FIELD_WEIGHTS.items()])
        rows = indexed.select("item_id", F.inline(fields)).filter(F.size("toks") > 0)
        return rows.select("item_id", "weight", F.inline(_spans(F.col("toks"), F.size("toks"), max_n)))
    blob, total = F.col("_all"), F.col("_len")
    rows = indexed.withColumn("_all", cat.all_tokens()).withColumn("_len", F.size("_all")).filter("_len > 0")
    parts, offset = [], F.lit(0)
    for f in fixed.INDEX_FIELDS:
        parts.append(_field_spans(blob, F.size(f), offset, fixed.FIELD_WEIGHTS[f], max_n))
        offset = offset + F.size(f)
    empty = F.expr("cast(array() as array<struct<weight:double,start:int,room:int,ctx:string>>)")
    return rows.select("item_id", total.alias("len"), "pop", F.inline(
        F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))))


def occurrences(windows: DataFrame, table: DataFrame, sizes: tuple[int, ...],
                cfg: Settings = DEFAULTS) -> DataFrame:
    """Every window prefix whose head and length occur in the phrase table.

    The result may hold phrases outside the table (same head and length, other tail); callers
    aggregate first and then join on the exact phrase. `sizes` are the head sizes present.
    """
    heads = table.groupBy("head").agg(F.collect_set("n").alias("lens"))
    few = scale.fits_broadcast(heads, cfg.broadcast_rows)
    have = F.size(F.split("ctx", " "))
    if len(sizes) == 1:
        w = windows.withColumn("head", F.substring_index("ctx", " ", sizes[0]))
    else:
        w = windows.withColumn("head", F.explode(F.array_distinct(F.array(
            *[F.substring_index("ctx", " ", s) for s in sizes]))))
    if not few:  # the windows are shuffled: most that no phrase begins go before
        w = scale.maybe_in(w.withColumn("h", F.xxhash64("head")), "h", heads.select(F.xxhash64("head").alias("h"))).drop("h")
    hit = w.join(F.broadcast(heads) if few else heads, "head").withColumn("n", F.explode("lens")).filter(F.col("n") <= have)
    # a head shorter than the maximum stands only for the phrase of exactly that length
    hit = hit.filter((F.size(F.split("head", " ")) == F.least(F.col("n"), F.lit(cfg.head_tokens))))
    return hit.withColumn("phrase", tx.first_tokens(F.col("ctx"), F.col("n"))).drop(
        "head", "lens", "ctx")


def head_sizes(min_n: int, max_n: int, cfg: Settings = DEFAULTS) -> tuple[int, ...]:
    return tuple(range(min(min_n, cfg.head_tokens), min(max_n, cfg.head_tokens) + 1))


def only(rows: DataFrame, table: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Exact check: keep rows whose phrase is in the table."""
    return rows.join(scale.broadcast_checked(table.select("phrase"), cfg.broadcast_rows),
                     "phrase", "left_semi")


def document_frequency(indexed: DataFrame | PhraseIndex, phrases: DataFrame, min_n: int = 1, cfg: Settings = DEFAULTS) -> DataFrame:
    """(phrase, n, df) for every distinct phrase; df counts items holding it inside one field, capped.

    Phrases may be of any length: windows are as wide as the longest of them.

    An item contributes a phrase once: duplicates collapse inside the task that read the item, so the
    count shuffles one partial row per phrase and task, however common the phrase is.
    """
    if isinstance(indexed, PhraseIndex):
        return indexed.document_frequency(phrases, cfg)
    table = scale.keep(phrase_table(phrases, cfg))
    max_n = longest(table)
    found = (occurrences(item_windows(indexed, max_n), table, head_sizes(min_n, max_n, cfg), cfg)
             .filter(F.col("n") <= F.col("room")))
    counts = (only(found, table, cfg).select("phrase", "item_id").distinct()
              .groupBy("phrase").agg(F.count("*").alias("found")))
    return table.join(counts, "phrase", "left").select(
        "phrase", "n", F.least(F.coalesce("found", F.lit(0)), F.lit(cfg.df_cap + 1)).cast("bigint").alias("df"))


def phrase_hits(indexed: DataFrame | PhraseIndex, phrases: DataFrame, min_n: int = 1, cfg: Settings = DEFAULTS) -> DataFrame:
    """(phrase, item, freq, len, pop): weighted in-field count; 0 when only the blob spans it."""
    if isinstance(indexed, PhraseIndex):
        return indexed.hits(phrases)
    table = scale.keep(phrase_table(phrases, cfg))
    max_n = longest(table)
    found = occurrences(item_windows(indexed, max_n, across_fields=True), table,
                        head_sizes(min_n, max_n, cfg), cfg)
    per_item = found.groupBy("phrase", "item_id", "len", "pop").agg(
        F.sum(F.when(F.col("n") <= F.col("room"), F.col("weight")).otherwise(0.0)).alias("freq"))
    return only(per_item, table, cfg)


def _head_hashes(toks: Column, size: int) -> Column:
    """Distinct hashes of the runs of `size` tokens of a list."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(toks) - size, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(toks, i + j) for j in range(size)]))
    return F.when(F.size(toks) >= size, F.array_distinct(runs))


def met_heads(messages: DataFrame, indexed: DataFrame, size: int) -> DataFrame:
    """Hashes `h` of the runs of `size` tokens that stand both in a message and in a field of an item.

    Only hashes travel, so a catalogue too large for a broadcast of the messages' runs moves 8 bytes a token, and those of runs
    that no message has are mostly dropped where they are read.
    """
    said = scale.keep(messages.select(F.explode(_head_hashes(tx.tokens(F.col("user_message")), size)).alias("h")).distinct())
    fields = indexed.select(F.explode(F.array(*fixed.FIELD_WEIGHTS)).alias("toks"))
    held = scale.maybe_in(fields.select(F.explode(_head_hashes(F.col("toks"), size)).alias("h")), "h", said)
    return scale.keep(held.join(scale.broadcast_checked(said), "h", "left_semi").distinct())


def message_grams(messages: DataFrame, key: str, min_n: int, max_n: int, heads: DataFrame | None = None, size: int = 0) -> DataFrame:
    """All token n-grams of every message with their start position; with `heads` those whose first `size` tokens are among them."""
    toks = messages.select(key, tx.tokens(F.col("user_message")).alias("toks"))
    w = text_windows(toks, "toks", [key], max_n).filter(F.col("room") >= min_n)
    if heads is not None:
        first = F.split("ctx", " ")
        w = w.withColumn("h", F.xxhash64(*[F.get(first, F.lit(j)) for j in range(size)])).join(scale.broadcast_checked(heads), "h", "left_semi")
    lengths = F.sequence(F.lit(min_n), F.least(F.col("room"), F.lit(max_n)))
    return w.withColumn("n", F.explode(lengths)).select(
        key, "start", "n", tx.first_tokens(F.col("ctx"), F.col("n")).alias("phrase"))


def proposal_phrase() -> Column:
    """The tokens of column `proposal`: punctuation and hyphens separate, as in the catalogue."""
    return tx.phrase_of(tx.tokens(F.col("proposal")))


def attest(candidates: DataFrame, freq: DataFrame) -> DataFrame:
    """Candidates whose phrase occurs in the catalogue."""
    return candidates.join(freq.filter("df > 0").select("phrase"), "phrase", "left_semi")


def admit(candidates: DataFrame, freq: DataFrame, proposals: DataFrame | None = None,
          cfg: Settings = DEFAULTS) -> DataFrame:
    """Admission of stated values: (…, phrase, tier, deparaphrase) -> attested rows.

    An attested phrase keeps its tier; else a verified proposal enters at tier `sem`; else the value
    is dropped. `proposals` holds (source_phrase, proposal); a proposal is attested by its tokens.
    """
    known = freq.filter("df > 0").select("phrase", "df")
    rows = candidates.join(known, "phrase", "left")
    if proposals is None:
        return rows.filter("df is not null").drop("deparaphrase")
    p = (proposals.select(F.col("source_phrase").alias("phrase"), proposal_phrase().alias("proposal"))
         .join(known.select(F.col("phrase").alias("proposal"), F.col("df").alias("p_df")), "proposal")
         .groupBy("phrase").agg(F.min_by(F.struct("proposal", "p_df"), "proposal").alias("p")))
    rows = rows.join(p, "phrase", "left")
    short = F.size(F.split("phrase", " ")) <= cfg.proposal_tokens
    use = F.col("df").isNull() & F.col("deparaphrase") & short & F.col("p").isNotNull()
    keep = [c for c in candidates.columns if c not in ("phrase", "tier", "deparaphrase")]
    return rows.filter(F.col("df").isNotNull() | use).select(
        *keep, F.when(use, F.col("p.proposal")).otherwise(F.col("phrase")).alias("phrase"),
        F.when(use, F.lit("sem")).otherwise(F.col("tier")).alias("tier"),
        F.when(use, F.col("p.p_df")).otherwise(F.col("df")).alias("df"))
