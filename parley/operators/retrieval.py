"""Candidate retrieval: fielded BM25 and the conjunctive, backoff, disjunctive rungs.

Inputs
  queries   (query_id, rnk, phrase, tier, df): evidence in rarity order, one query per distinct state
  hits      (phrase, item_id, freq, len, pop) from `phrases.phrase_hits`

Phrases at or below `strong_df` have short item lists, which the strong rungs join per query. The common phrases of a query
("broad" ones) may match a third of the catalogue, and most queries have a set of them of their own, so lists of common phrases
are never expanded to rows: `pools` adds a query's lists up where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import catalogue as cat
from parley.operators import pools, topn
from parley.operators.index import PhraseIndex
from parley.plans import scale
from parley.settings import DEFAULTS, Settings


def top(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rk") -> DataFrame:
    """First n rows per key with their rank; each task drops what cannot be among them before shuffling."""
    scale.allow_limit(df.sparkSession, n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def scored_hits(hits: DataFrame, indexed: DataFrame | PhraseIndex, cfg: Settings = DEFAULTS) -> DataFrame:
    """Adds the BM25 contribution `s` of every (phrase, item); 0 where the phrase only spans fields."""
    if isinstance(indexed, PhraseIndex):
        stats = indexed.stats.select(F.col("n_items").alias("n"), F.col("mean_len").alias("mean"))
    else:
        stats = indexed.agg(F.count("*").alias("n"), F.avg(F.size(cat.all_tokens())).alias("mean"))
    seen = hits.groupBy("phrase").agg(F.count_if(F.col("freq") > 0).alias("seen"))
    rows = hits.join(scale.broadcast_checked(seen, cfg.broadcast_rows), "phrase")
    n, mean = stats.select("n").scalar(), stats.select("mean").scalar()
    return rows.select("phrase", "item_id", "pop", "freq", bm25(
        F.col("freq"), F.col("len"), F.col("seen"), n, mean, cfg).alias("s"))


def bm25(freq: Column, length: Column, seen: Column, n: Column, mean: Column,
         cfg: Settings = DEFAULTS) -> Column:
    raw = F.log((n - seen + 0.5) / (seen + 0.5))
    idf = F.when(raw > 0, raw).otherwise(cfg.idf_floor)
    return F.when(freq > 0, idf * freq * (cfg.k1 + 1)
                  / (freq + cfg.k1 * (1 - cfg.b + cfg.b * length / mean))).otherwise(0.0)


def weight(phrase: Column, df: Column, tier: Column, cfg: Settings = DEFAULTS) -> Column:
    """Evidence weight: tier base, length factor for mined phrases, mild rarity discount."""
    length = F.least(F.lit(1.0), F.size(F.split(phrase, " ")) / F.lit(cfg.mined_length))
    base = (F.when(tier == "con", cfg.w_con).when(tier == "cat", cfg.w_cat)
            .when(tier == "sem", cfg.w_sem).otherwise(cfg.w_mined * length))
    return base / F.pow(1.0 + df, F.lit(cfg.df_power))


def bm25_search(scored: DataFrame, queries: DataFrame, n: int, cfg: Settings = DEFAULTS) -> DataFrame:
    """Top n items per query over any of its phrases."""
    return topn.bounded_search(topn.impact_lists(scored, cfg), queries, n, cfg)


def distinct_queries(evidence: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Equal evidence states are searched once: (keys -> query_id) and the queries themselves.

    `evidence` holds (keys, phrase, tier, df, rnk). Equality is that of the ordered evidence.
    """
    entry = F.struct("rnk", "phrase", "tier", "df")
    lists = evidence.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("ev"))
    text = F.array_join(F.transform("ev", lambda e: F.concat_ws("|", e["phrase"], e["tier"], e["df"])), ";")
    lists = scale.keep(lists.withColumn("digest", F.sha2(text, 256)))
    ids = scale.dense_ids(lists, "digest", "query_id")
    queries = (lists.groupBy("digest").agg(F.any_value("ev").alias("ev")).join(ids, "digest")
               .select("query_id", F.inline("ev")))
    return lists.join(ids, "digest").select(*keys, "query_id"), queries


def rank_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Rarity order of evidence, stable on insertion: rnk 1 is the rarest. Sessions are bounded."""
    w = Window.partitionBy(*keys).orderBy("df", "turn", "seq")
    return evidence.withColumn("rnk", F.row_number().over(w))


def roles(queries: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Marks strong phrases (conjunctive rungs) and broad ones (only in the last disjunction)."""
    strong = (F.col("df") <= cfg.strong_df) & (F.col("rnk") <= cfg.strong_phrases)
    return queries.withColumn("strong", strong).withColumn(
        "broad", (F.col("df") > cfg.strong_df) & (F.col("rnk") <= cfg.or_phrases)).withColumn(
        "w", weight(F.col("phrase"), F.col("df"), F.col("tier"), cfg))


def narrowed(marked: DataFrame, cfg: Settings = DEFAULTS) -> Settings:
    """Settings with `strong_phrases` lowered to the most any query really has: fewer score columns."""
    most = marked.filter("strong").agg(F.max("rnk")).first()[0]
    return replace(cfg, strong_phrases=max(1, min(cfg.strong_phrases, most or 1)))


def with_lists(rows: DataFrame, scored: DataFrame, key: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Rows (key, phrase, ...) with every entry of their phrase's list, all rows of a key in one task.

    Lists proven small go to the rows, which were dealt by key before: what they expand to stays where it is. Else the join
    shuffles by phrase and what it gives is dealt by key.
    """
    lists = scored.select("phrase", "item_id", "s", "pop")
    few = scale.broadcast_checked(lists, cfg.broadcast_bytes, cfg.broadcast_bytes)
    if few is lists:
        return rows.join(lists, "phrase").drop("phrase").repartition(key)
    return rows.repartition(4 * scale.slots(rows.sparkSession), key).join(few, "phrase").drop("phrase")


def strong_matches(marked: DataFrame, scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(query, item) with one score column per strong phrase rank, coverage and popularity.

    Rows with total 0 cover a strong phrase only across two fields: they count for coverage but match
    no search; `matched` drops them.
    """
    rows = with_lists(marked.filter("strong").select("query_id", "rnk", "phrase", "w"), scored, "query_id", cfg)
    sums = [F.sum(F.when(F.col("rnk") == i, F.col("s")).otherwise(0.0)).alias(f"s{i}")
            for i in range(1, cfg.strong_phrases + 1)]
    got = rows.groupBy("query_id", "item_id").agg(*sums, F.sum("w").alias("cov"), F.max("pop").alias("pop"))
    total = _plus(cfg.strong_phrases)
    return got.withColumn("prefix", _prefix(cfg)).withColumn("total", total)


def matched(matches: DataFrame) -> DataFrame:
    return matches.filter("total > 0")


def _plus(k: int) -> Column:
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.col(f"s{i}")
    return out


def _prefix(cfg: Settings) -> Column:
    """Longest k such that the k rarest strong phrases all match."""
    out = F.lit(cfg.strong_phrases)
    for i in range(cfg.strong_phrases, 0, -1):
        out = F.when(F.col(f"s{i}") <= 0, F.lit(i - 1)).otherwise(out)
    return out


def _score_at(k: Column, cfg: Settings) -> Column:
    """Sum of the first k strong scores."""
    out = F.lit(0.0)
    for i in range(1, cfg.strong_phrases + 1):
        out = out + F.when(k >= i, F.col(f"s{i}")).otherwise(0.0)
    return out


def backoff_stops(matches: DataFrame, marked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per query: number of strong phrases and the prefix length of the last rung that runs.

    The rung over the k rarest phrases holds exactly the items with prefix >= k, so the loop "drop the
    most common phrase until the pool is full" ends at the largest k with at least `pool` such items.
    """
    k = marked.filter("strong").groupBy("query_id").agg(F.max("rnk").alias("k"))
    at_least = [F.count_if(F.col("prefix") >= i).alias(f"c{i}") for i in range(1, cfg.strong_phrases + 1)]
    counts = matches.groupBy("query_id").agg(F.count("*").alias("n_strong"), *at_least)
    stop = F.lit(1)
    for i in range(1, cfg.strong_phrases + 1):
        stop = F.when(F.col(f"c{i}") >= cfg.pool, F.lit(i)).otherwise(stop)
    return k.join(counts, "query_id").select("query_id", "k", "n_strong", stop.alias("stop"))


def rung_and(matches: DataFrame, marked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Items holding all strong phrases of their query."""
    k = marked.filter("strong").groupBy("query_id").agg(F.max("rnk").alias("k"))
    rows = matches.join(k, "query_id").filter(F.col("prefix") == F.col("k")).select(
        "query_id", "item_id", F.round("total", cfg.score_digits).alias("score"))
    return top(rows, ["query_id"], [F.desc("score"), F.asc("item_id")], cfg.pool)


def rung_backoff(matches: DataFrame, marked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Conjunction and its backoff in one pass: every item at the first rung that returns it."""
    rows = matches.join(backoff_stops(matches, marked, cfg), "query_id").filter(
        F.col("prefix") >= F.col("stop"))
    rows = rows.select(
        "query_id", "item_id", "prefix", "k", "stop",
        F.round(_score_at(F.col("stop"), cfg), cfg.score_digits).alias("at_stop"),
        F.round(_score_at(F.col("prefix"), cfg), cfg.score_digits).alias("score"))
    # rungs above the stop hold fewer than `pool` items together, the stop rung is cut to its best `pool`
    w = Window.partitionBy("query_id").orderBy(F.desc("at_stop"), F.asc("item_id"))
    rows = rows.withColumn("rk", F.row_number().over(w)).filter(
        (F.col("prefix") > F.col("stop")) | (F.col("rk") <= cfg.pool))
    return rows.select("query_id", "item_id", (F.col("k") - F.col("prefix")).alias("rung"), "score")


def rung_or(matches: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Items holding any strong phrase."""
    rows = matches.select("query_id", "item_id", F.round("total", cfg.score_digits).alias("score"))
    return top(rows, ["query_id"], [F.desc("score"), F.asc("item_id")], cfg.pool)


def evidence_lists(marked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """What `pools.Pools` asks for: a row a query, its evidence as a list, and the size of its pool."""
    entry = F.struct("rnk", "phrase", "strong", "broad", "w")
    return marked.groupBy("query_id").agg(F.collect_list(entry).alias("ev")).withColumn("n", F.lit(cfg.pool))


def broad_heads(members: DataFrame, depth: DataFrame, scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """First `depth` items of every set with place `rk`, the score and coverage that the set's phrases give, and popularity."""
    entry = F.struct(F.lit(0).alias("rnk"), "phrase", F.lit(False).alias("strong"), F.lit(True).alias("broad"), "w")
    asked = members.groupBy("set_id").agg(F.collect_list(entry).alias("ev")).join(depth, "set_id")
    heads = pools.Pools(asked.select(F.col("set_id").alias("query_id"), "ev", F.col("depth").alias("n")), pools.postings(scored), cfg).rows()
    return heads.select(F.col("query_id").alias("set_id"), "item_id", F.col("score").alias("bs"), F.col("cov").alias("bcov"),
                        F.col("pop").alias("bpop"), F.col("pos").alias("rk"))


def rung_or8(marked: DataFrame, scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Items holding any of the rarest `or_phrases` phrases of all evidence."""
    first = (F.col("strong") & (F.col("rnk") <= cfg.or_phrases)) | F.col("broad")
    sets = marked.filter(first).select(F.col("query_id").alias("set_id"), "phrase", "w")
    depth = sets.select("set_id").distinct().withColumn("depth", F.lit(cfg.pool))
    heads = broad_heads(scale.keep(sets), depth, scored, cfg)
    return heads.select(F.col("set_id").alias("query_id"), "item_id", F.col("bs").alias("score"), "rk")


def rung_bag(messages: DataFrame, indexed: DataFrame | PhraseIndex, n: int | None = None,
             cfg: Settings = DEFAULTS) -> DataFrame:
    """(query_id, user_message) -> items holding any of the first distinct content words."""
    from parley.operators import phrases as ph
    terms = F.slice(F.array_distinct(tx.content_tokens(tx.tokens(F.col("user_message")))), 1, cfg.bag_words)
    asked = scale.keep(messages.select("query_id", F.explode(terms).alias("phrase")))
    hits = scale.keep(ph.phrase_hits(indexed, asked, 1, cfg))
    return bm25_search(scored_hits(hits, indexed, cfg), asked, n or cfg.pool)


@dataclass(frozen=True)
class Matches:
    """What every rung starts from, written once."""

    marked: DataFrame   # queries with roles and weights
    scored: DataFrame
    cfg: Settings       # with `strong_phrases` lowered to what the queries have

    @cached_property
    def strong(self) -> DataFrame:
        """Items that the strong phrases match, made when they are first asked for."""
        return scale.keep(strong_matches(self.marked, self.scored, self.cfg))


def prepare(queries: DataFrame, scored: DataFrame, cfg: Settings = DEFAULTS) -> Matches:
    """Roles of the queries' phrases, and the items that their strong phrases match."""
    marked = scale.keep(roles(queries, cfg))
    return Matches(marked, scored, narrowed(marked, cfg))


def candidate_pool(queries: DataFrame, scored: DataFrame, cfg: Settings = DEFAULTS, ready: Matches | None = None) -> DataFrame:
    """(query, item, rung, score, pos, cov, pop): all rungs merged, first appearance wins.

    `cov` is the summed weight of the query's evidence the item covers, over every phrase. `ready` is what `prepare` gave.
    The conjunctions, their backoff and the disjunction of strong phrases end where `rung_backoff` and `rung_or` end them; below
    `pool` items the disjunction of the first phrases follows.
    """
    ready = ready or prepare(queries, scored, cfg)
    return pools.Pools(evidence_lists(ready.marked, cfg), pools.postings(scored), ready.cfg).rows()
