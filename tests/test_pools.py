"""Pools from posting lists: no list is expanded to rows, and blocks, shares and slices of sessions change nothing."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from parley.operators import pools, ranking as rk, retrieval as rt
from parley.plans import pipeline, scale
from parley.settings import DEFAULTS

CFG = replace(DEFAULTS, pool=12, strong_df=9, strong_phrases=4, or_phrases=3, top_k=5)


def make(spark, seed, named=False):
    rnd = random.Random(seed)
    lists = {f"p{k}": {i: rnd.choice([0.0, 0.5, 1.25, 2.0, 3.5]) for i in rnd.sample(range(80), rnd.choice([2, 5, 8, 20, 40, 60]))} for k in range(12)}
    name = (lambda i: f"i{i:03d}") if named else int
    kind = "string" if named else "bigint"
    scored = [(p, name(i), s, float(i % 7)) for p, m in lists.items() for i, s in m.items()]
    queries = []
    for q in range(40):
        told = sorted(rnd.sample(sorted(lists), rnd.randint(1, 9)), key=lambda p: len(lists[p]))
        queries += [(q, k, p, rnd.choice(["con", "cat", "sem"]), len(lists[p])) for k, p in enumerate(told, 1)]
    return (scale.keep(spark.createDataFrame(scored, f"phrase string, item_id {kind}, s double, pop double")),
            scale.keep(spark.createDataFrame(queries, "query_id bigint, rnk int, phrase string, tier string, df bigint")))


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("seed,named", [(1, False), (2, True), (3, False)])
def test_blocks_and_shares_change_nothing(spark, monkeypatch, seed, named):
    scored, queries = make(spark, seed, named)
    ready = rt.prepare(queries, scored, CFG)
    asked = rt.evidence_lists(ready.marked, CFG)
    whole = pools.Pools(asked, pools.postings(scored), ready.cfg)
    want = rounded(whole.rows())
    best = rounded(whole.ranked("query_id", F.lit(3.0), 5, CFG))
    assert want and best
    monkeypatch.setattr(pools, "FEW_QUERIES", 7)  # several shares, and no long lists
    monkeypatch.setattr(pools, "SPREAD_BYTES", 0)
    parted = pools.Pools(asked, pools.postings(scored), ready.cfg, block=17)
    assert rounded(parted.rows()) == want
    assert rounded(parted.ranked("query_id", F.lit(3.0), 5, CFG)) == best
    assert rounded(parted.rows(first=4)) == [r for r in want if r[4] <= 4]


def test_no_list_is_expanded_to_rows(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("lists joined to queries")
    scored, queries = make(spark, 4)
    monkeypatch.setattr(rt, "with_lists", refuse)
    pool = scale.keep(rt.candidate_pool(queries, scored, CFG))
    ready = rt.prepare(queries, scored, CFG)
    eight = rt.rung_or8(ready.marked, scored, ready.cfg).collect()
    lists, told = {}, {}
    for r in scored.collect():
        lists.setdefault(r.phrase, {})[r.item_id] = r.s
    for r in queries.collect():
        told.setdefault(r.query_id, []).append(r)
    for q, ev in told.items():
        eights = [r.phrase for r in ev if r.rnk <= CFG.or_phrases]
        total = {i: round(sum(lists[p].get(i, 0.0) for p in eights), 6) for i in range(80)}
        want = sorted((i for i in total if total[i] > 0), key=lambda i: (-total[i], i))[:CFG.pool]
        assert [r.item_id for r in sorted((r for r in eight if r.query_id == q), key=lambda r: r.rk)] == want
        strong = [r.phrase for r in ev if r.df <= CFG.strong_df and r.rnk <= CFG.strong_phrases]
        if not strong:
            assert [r.item_id for r in pool.filter(f"query_id = {q}").orderBy("pos").collect()] == want


def test_ranking_of_pools_equals_that_of_rows(spark, monkeypatch):
    scored, queries = make(spark, 5)
    found = pipeline.Retrieval(queries.select(F.col("query_id").alias("session_id"), "query_id").distinct(), queries, scored, CFG)
    rows = rk.rank_items(found.pool, F.lit(6.0), cfg=CFG).select("query_id", "item_id", "rank", "rank_score")
    assert rounded(rk.rank_items(found.pools(), F.lit(6.0), cfg=CFG)) == rounded(rows)
    # sessions of one query, more than a slice holds, each with a weight of its own
    monkeypatch.setattr(pipeline, "SHARED", 3)
    sessions = spark.range(200).select(F.col("id").alias("session_id"), (F.col("id") % 9).alias("query_id"), (F.col("id") % 4 / 4.0).alias("w_pop"))
    got = rk.rank_items(found.pools(of=pipeline.by_evidence(sessions, ["query_id"])), F.lit(6.0), cfg=CFG, by="session_id")
    pooled = found.pool.join(sessions, "query_id")
    want = rk.rank_items(pooled, F.lit(6.0), w_pop=F.col("w_pop"), cfg=CFG, by="session_id").select("session_id", "item_id", "rank", "rank_score")
    assert rounded(got) == rounded(want)
