"""Phrase operators, mining and retrieval against brute force on small random catalogues."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley.operators import catalogue as cat
from parley.operators import mining, phrases as ph, ranking as rk, retrieval as rt
from parley.plans import pipeline, scale
from parley.sources import tables as tb
from parley.settings import DEFAULTS

FIELDS = fixed.INDEX_FIELDS


def make_items(spark, seed, n, words):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pick = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, k)))
        rows.append((i, pick(4), [pick(3)], [pick(3), pick(3)], {"k": pick(2)}, pick(2), [pick(9)], rnd.randint(0, 50), None))
    items = spark.createDataFrame(
        rows, "item_id long, title string, categories array<string>, features array<string>, details map<string,string>, "
              "store string, description array<string>, rating_number int, price double")
    fields = {}
    for i, t, c, f, d, s, desc, *_ in rows:
        text = {"title": t, "categories": " ".join(c), "features": " ".join(f), "store": s,
                "details": " ".join(f"{k} {v}" for k, v in d.items()), "description": " ".join(desc)}
        fields[i] = {k: v.split() for k, v in text.items()}
    return items, fields, {r[0]: math.log1p(r[7]) for r in rows}


def count_in(toks, phrase):
    p = phrase.split()
    return sum(toks[i:i + len(p)] == p for i in range(len(toks) - len(p) + 1))


def freq(fields, phrase):
    return {i: f for i, fs in fields.items()
            if (f := sum(fixed.FIELD_WEIGHTS[k] * count_in(t, phrase) for k, t in fs.items())) > 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_document_frequency_and_mining(spark, seed):
    words = ["a", "b", "c"]
    items, fields, _ = make_items(spark, seed, 40, words)
    rnd = random.Random(seed + 100)
    cfg = replace(DEFAULTS, mine_min=2, mine_max=5, df_cap=4)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(15)]
    msgs = spark.createDataFrame([(t,) for t in texts + texts[:3]], "user_message string")
    indexed = scale.keep(cat.index_fields(items))
    got = {r.user_message: [(p.start - 1, p.n, p.phrase, p.df) for p in r.picks] for r in mining.mine(msgs, indexed, cfg).collect()}
    for t in texts:
        toks = t.split()
        counts = {(i, n): len(freq(fields, " ".join(toks[i:i + n]))) for n in range(2, 6) for i in range(len(toks) - n + 1)}
        attested = {span for span, df in counts.items() if 0 < df <= cfg.df_cap}
        picks = got.get(t, [])
        covered = {i for start, n, _, _ in picks for i in range(start, start + n)}
        assert len(covered) == sum(n for _, n, _, _ in picks)  # no overlap
        for start, n, phrase, df in picks:
            assert (phrase, df) == (" ".join(toks[start:start + n]), counts[start, n])
            assert (start, n) in attested and not any((start, k) in attested for k in range(n + 1, 6))
        # no attested gram starts in what is left over
        assert not any(i not in covered for i, _ in attested)


def expected_pool(fields, evidence, cfg):
    """The pool by definition: a rung is a set of scored items, cut to its best `pool`. Conjunctions of the k rarest
    strong phrases are open, for falling k, while the open ones before hold fewer than `pool` items; then any strong phrase;
    then, below `pool` items, any of the first phrases. An item stands where its first open rung puts it."""
    size = {i: sum(map(len, fs.values())) for i, fs in fields.items()}
    mean = sum(size.values()) / len(size)
    found = {p: freq(fields, p) for p, _, _ in evidence}
    idf = {p: max(math.log((len(fields) - len(f) + 0.5) / (len(f) + 0.5)), 1e-6) for p, f in found.items()}
    part = {p: {i: idf[p] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean)) for i, f in found[p].items()} for p in found}

    def rung(phrases, least):
        hits = {i: [part[p][i] for p in phrases if i in part[p]] for i in set().union(*(part[p] for p in phrases))} if phrases else {}
        order = sorted((-round(sum(h), 6), i) for i, h in hits.items() if len(h) >= least)
        return {i: k for k, (_, i) in enumerate(order[:cfg.pool])}

    strong = [p for p, df, _ in evidence if df <= cfg.strong_df][:cfg.strong_phrases]
    ladder = [rung(strong[:k], k) for k in range(len(strong), 0, -1)]
    held = [len(set().union(*ladder[:k])) for k in range(len(ladder))]
    opened = [r for r, n in zip(ladder, held) if n < cfg.pool or not n] + [rung(strong, 1)]
    if len(set().union(*opened)) < cfg.pool:
        opened.append(rung([p for p, _, _ in evidence][:cfg.or_phrases], 1))
    places = {}
    for k, r in reversed(list(enumerate(opened))):
        places |= {i: (k, at) for i, at in r.items()}
    return sorted(places, key=places.get)


@pytest.mark.parametrize("pool,strong_df,or_phrases", [(5, 6, 3), (12, 10, 4), (60, 8, 3), (20, 0, 2)])
def test_pool_and_ranking(spark, pool, strong_df, or_phrases):
    words = ["a", "b", "c", "d", "e", "f"]
    items, fields, pops = make_items(spark, pool, 70, words)
    # the depth of a shared list is pool + strong_phrases * strong_df, so the caps stay consistent
    cfg = replace(DEFAULTS, pool=pool, strong_df=strong_df, strong_phrases=4, or_phrases=or_phrases, top_k=7)
    rnd = random.Random(pool)
    queries, rows = {}, []
    for q in range(25):
        ev = {}
        for _ in range(rnd.randint(1, 9)):
            p = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 2, 3])))
            if freq(fields, p):
                ev.setdefault(p, (len(freq(fields, p)), rnd.choice(["con", "cat", "mined", "sem"])))
        for seq, (p, (df, tier)) in enumerate(ev.items()):
            rows.append((q, 1, seq, p, tier, df))
        queries[q] = [(p, df, tier) for p, (df, tier) in sorted(ev.items(), key=lambda kv: kv[1][0])]
    evidence = spark.createDataFrame(rows, "session_id long, turn int, seq int, phrase string, tier string, df long")
    indexed = scale.keep(cat.index_fields(items))
    links, qs = rt.distinct_queries(rt.rank_evidence(evidence, ["session_id"]), ["session_id"])
    scored = scale.keep(rt.scored_hits(ph.phrase_hits(indexed, qs, cfg=cfg), indexed, cfg))
    found = scale.keep(rt.candidate_pool(qs, scored, cfg))
    got = {}
    for r in links.join(found, "query_id").orderBy("session_id", "pos").collect():
        got.setdefault(r.session_id, []).append(r.item_id)
    max_pop = max(pops.values())
    tops = {}
    ranked = rk.rank_items(found, F.lit(max_pop), cfg=cfg)
    for r in links.join(ranked, "query_id").orderBy("session_id", "rank").collect():
        tops.setdefault(r.session_id, []).append(r.item_id)
    titled = replace(cfg, w_title=0.7)
    with_title = {}
    pooled = pipeline.with_titles(pipeline.Retrieval(links, qs, scored, cfg), indexed, titled)
    for r in links.join(rk.rank_items(pooled, F.lit(max_pop), cfg=titled), "query_id").orderBy("session_id", "rank").collect():
        with_title.setdefault(r.session_id, []).append(r.item_id)
    for q, ev in queries.items():
        want = expected_pool(fields, ev, cfg)
        assert got.get(q, []) == want, (q, ev)

        def weight(p, df, tier):
            base = {"con": cfg.w_con, "cat": cfg.w_cat, "sem": cfg.w_sem}.get(
                tier, cfg.w_mined * min(1.0, len(p.split()) / cfg.mined_length))
            return base / (1.0 + df) ** cfg.df_power

        def score(i):
            blob = " " + " ".join(w for f in FIELDS for w in fields[i][f]) + " "
            return round(sum(weight(*e) for e in ev if f" {e[0]} " in blob) + cfg.w_pop * pops[i] / max_pop, 6)

        def title(i):
            blob = f" {' '.join(fields[i]['title'])} "
            return sum(weight(*e) for e in ev if f" {e[0]} " in blob)

        def more(i):
            blob = " " + " ".join(w for f in FIELDS for w in fields[i][f]) + " "
            return round(sum(weight(*e) for e in ev if f" {e[0]} " in blob) + cfg.w_pop * pops[i] / max_pop + 0.7 * title(i), 6)

        assert tops.get(q, []) == sorted(want, key=lambda i: (-score(i), want.index(i)))[:cfg.top_k]
        assert with_title.get(q, []) == sorted(want, key=lambda i: (-more(i), want.index(i)))[:cfg.top_k]


def test_a_weight_without_its_column_is_an_error(spark):
    pool = spark.createDataFrame([(1, 1, 1.0, 1.0, 1)], "query_id long, item_id long, cov double, pop double, pos int")
    for name in ("w_title", "w_profile"):
        with pytest.raises(ValueError, match=name):
            rk.rank_items(pool, F.lit(1.0), cfg=replace(DEFAULTS, **{name: 0.5}))


def test_profiles_and_calibration_reach_the_ranking(spark):
    d = "/root/testdata/sf0.001"
    messages, items = tb.messages(spark, d).filter("session_id < 260"), tb.products(spark, d)
    ledger = pipeline.build_ledger(messages, items)
    ids = messages.select("session_id").distinct()
    plain = {(r.session_id, r.item_id): r.rank_score for r in pipeline.top_items(messages, items, ledger=ledger).collect()}
    tags = ids.withColumn("tags", F.array(F.lit("Jewelry")))  # every item has it
    liked = {(r.session_id, r.item_id): r.rank_score for r in pipeline.top_items(
        messages, items, replace(DEFAULTS, w_profile=0.25), profiles=tags, ledger=ledger).collect()}
    assert liked.keys() == plain.keys() and all(abs(liked[k] - plain[k] - 0.25) < 2e-6 for k in plain)
    with pytest.raises(ValueError, match="profiles"):
        pipeline.top_items(messages, items, replace(DEFAULTS, w_profile=0.25), ledger=ledger)
    arrivals = ids.withColumn("arrival", F.col("session_id"))
    cfg = replace(DEFAULTS, pop_warmup=3, pop_low=100.0, pop_high=101.0)  # no prior once three sessions are seen
    late = {r.session_id: r.w_pop for r in pipeline.population_weights(ledger, arrivals, cat.index_fields(items), cfg).collect()}
    order = sorted(late)
    assert late[order[0]] == cfg.w_pop and late[order[-1]] == 0.0 and len(late) == ids.count()
