"""The stored index and the bounded search against brute force."""

import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from parley import fixed
from parley.operators import catalogue as cat
from parley.operators import index as ix
from parley.operators import mining, phrases as ph, ranking as rk, scores as sc, topn
from parley.plans import pipeline, scale
from parley.settings import DEFAULTS
from tests.test_search import count_in, freq, make_items


@pytest.fixture(scope="module")
def small(spark):
    items, fields, pops = make_items(spark, 11, 60, ["a", "b", "c", "d"])
    return items, fields, pops


def wanted(seed, n=250, most=7):
    rnd = random.Random(seed)
    return ["", "a zz", "zz", *(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, most))) for _ in range(n))]


@pytest.mark.parametrize("part_places", [1_000_000, 5])
def test_index_against_brute_force(spark, small, part_places):
    items, fields, pops = small
    index = ix.build_index(cat.index_fields(items), buckets=3, cfg=replace(DEFAULTS, part_places=part_places))
    assert (index.terms.agg(F.max("parts")).first()[0] > 1) == (part_places == 5)
    phrases = [p for p in set(wanted(3)) if p]
    table = spark.createDataFrame([(p,) for p in wanted(3)], "phrase string")
    for cap in (2715, 2):
        got = {r.phrase: (r.n, r.df) for r in ph.document_frequency(index, table, cfg=replace(DEFAULTS, df_cap=cap)).collect()}
        assert got == {p: (len(p.split()), min(cap + 1, len(freq(fields, p)))) for p in phrases}
    blobs = {i: [t for f in fixed.INDEX_FIELDS for t in fs[f]] for i, fs in fields.items()}
    want = {(p, i): (len(b), round(pops[i], 9), round(freq(fields, p).get(i, 0.0), 9))
            for p in phrases for i, b in blobs.items() if count_in(b, p)}
    got = {(r.phrase, r.item_id): (r.len, round(r["pop"], 9), round(r.freq, 9)) for r in ph.phrase_hits(index, table).collect()}
    assert got == want


def test_index_is_kept_and_read_without_moving_it(spark, small):
    items, _, _ = small
    built = ix.build_index(cat.index_fields(items), buckets=4)
    index = ix.open_index(spark, built.folder)
    table = scale.keep(spark.createDataFrame([(p,) for p in wanted(5)], "phrase string"))
    same = ph.document_frequency(built, table).exceptAll(ph.document_frequency(cat.index_fields(items), table))
    assert same.isEmpty() and ph.document_frequency(index, table).exceptAll(ph.document_frequency(built, table)).isEmpty()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (ph.document_frequency(index, table), ph.phrase_hits(index, table)):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [k for k, line in enumerate(plan) if "parley_places" in line]
            assert scans and all("Bucketed: true" in plan[k] for k in scans)
            for k in scans:  # from the scan up to its join nothing is exchanged
                depth, at = len(plan[k]) - len(plan[k].lstrip(" :+-")), k
                while "Join" not in plan[at]:
                    at -= 1
                    if len(plan[at]) - len(plan[at].lstrip(" :+-")) < depth:
                        assert "Exchange" not in plan[at]
                        depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ledger_and_mining_read_the_index_only(spark, small, monkeypatch):
    items, _, _ = small
    rnd = random.Random(8)
    texts = ["I am looking for a b. My need is c d", None, *(" ".join(rnd.choice("abcd") for _ in range(12)) for _ in range(12))]
    messages = spark.createDataFrame([(i % 4, 1 + i // 4, t) for i, t in enumerate(texts)], "session_id long, turn int, user_message string")
    index = ix.build_index(cat.index_fields(items), buckets=3)
    cfg = replace(DEFAULTS, mine_min=2, mine_max=5)
    plain = pipeline.build_ledger(messages, items, cfg=cfg).evidence.collect()
    mined = mining.mine(messages, cat.index_fields(items), cfg).collect()

    def no_scan(*_args, **_kw):
        raise AssertionError("the catalogue was scanned")

    monkeypatch.setattr(ph, "item_windows", no_scan)
    assert sorted(pipeline.build_ledger(messages, items, index=index, cfg=cfg).evidence.collect()) == sorted(plain)
    assert sorted(mining.mine(messages, index, cfg).collect()) == sorted(mined)


def test_index_of_nothing(spark, small):
    items, _, _ = small
    index = ix.build_index(cat.index_fields(items.limit(0)), buckets=2)
    table = spark.createDataFrame([("a",), ("a b c",)], "phrase string")
    assert sorted(tuple(r) for r in ph.document_frequency(index, table).collect()) == [("a", 1, 0), ("a b c", 3, 0)]
    assert ph.phrase_hits(index, table).count() == 0


# ------------------------------------------------------------------ bounded search
def lists_of(seed, phrases, items, ties=False):
    """Random lists: common phrases score low, rare ones high, as idf makes them."""
    rnd = random.Random(seed)
    rows = []
    for k in range(phrases):
        size = max(1, int(items / (k + 1)))
        top = 0.2 + k * 0.4
        for i in rnd.sample(range(items), size):
            rows.append((f"p{k}", i, 1.0 if ties else round(top * rnd.random() ** 2, 4)))
    return rows


def plain_search(rows, queries, n):
    by = defaultdict(dict)
    for p, i, s in rows:
        if s > 0:
            by[p][i] = s
    out = {}
    for q, ps in queries.items():
        total = defaultdict(float)
        for p in ps:
            for i, s in by[p].items():
                total[i] += s
        best = sorted(((-round(s, 6), i) for i, s in total.items()))[:n[q] if isinstance(n, dict) else n]
        out |= {(q, i): (round(-s, 6), k + 1) for k, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed, ties, n", [(1, False, 5), (2, False, 1), (3, True, 7), (4, False, 400)])
def test_bounded_search_equals_brute_force(spark, seed, ties, n):
    rnd = random.Random(seed)
    rows = lists_of(seed, 9, 300, ties) + [("p0", 900, 0.0)]
    queries = {q: {f"p{rnd.randrange(11)}" for _ in range(rnd.randint(1, 6))} for q in range(25)}
    scored = spark.createDataFrame(rows, "phrase string, item_id long, s double")
    asked = spark.createDataFrame([(q, p) for q, ps in queries.items() for p in ps], "query_id long, phrase string")
    got = topn.bounded_search(topn.impact_lists(scored), asked, n).collect()
    assert {(r.query_id, r.item_id): (round(r.score, 6), r.rk) for r in got} == plain_search(rows, queries, n)


def test_bounded_search_with_a_depth_per_query(spark):
    rows = lists_of(6, 6, 200)
    queries, depth = {q: {"p0", f"p{1 + q}", "p5"} for q in range(5)}, {q: 1 + 9 * q for q in range(5)}
    scored = spark.createDataFrame(rows, "phrase string, item_id long, s double")
    asked = spark.createDataFrame([(q, p, depth[q]) for q, ps in queries.items() for p in ps], "query_id long, phrase string, depth int")
    got = topn.bounded_search(topn.impact_lists(scored), asked, F.col("depth")).collect()
    assert {(r.query_id, r.item_id): (round(r.score, 6), r.rk) for r in got} == plain_search(rows, queries, depth)


def test_candidates_do_not_grow_with_common_lists(spark):
    """Two rare words and a common one: ten times the catalogue gives no ten times the candidates."""
    counts = []
    for items in (1_000, 10_000):
        rnd = random.Random(2)
        rows = [("common", i, 0.01 + 0.01 * rnd.random()) for i in range(items)]
        rows += [(p, i, 2 + rnd.random()) for p in ("rare", "other") for i in rnd.sample(range(items), 40)]
        lists = topn.impact_lists(spark.createDataFrame(rows, "phrase string, item_id long, s double"))
        asked = spark.createDataFrame([(1, p, 10) for p in ("common", "rare", "other")], "query_id long, phrase string, n long")
        found = topn.candidates(lists, topn._plan(lists, asked, DEFAULTS))
        counts.append(found.count())
        got = topn.bounded_search(lists, asked, 10).collect()
        assert {(r.query_id, r.item_id): (round(r.score, 6), r.rk) for r in got} == plain_search(rows, {1: {"common", "rare", "other"}}, 10)
    assert max(counts) <= 80


# ------------------------------------------------------------------ sums over far-apart orders
def test_calls_up_to_the_first_success(spark):
    rnd = random.Random(3)
    rows = [(k * 10 ** 12, rnd.choice(["hot"] * 6 + ["b", "c", "d"]), rnd.random() < 0.02) for k in range(600)] + [(7, "never", False)] * 3
    rnd.shuffle(rows)
    got = {r.request_key: (r.n_requests, r.n_calls, r.n_hits, r.first_success) for r in sc.request_cache(
        spark.createDataFrame(rows, "request_order long, body string, ok boolean")).collect()}
    for body in ("hot", "b", "c", "d", "never"):
        own = sorted((o, ok) for o, b, ok in rows if b == body)
        first = min((o for o, ok in own if ok), default=None)
        calls = sum(first is None or o <= first for o, _ in own)
        assert got[hashlib.sha256(body.encode()).hexdigest()] == (len(own), calls, len(own) - calls, first)


def test_calibration_of_far_apart_arrivals(spark):
    rows = [(k, k * 10 ** 12, 3, 1, float(k % 7)) for k in range(200)]
    got = {r.session_id: (r.seen, round(r.mean_pop, 9)) for r in rk.pop_calibration(
        spark.createDataFrame(rows, "session_id long, arrival long, turn int, pos int, pop double"), "arrival").collect()}
    total = 0.0
    for k in range(200):
        total += k % 7
        assert got[k] == (k + 1, round(total / (k + 1), 9))


def test_null_message_keeps_its_line(spark):
    m = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "session_id long, turn int, user_message string")
    assert sc.transcripts(m).first().transcript == "Turn 1, shopper: x\nTurn 2, shopper: "


def test_postings_shuffle_only_items_with_several_rows(spark):
    rows = [(1, "red silk red", "s"), (2, "red", ""), (3, "silk red", "x"), (3, "red", "x x"), (None, "red", ""), (None, "red red", "")]
    made = spark.createDataFrame(rows, "item_id long, title string, store string")
    empty = F.expr("cast(array() as array<string>)")
    fields = made.select("item_id", *[F.split(f, " ") if f == "title" else F.expr("filter(split(store, ' '), x -> x <> '')") if f == "store" else empty
                                      for f in fixed.INDEX_FIELDS]).toDF("item_id", *fixed.INDEX_FIELDS)
    want = {}
    for item, title, store in rows:
        for field, text in (("title", title), ("store", store)):
            for pos, term in enumerate(text.split()):
                want.setdefault((term, field, item), []).append(pos)
    got = {(r.term, r.field, r.item_id): r.positions for r in cat.postings(fields).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    alone = cat.postings(scale.keep(fields.filter("item_id < 3")))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 4


def test_mining_makes_only_grams_whose_heads_stand_in_items(spark, monkeypatch):
    """Grams of messages that no item begins are not made, and mining finds the same with and without a broadcast."""
    fields = ", ".join(f"{f} array<string>" for f in fixed.INDEX_FIELDS)
    item = lambda i, title: (i, *[title.split() if f == "title" else ["x", "y"] for f in fixed.INDEX_FIELDS], 0.0)
    items = spark.createDataFrame([item(1, "one two three four five six"), item(2, "nine ten")], f"item_id long, {fields}, pop double")
    said = spark.createDataFrame([(1, "Say one two three four five, please do so now."), (2, "a b c d e f g h i j k l"), (3, "nine ten x y"), (4, "b")], "text_id int, user_message string")
    heads = ph.met_heads(said, items, 4)
    assert heads.count() == 2  # one two three four, two three four five
    grams = ph.message_grams(said, "text_id", 4, 12, heads, 4).collect()
    assert {r.text_id for r in grams} == {1} and {r.start for r in grams} == {2, 3} and len(grams) == 6 + 5
    want = [(r.start, r.n, r.phrase, r.df) for r in mining.mined_rows(mining.mine(said, items)).collect()]
    assert want == [(2, 5, "one two three four five", 1)]
    monkeypatch.setattr(scale, "fits_broadcast", lambda *a: False)
    assert [(r.start, r.n, r.phrase, r.df) for r in mining.mined_rows(mining.mine(said, items, replace(DEFAULTS, broadcast_rows=0))).collect()] == want
