"""Replay of whole conversations and the streaming ledger."""

import glob
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from parley import fixed, session
from parley.operators import ledger as lg, questions as qs, ranking as rk
from parley.plans import pipeline, scale
from parley.sources import tables as tb
from parley.streaming import ledger as st

D = "/root/testdata/sf0.001"


def test_replay_demotes_and_carries(spark):
    rnd = random.Random(5)
    rows = [(s, t, rnd.random() < 0.2, [] if rnd.random() < 0.2 else rnd.sample(range(6), 4))
            for s in range(30) for t in range(1, 11)]
    df = spark.createDataFrame(rows, "session_id int, turn int, override boolean, ranked array<int>")
    got = {(r.session_id, r.turn): r.shown for r in rk.replay(df, "int").collect()}
    for s in range(30):
        rejected, last = [], []
        for _, t, clear, ranked in [r for r in rows if r[0] == s]:
            rejected = [] if clear else rejected
            base = ranked or last
            last = [i for i in base if i not in rejected] + [i for i in base if i in rejected]
            shown = last[:10 if t == 10 else 1]
            assert got[s, t] == shown
            rejected = rejected + shown


def test_questions_are_asked_once(spark):
    rnd = random.Random(6)
    rows = [(s, t, {a: (float(rnd.choice([1, 2, 3])), 5) for a in fixed.QUESTION_ORDER} if s % 3 else None)
            for s in range(20) for t in range(1, 11)]
    df = spark.createDataFrame([(s, t, None if e is None else {a: (5, x[0]) for a, x in e.items()}) for s, t, e in rows],
                               "session_id int, turn int, expected map<string,struct<pool_size:long,expected:double>>")
    got = {(r.session_id, r.turn): r.ask_attribute for r in qs.replay_questions(df).collect()}
    for s in range(20):
        asked = []
        for _, t, e in [r for r in rows if r[0] == s]:
            free = [a for a in fixed.QUESTION_ORDER if a == "other" or a not in asked]
            want = (min(free, key=lambda a: (e[a][0], fixed.QUESTION_ORDER.index(a))) if e else
                    next(a for a in fixed.FALLBACK_ORDER if a in free))
            assert got[s, t] == want
            asked.append(want)


def test_respond_covers_every_turn(spark):
    out = scale.keep(pipeline.respond(tb.messages(spark, D), tb.products(spark, D)))
    n = tb.messages(spark, D).count()
    assert out.count() == n
    assert out.filter("message is null or ask_attribute is null").count() == 0
    assert out.filter("turn < 10 and size(shown) > 1").count() == 0


def test_stream_equals_batch_for_any_arrival_order(spark, tmp_path):
    ledger = pipeline.build_ledger(tb.messages(spark, D).filter("session_id < 200"), tb.products(spark, D))
    rows = scale.keep(ledger.observed.select(
        "*", F.lit(None).cast("array<bigint>").alias("shown"), F.lit(None).cast("string").alias("asked")))
    # later turns arrive first
    for i, (lo, hi) in enumerate([(3, 10), (2, 2), (1, 1)]):
        rows.filter(F.col("turn").between(lo, hi)).write.parquet(f"{tmp_path}/said/batch={i}")
    rows.filter("turn = 2").write.parquet(f"{tmp_path}/said/batch=3")  # repeated delivery
    out = st.ledger_stream(st.read_analysed(spark, f"{tmp_path}/said", 2), gap_ms=None)
    (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
     .trigger(availableNow=True).start().awaitTermination())
    applied = spark.read.schema(st.OUTPUT).parquet(f"{tmp_path}/out")
    cols = ["session_id", "turn", "stale", "lost", "epoch"]
    def plain(df):
        return sorted(tuple(int(v) for v in r) for r in df.select(*cols).collect())
    # a session whose early turns are missing would wait; here every turn arrives
    assert plain(applied) == plain(ledger.states)
    ev = ["session_id", "turn", "seq", "phrase", "tier", "df"]
    assert sorted(map(tuple, st.evidence_rows(applied).select(*ev).collect())) == sorted(
        map(tuple, ledger.evidence.select(*ev).collect()))


def _said(session, turn, phrases, **flags):
    ev = [(i, p, "con", 1) for i, p in enumerate(phrases)]
    told = dict(noinfo=False, known=True, override=False, counted=True, states_con=True) | flags
    return (session, turn, *told.values(), ev, [turn], None)


def _replayed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, st.OBSERVED).write.parquet(f"{folder}/said/batch={i}")
    out = st.ledger_stream(st.read_analysed(spark, f"{folder}/said", 1), gap_ms=None)
    (out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
     .trigger(availableNow=True).start().awaitTermination())
    applied = spark.read.schema(st.OUTPUT).parquet(f"{folder}/out")
    observed = spark.read.schema(st.OBSERVED).parquet(f"{folder}/said/batch=*")
    return applied, st.flush(observed, applied)


def test_missing_and_late_turns(spark, tmp_path):
    whole = [_said(1, t, [f"p{t}", "p1"]) for t in range(1, 11)]
    gap = [_said(2, t, [f"q{t}"]) for t in (1, 2, 4, 5, 6)]
    applied, rest = _replayed(spark, str(tmp_path), [whole[:5] + gap[:1], whole[5:] + gap[2:], [whole[2], gap[1], gap[1]], [whole[9]]])
    got = {(r.session_id, r.turn): r for r in applied.collect()}
    assert sorted(got) == [(1, t) for t in range(1, 11)] + [(2, 1), (2, 2)]
    assert [got[1, t].n_evidence for t in (1, 2, 10)] == [1, 2, 10]
    more = {(r.session_id, r.turn): r for r in rest.collect()}
    assert sorted(more) == [(2, 4), (2, 5), (2, 6)]
    assert (more[2, 6].n_evidence, more[2, 6].n_rejected, more[2, 6].stale) == (5, 4, 0)


def test_micro_batches_do_not_grow_with_files(spark):
    """The number of micro-batches follows from the turns, not from how many tasks wrote them."""
    sizes = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    work = f"{scale.work_folder(spark)}/stream-*/said/done/*"
    before = set(glob.glob(work))
    kept, session.RUNTIME["spark.sql.adaptive.coalescePartitions.enabled"] = session.RUNTIME["spark.sql.adaptive.coalescePartitions.enabled"], "false"
    try:
        assert entry.queries()["stream_ledger"](spark, D).count() == tb.messages(spark, D).count()
    finally:
        session.RUNTIME["spark.sql.adaptive.coalescePartitions.enabled"] = kept
        spark.conf.set("spark.sql.shuffle.partitions", sizes[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", sizes[1])
    assert len(set(glob.glob(work)) - before) == 2


def test_null_messages_say_nothing(spark):
    items = tb.products(spark, D)
    rows = [(1, 1, "blah"), (1, 2, None), (1, 3, ""), (2, 1, None)]
    states = pipeline.build_ledger(spark.createDataFrame(rows, "session_id long, turn int, user_message string"), items).states
    got = {(r.session_id, r.turn): (r.lost, r.stale) for r in states.collect()}
    assert got == {(1, 1): (1, 1), (1, 2): (2, 2), (1, 3): (3, 3), (2, 1): (1, 1)}


def test_long_categories_and_long_messages(spark):
    words = [f"word{i}" for i in range(30)]
    items = spark.createDataFrame(
        [(1, "thing", ["root", " ".join(words)], ["f"], ["d"], {"k": "v"}, "s", 1, None)],
        "item_id long, title string, categories array<string>, features array<string>, description array<string>, "
        "details map<string,string>, store string, rating_number int, price double")
    clause = " ".join(words)
    filler = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, 1, f"I'm looking for {clause}, but I'm still exploring."), (2, 1, f"{filler} {clause} maybe")]
    ledger = pipeline.build_ledger(spark.createDataFrame(rows, "session_id long, turn int, user_message string"), items)
    found = {(r.session_id, r.phrase) for r in ledger.evidence.select("session_id", "phrase").collect()}
    assert (1, "word7") in found and any(len(p.split()) >= 22 for s, p in found if s == 1)
    grown = {r.session_id: r.grew for r in ledger.states.collect()}
    assert grown == {1: 1, 2: 1}


def test_signatures_broadcast_neither_values_nor_disclosures(spark):
    pool = spark.createDataFrame([(1, 7), (2, 7)], "query_id long, item_id long")
    values = spark.createDataFrame([(7, "other", ["red", "silk"])], "item_id long, attribute string, vals array<string>")
    told = spark.createDataFrame([(1, ["red"])], "query_id long, vals array<string>")
    rows = qs.reply_signatures(scale.keep(pool), scale.keep(values), scale.keep(told))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.first, r.second) for r in rows.filter("attribute = 'other'").collect()}
    assert got == {(1, "silk", None), (2, "red", "silk")}


def test_signatures_move_no_values_to_the_queries(spark):
    """What was told goes to the items: values are in no shuffle after they met the pool. Lists of either side give the same."""
    values = spark.createDataFrame([(1, "other", ["a", "b", "a", "c"]), (2, "other", ["b"]), (2, "size", ["b", "d"])], "item_id int, attribute string, vals array<string>")
    pool = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (9, 3)], "query_id int, item_id int")
    told = spark.createDataFrame([(7, ["a"]), (8, ["b", "x"])], "query_id int, vals array<string>")
    rows = qs.reply_signatures(pool, values, told)
    got = {(r.query_id, r.item_id, r.attribute): (r.first, r.second) for r in rows.collect()}
    want = {(7, 1, "other"): ("b", "c"), (7, 2, "other"): ("b", None), (7, 2, "size"): ("b", "d"), (8, 2, "size"): ("d", None)}
    assert {k: v for k, v in got.items() if v != (None, None)} == want and len({k[:2] for k in got}) == 4
    own = pool.join(told.withColumnRenamed("vals", "told"), "query_id", "left")
    assert {(r.query_id, r.item_id, r.attribute): (r.first, r.second) for r in qs.reply_signatures(own, values, by_query=True).collect()} == got
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("told") < plan.index("Join") and plan.count("Join") == 2
    upper, lower = plan.split("Join", 1)[1].split("Join", 1)
    assert "map_from_entries" not in lower.split("Aggregate")[0]


def test_askable_meets_by_session(spark):
    """One join a turn, not one an attribute; a question without attribute takes nothing away."""
    turns = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "session_id int, turn int")
    asked = spark.createDataFrame([(1, 1, "color"), (1, 2, None), (1, 3, "feature")], "session_id int, turn int, attribute string")
    rows = lg.askable(turns, asked)
    got = {(r.session_id, r.turn, r.attribute) for r in rows.collect()}
    assert (1, 1, "color") in got and (1, 3, "color") not in got and (1, 3, "feature") in got and (2, 1, "color") in got
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan.split("Join")[0] and plan.count("Join") == 1
