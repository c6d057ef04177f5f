"""What single steps read, build and shuffle."""

from parley import session
from parley.operators import catalogue as cat
from parley.operators import ledger as lg
from parley.operators import retrieval as rt
from parley.plans import queries as q
from parley.sources import tables as tb

SMALL = "/root/testdata/sf0.001"


def _refuse(*args, **kwargs):
    raise AssertionError("not needed for this query")


def test_wording_counts_build_no_ledger(spark, monkeypatch):
    monkeypatch.setattr(q.pipeline, "build_ledger", _refuse)
    monkeypatch.setattr(q.ix, "build_index", _refuse)
    q.forget()
    for name in ("lost_counts", "buying_flag"):
        assert q.QUERIES[name](spark, SMALL).count() == tb.messages(spark, SMALL).count()


def test_wording_of_null_and_unknown_messages(spark):
    rows = [(1, 1, "I'm looking for blue ring. A key requirement is: gold."), (1, 2, None), (1, 3, "bla bla"), (2, 1, "bla")]
    got = lg.wording(spark.createDataFrame(rows, "session_id bigint, turn int, user_message string"))
    assert sorted((r.session_id, r.turn, r.lost, r.buying) for r in got.collect()) == [
        (1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 2, 1), (2, 1, 1, 0)]


def test_category_spans_need_no_attributes(spark, monkeypatch):
    monkeypatch.setattr(cat, "attribute_vocabulary", _refuse)
    assert q.QUERIES["span_category"](spark, SMALL).count() > 0


def test_messages_read_the_lines_once(spark):
    session.configure(spark)
    plan = tb.messages(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == 2  # lineitem and part


def test_products_are_dealt_to_all_tasks(spark):
    from parley.plans import scale
    assert tb.products(spark, SMALL).rdd.getNumPartitions() == scale.slots(spark)


def test_broad_heads_equal_brute_force(spark):
    lists = {p: {i: float((i * k) % 7) for i in range(0, 60, k)} for k, p in enumerate("abc", 1)}
    scored = spark.createDataFrame([(p, i, s, 0.5) for p, m in lists.items() for i, s in m.items()], "phrase string, item_id bigint, s double, pop double")
    members = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "c", 2.0)], "set_id bigint, phrase string, w double")
    depth = spark.createDataFrame([(1, 9), (2, 100)], "set_id bigint, depth bigint")
    got = rt.broad_heads(members, depth, scored).collect()
    for key, phrases, n in ((1, "ab", 9), (2, "c", 100)):
        weight = {(r.set_id, r.phrase): r.w for r in members.collect()}
        total = {i: sum(lists[p].get(i, 0.0) for p in phrases) for i in range(60)}
        want = sorted((i for i in total if total[i] > 0), key=lambda i: (-total[i], i))[:n]
        mine = sorted((r for r in got if r.set_id == key), key=lambda r: r.rk)
        assert [r.item_id for r in mine] == want
        assert [r.bcov for r in mine] == [sum(weight[key, p] for p in phrases if i in lists[p]) for i in want]
