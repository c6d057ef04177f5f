import pytest
from pyspark.sql import functions as F

from parley.operators import evaluation as ev
from parley.plans import scale


def test_normalise_keeps_first_valid_unique(spark):
    turns = spark.createDataFrame([("q4", 3, ["red", "?", "blue", " red", "", "tan", "blue"]), ("q4", 4, None)],
                                  "session_id string, turn int, recommendations array<string>")
    ids = spark.createDataFrame([("blue",), ("red",), ("tan",), ("white",)], "item_id string")
    got = ev.normalize_recommendations(ev.explode_recommendations(turns), ids).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["red", "blue", "tan"]


RESULT = "session_id string, scenario_type string, hit boolean, first_hit_turn int, reciprocal_rank double"


def test_miss_counts_as_turn_eleven(spark):
    r = spark.createDataFrame([("q1", "u", True, 4, 0.25), ("q2", "u", False, None, 0.0), ("q3", "u", True, 3, 1.0), ("q5", "u", False, None, 0.0)], RESULT)
    s = ev.summary(r).first()
    assert (s.sample_count, s.hit_rate_at_10, s.mrr, s.mttc) == (4, 0.5, 0.3125, 7.25)


def test_no_sessions(spark):
    s = ev.composite(ev.summary(spark.createDataFrame([], RESULT))).first()
    assert (s.sample_count, s.hit_rate_at_10, s.mttc, s.technical_score) == (0, 0.0, None, None)


@pytest.mark.parametrize("hr,mrr,mttc,eff,score", [(0.125, 0.068034, 9.81, 0.119, 0.10671),
                                                   (0.995, 0.995, 2.225, 0.8775, 0.9715)])
def test_composite(spark, hr, mrr, mttc, eff, score):
    df = spark.createDataFrame([(hr, mrr, mttc)], "hit_rate_at_10 double, mrr double, mttc double")
    r = ev.composite(df).first()
    assert (r.efficiency, r.technical_score) == (eff, score)


def test_token_counts_of_json_are_whole_numbers_only(spark):
    rows = [('{"p": 5, "c": "7"}',), ('{"p": 2.5, "c": 3}',), ('{"p": -4, "c": null}',), ('{"c": 1e2}',), ("{}",), (None,)]
    v = F.parse_json("raw")
    usage = spark.createDataFrame(rows, "raw string").select(
        F.try_variant_get(v, "$.p", "variant").alias("prompt_tokens"), F.try_variant_get(v, "$.c", "variant").alias("completion_tokens"))
    assert ev.token_totals(usage).first().asDict() == {"prompt_tokens": 5, "completion_tokens": 3, "total_tokens": 8}


def test_hit_waits_for_the_override(spark):
    ranked = spark.createDataFrame([(1, 1, 9, 1), (1, 3, 9, 2), (1, 4, 9, 1)],
                                   "session_id int, turn int, item_id int, rank int")
    sessions = spark.createDataFrame([(1, "intent_override", 9, 3)],
                                     "session_id int, scenario_type string, target int, override_turn int")
    r = ev.first_hits(ranked, sessions).first()
    assert (r.hit, r.first_hit_turn, r.best_rank, r.reciprocal_rank) == (True, 3, 2, 0.5)


def test_sliced_running_sum_and_lag(spark):
    rows = [(k, i, i % 5) for k in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    part = F.floor(F.col("i") / 7)
    got = {(r.k, r.i): r.s for r in scale.running(df, ["k"], ["i"], part, {"s": F.col("v")}).collect()}
    lag = {(r.k, r.i): r.p for r in scale.previous(df, ["k"], ["i"], part, "v", "p").collect()}
    for k in "ab":
        total = 0
        for i in range(100):
            total += i % 5
            assert got[k, i] == total
            assert lag[k, i] == (None if i == 0 else (i - 1) % 5)


def test_weighted_sample_is_repeatable_and_favours_weight(spark):
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.when(F.col("id") < 100, 1000).otherwise(1).alias("rating_number"))
    a = [r.item_id for r in ev.weighted_sample(items, 1.0, 100).collect()]
    assert a == [r.item_id for r in ev.weighted_sample(items, 1.0, 100).collect()]
    assert len(set(a)) == 100 and sum(i < 100 for i in a) > 60
    assert sum(r.item_id < 100 for r in ev.weighted_sample(items, 0.0, 100).collect()) < 40
