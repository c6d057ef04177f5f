import json

import pytest

from parley.operators import catalogue as cat
from parley.sources import jsonl

ROWS = [
    {"parent_asin": "K-31", "title": "Green rain hood", "features": ["nylon"], "details": {"season": "autumn"},
     "description": ["folds into its own bag"], "categories": ["Outdoor", "Hoods"], "store": "Moorland",
     "average_rating": 3.1, "rating_number": 205, "price": 17.5},
    {"parent_asin": "K-32", "title": "Plain red scarf", "features": ["wool"], "details": {"length": "long"},
     "description": ["knitted"], "categories": ["Outdoor", "Scarves"], "store": "Moorland",
     "average_rating": 4.9, "rating_number": 3, "price": 22.25},
    {"parent_asin": 7, "title": None, "features": "bare text", "details": {"z": "1", "a": "2"}, "price": 5},
]


def catalogue(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text("".join(json.dumps(r) + "\n" for r in ROWS) + "\n  \n")
    return jsonl.read_catalogue(spark, str(f))


BROKEN = ['{"title": "no id"}', "not json", '{"parent_asin": "K-33"', "[1, 2]"]


def test_malformed_lines_fail_or_are_handed_out(spark, tmp_path):
    f = tmp_path / "b.jsonl"
    f.write_text("\n".join([json.dumps(ROWS[0]), *BROKEN]) + "\n")
    with pytest.raises(Exception, match="malformed catalogue line"):
        jsonl.read_catalogue(spark, str(f)).collect()
    raw = jsonl.lines(spark, str(f))
    assert [r.item_id for r in jsonl.catalogue_from_lines(raw, on_error="drop").collect()] == ["K-31"]
    assert sorted(r.value for r in jsonl.rejected_lines(raw).collect()) == sorted(BROKEN)


def test_malformed_sessions_fail_or_are_handed_out(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"sample_id": "q9"}\n{"sample_id": \n{"scenario_type": "x"}\n')
    with pytest.raises(Exception, match="malformed session line"):
        jsonl.read_sessions(spark, str(f)).collect()
    raw = jsonl.lines(spark, str(f))
    assert [r.sample_id for r in jsonl.sessions_from_lines(raw, on_error="drop").collect()] == ["q9"]
    assert jsonl.rejected_lines(raw, "sample_id").count() == 2


def test_catalogue_rows_and_cards(spark, tmp_path):
    cards = {r.item_id: (r.hard_constraints, r.soft_preferences)
             for r in cat.intent_cards(catalogue(spark, tmp_path)).collect()}
    assert cards["K-31"] == (["nylon", "color: green"], ["season: autumn", "budget around $17.5"])
    assert cards["K-32"] == (["wool", "color: red"], ["length: long", "budget around $22.25"])
    # object keys keep their order, whole numbers stay whole, a bare string counts as one value
    assert cards["7"] == (["bare text", "z: 1"], ["a: 2", "budget around $5"])


def test_sessions_skip_blank_lines_and_lookup_fails_on_unknown(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"sample_id": "s1", "scenario_type": "buying", "ground_truth": {"parent_asin": "K-31"}}\n\n')
    s = jsonl.read_sessions(spark, str(f))
    assert [(r.sample_id, r.ground_truth.parent_asin) for r in s.collect()] == [("s1", "K-31")]
    assert jsonl.lookup_session(s, "s1", "sample_id").count() == 1
    with pytest.raises(Exception, match="unknown session"):
        jsonl.lookup_session(s, "nope", "sample_id").collect()


def test_attribute_dictionary_drops_facet_names(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text('{"canonical": "pull on closure"}\n{"canonical": "material"}\n')
    assert [r.phrase for r in jsonl.read_attribute_dictionary(spark, str(f)).collect()] == ["pull on closure"]


def test_results_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("x", 1.0)], "scenario_type string, mrr double")
    jsonl.write_results(s, s, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/sessions")).count() == 1
    assert spark.read.json(str(tmp_path / "out/summary")).count() == 1
