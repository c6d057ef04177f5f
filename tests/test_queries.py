"""Every registered query with checking SQL, compared at the smallest scale."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from parley.plans import queries, scale  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.engine(D)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert check.compare(spark, con, name, D).startswith("ok")


@pytest.mark.parametrize("name", ["bm25_search", "phrase_df", "rung_bag", "long_phrase_df", "mine_phrases"])
def test_few_phrases_write_no_index_of_long_texts(spark, name):
    queries.forget()
    before = set(glob.glob(f"{scale.work_folder(spark)}/index-*"))
    assert entry.queries()[name](spark, D).count() > 0
    assert set(glob.glob(f"{scale.work_folder(spark)}/index-*")) == before


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "item_id", "rank", "rank_score"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
