"""The registered queries beside their SQL, at the smallest scale; the full check is checks/compare.py."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.columns == ["slice_id", "topic_id", "rank", "term_id", "p"]
    assert df.count() == 200


@pytest.mark.parametrize(
    "name",
    ["vocabulary", "dtm_transform", "strip_mail", "time_sliced_corpus", "top_words_ties", "metrics_csv", "sinkhorn_plan", "topic_tracks"],
)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) == ""
