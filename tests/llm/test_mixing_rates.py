"""Rates far above one reach their targets."""

import pytest

from leadloom.llm import mixing


def test_a_small_source_reaches_its_target(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', 100) as text", "if(id < 10, 'small', 'big') as source")
    rates = mixing.source_rates(docs, power=0.0)
    assert {r.source: r.rate for r in rates.collect()}["small"] == 100.0
    got = {r.source: r["count"] for r in mixing.mixed(docs, rates).groupBy("source").count().collect()}
    assert 850 < got["small"] < 1150 and 850 < got["big"] < 1150


@pytest.mark.parametrize("rate", [100.0, 1500.0])
def test_rates_of_a_caller_are_drawn_whole(spark, rate):
    docs = spark.range(100).selectExpr("id as doc_id", "'x' as text", "'s' as source")
    counts = [r.n_copies for r in mixing.mixed(docs, spark.createDataFrame([("s", rate)], "source string, rate double")).where("copy = 0").collect()]
    mean = sum(counts) / 100
    assert abs(mean - rate) < 0.5 * rate**0.5 and 0.5 * rate < sum((n - mean) ** 2 for n in counts) / 99 < 1.7 * rate
