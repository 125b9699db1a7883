"""Term tables against a search for every term, and percentiles from sketches against exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import analytics as A
from leadloom.operators import select as S
from leadloom.operators import windows as W


def label_by_hand(value, terms, mode, default):
    if value is None:
        return default
    hits = [(rank, t.lower(), label) for t, label, rank in terms if t and (t.lower() == value.lower() if mode == "equals" else t.lower() in value.lower())]
    return min(hits)[2] if hits else default


@pytest.mark.parametrize("bound", [10_000, 0])
def test_terms_equal_a_search_for_each(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "BROADCAST_TERMS", bound)
    rng = random.Random(bound)
    word = lambda n: "".join(rng.choice("abAé .") for _ in range(n))
    terms = [(word(rng.choice([0, 1, 2, 3, 4, 6])), f"l{k}", rng.randrange(5)) for k in range(60)] + [(None, "x", 0), ("", "y", 0), ("zzz", "z", 0)]
    values = [(k, rng.choice([None, "", word(rng.randrange(9)), word(30)]), "old") for k in range(300)] + [(k, "one hot value abab", "old") for k in range(300, 500)]
    df = spark.createDataFrame(values, "id long, v string, label string")
    table = spark.createDataFrame(terms, "term string, label string, rank long")
    for mode in ("equals", "contains"):
        got = {r.id: r.label for r in S.dictionary_lookup(df, "v", table, mode, "none").collect()}
        assert got == {k: label_by_hand(v, terms, mode, "none") for k, v, _ in values}
        assert S.dictionary_lookup(df.limit(0), "v", table, mode).count() == 0
        assert {r.label for r in S.dictionary_lookup(df, "v", table.limit(0), mode, "none").collect()} == {"none"}


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('term', id, ';') as term", "concat('l', id) as label", "id as rank")
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, concat('said TERM', id * 31, '; here'), concat('term', id, if(id % 3 = 1, ';', ''))) as v")
    want = {k: f"l{k * 31}" if k % 3 == 0 and k * 31 < 100_000 else None if k % 3 != 1 else f"l{k}" for k in range(3000)}
    assert {r.id: r.label for r in S.dictionary_lookup(df, "v", terms, "contains").collect()} == want
    assert {r.id: r.label for r in S.dictionary_lookup(df, "v", terms).collect()} == {k: f"l{k}" if k % 3 == 1 else None for k in range(3000)}


def test_percentile_is_within_its_bound(spark):
    rows = spark.range(200_000, numPartitions=7).selectExpr("if(id % 3 = 0, 'hot', concat('d', id % 11)) as domain", "timestamp_seconds(id) as ts", "true as success", "cast(xxhash64(id) % 1000003 as double) as response_ms")
    for accuracy in (100, 10_000):
        got = {r.domain: r.p95_response for r in A.request_metrics(rows, accuracy=accuracy).collect()}
        for r in rows.groupBy("domain").agg(F.sort_array(F.collect_list("response_ms")).alias("x")).collect():
            n, rank = len(r.x), -(-95 * len(r.x) // 100)
            lo, hi = rank - n / accuracy - 1, rank + n / accuracy + 1
            assert r.x[max(0, int(lo) - 1)] <= got[r.domain] <= r.x[min(n - 1, int(hi))]


def test_percentile_is_exact(spark):
    """Between two values, for any accuracy of the cuts; null groups, null and equal responses, NaN, one row, none."""
    rng = random.Random(9)
    rows = [(d, float(rng.choice([rng.randrange(1000), rng.randrange(20), 7])) if rng.random() < 0.9 else None) for d in ["hot"] * 5000 + ["b"] * 37 + [None] * 300 for _ in range(2)]
    rows += [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0), ("odd", float("nan")), ("odd", 1.0), ("odd", float("inf"))]
    df = spark.createDataFrame(rows, "domain string, response_ms double").selectExpr("domain", "response_ms", "true as success", "timestamp_seconds(0) as ts")
    want = {r.domain: r.p for r in df.groupBy("domain").agg(F.round(F.percentile("response_ms", 0.95), 4).alias("p")).collect()}
    assert want["two"] == 1.95
    for accuracy in (1, 10_000):
        got = {r.domain: r.p95_response for r in A.request_metrics(df, accuracy=accuracy).collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    assert A.request_metrics(df.limit(0)).count() == 0


def test_limits_of_a_busy_second_null_keys_and_null_times(spark):
    rng = random.Random(4)
    seconds = [100, 160, 161, 3599, 3600, 3700, 7200, 7201, 90_000]
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([100, 100, 100, *seconds, None])) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, domain string, at long").selectExpr("event_id", "domain", "cast(timestamp_seconds(at) as timestamp_ntz) as ts", "at", "'mine' as in_hour")
    got = W.request_limit_audit(df, 40, 70).collect()
    assert len(got) == 400
    for r in got:
        near = lambda span: [a for _, d, a in rows if d == r.domain and (a is None if r.at is None else a is not None and r.at - span <= a <= r.at)]
        minute, hour = near(60), near(3600)
        assert (r.in_minute, r.in_hour, r.over_minute, r.over_hour) == (len(minute), len(hour), len(minute) > 40, len(hour) > 70)
        if r.at is not None:
            waits = [min(minute) + 60 - r.at if len(minute) > 40 else 0, min(hour) + 3600 - r.at if len(hour) > 70 else 0]
            assert r.wait_seconds == max(waits)
    assert W.request_limit_audit(df.limit(0)).count() == 0
