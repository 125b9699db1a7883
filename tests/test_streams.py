"""Streams over sources of many files, as large tables are: equal to their SQL as well."""

import datetime

import compare
import pytest

from leadloom.plans.queries import ORACLES, QUERIES
from leadloom.plans.views import Tables

STREAMS = ["stream_batch_progress", "stream_quality_alerts", "stream_request_windows", "stream_unprocessed", "stream_metric_windows", "stream_job_completion", "stream_job_progress"]


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_many_files_equals_its_sql(name, spark, small, con, monkeypatch):
    """Each part of the stream is several files that all hold rows of its whole time; none of them is late."""
    plain = Tables.plain
    monkeypatch.setattr(Tables, "plain", lambda self, view: plain(self, view).repartition(5))
    got, want = compare.rows_of(QUERIES[name](spark, small)), compare.oracle_rows(con, ORACLES[name])
    assert got == want


def test_ids_that_come_again_after_the_watermark_are_one_row(spark, monkeypatch):
    rows = [("a", 1, 5, day) for day in (1, 70)] + [("b", 2, 6, 40)]
    table = spark.createDataFrame([(i, f'{{"name":"Acme {c}","phone":"+1-212-{2000000 + p}"}}', False, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)) for i, c, p, day in rows], "id string, raw_data string, is_processed boolean, scraped_at timestamp_ntz")
    monkeypatch.setattr(Tables, "plain", lambda self, view: table)
    assert sorted((r.id, r.name) for r in QUERIES["stream_unprocessed"](spark, "").collect()) == [("a", "Acme 1"), ("b", "Acme 2")]


def test_means_of_windows_that_end_in_half_a_unit(spark, con):
    """29754.6 / 480 is 61.988749999999996 in doubles, but rounds to 61.9888; others, as 72.71375, fall short of the half."""
    from leadloom.streaming import streams as S

    parts = "case when id % 480 < 479 then 60.0 else {0} - 479 * 60.0 end"
    rows = spark.range(480 * 200).selectExpr("id as event_id", "timestamp_seconds(1704067200) as ts", "cast(id div 480 as string) as metric_name", f"cast({parts.format('29754.6 + (id div 480) * 0.024')} as double) as metric_value")
    got = {r.metric_name: r["mean"] for r in S.stream_metric_windows(rows).collect()}
    want = con.sql("SELECT CAST(k AS VARCHAR), round(CAST(29754.6 + k * 0.024 AS DOUBLE) / 480, 4) FROM range(200) g(k)").fetchall()
    assert got == dict(want) and got["0"] == 61.9888
