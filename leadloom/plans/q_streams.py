"""Queries: streams, run to the end over files of the given tables and compared with SQL over the same rows.

Results of windows are those that are final when the stream ends: windows that end at or before the last watermark. Job streams
give every change, of which the last per run is compared.
"""

from __future__ import annotations

from ..streaming import streams as S
from .q_scoring import GRADE, WEIGHTS, _rows, _scores
from .registry import query
from .views import AS_OF

_FINAL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM event_log)"
_TERMINAL = "job_status IN ('success', 'failure')"


def _runs(where: str = "true") -> str:
    """Events by job and run: a run ends where the job's next event is a day or more away."""
    return f"""x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM event_log WHERE {where}),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)"""


_START = "strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS started"
_EACH = "GROUP BY job_id, run"


def _updates(t, make, *columns):
    """The job stream in update mode; of its updates the last of each run, ended or still going."""
    return S.last_updates(S.run_to_end(t.event_log, make, mode="update")).select(*columns)


@query("stream_job_progress", f"""WITH {_runs()}, a AS (SELECT job_id, {_START}, arg_max(job_status, row(ts, event_id)) s, arg_max(current_items, row(ts, event_id)) d, arg_max(total_items, row(ts, event_id)) t, min(ts) a, max(ts) b FROM r {_EACH}),
p AS (SELECT job_id, started, s AS job_status, round(100.0::DOUBLE * d / t, 4) AS percentage, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS elapsed, CASE WHEN d > 0 THEN round((floor(epoch(b)) - floor(epoch(a))) * (t - d) / d, 3) END AS remaining, b FROM a)
SELECT * EXCLUDE (b), strftime(date_trunc('second', b) + to_seconds(CAST(floor(remaining) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS eta FROM p""", "event_log")
def _(t):
    return _updates(t, S.stream_job_progress, "job_id", "started", "job_status", "percentage", "elapsed", "remaining", "eta")


@query("stream_lead_discovery", _scores(WEIGHTS) + f""", g AS (SELECT contact_id, company_id, score_percentage AS score, {GRADE} AS grade FROM s WHERE score_percentage >= 55)
SELECT g.*, concat_ws(': ', CASE WHEN score >= 80 THEN 'hot lead' WHEN score >= 60 THEN 'warm lead' ELSE 'lead' END, industry) AS insight FROM g LEFT JOIN companies ON id = company_id""", "companies contacts")
def _(t):
    contacts, companies = _rows(t)
    return S.run_to_end(contacts, lambda df: S.stream_lead_discovery(df, companies, AS_OF, 55), time="created_at")


@query("stream_job_completion", f"WITH {_runs(_TERMINAL)} SELECT job_id, {_START}, count(*) FILTER (job_status = 'success') AS succeeded, count(*) FILTER (job_status = 'failure') AS failed, CAST(sum(current_items) AS BIGINT) AS items FROM r {_EACH}", "event_log")
def _(t):
    return _updates(t, S.stream_job_completion, "job_id", "started", "succeeded", "failed", "items")


@query("stream_batch_progress", f"WITH {_runs()} SELECT job_id, {_START}, round(max(100.0::DOUBLE * current_items / total_items), 4) AS percentage FROM r {_EACH}", "event_log")
def _(t):
    return _updates(t, S.stream_batch_progress, "job_id", "started", "percentage")


@query("stream_quality_alerts", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) FILTER (NOT success) AS affected FROM event_log GROUP BY date_trunc('day', ts) HAVING count(*) FILTER (NOT success) > 2 AND date_trunc('day', ts) + INTERVAL 1 DAY <= {_FINAL}", "event_log")
def _(t):
    return S.run_to_end(t.event_log, lambda df: S.stream_quality_alerts(df, "1 day", 2))


@query("stream_metric_windows", f"""WITH w AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') AS s FROM event_log)
SELECT metric_name, strftime(s, '%Y-%m-%d %H:%M') AS window_start, round(CAST(sum(CAST(metric_value AS DECIMAL(24,6))) AS DOUBLE) / count(*), 4) AS mean, max(metric_value) AS peak, arg_max(metric_value, row(ts, event_id)) AS last FROM w WHERE s + INTERVAL 5 MINUTE <= {_FINAL} GROUP BY metric_name, s""", "event_log")
def _(t):
    return S.run_to_end(t.event_log, S.stream_metric_windows)


_RULES = (("click", "gt", 100.0), ("purchase", "lte", 5.0), ("error", "gte", 50.0), ("signup", "lt", 3.0))


@query("stream_threshold_alerts", " UNION ALL ".join(f"SELECT event_id, metric_name, '{op}' AS op, {v}::DOUBLE AS threshold, metric_value FROM event_log WHERE metric_name = '{m}' AND metric_value {dict(gt='>', lte='<=', gte='>=', lt='<')[op]} {v}" for m, op, v in _RULES), "event_log")
def _(t):
    rules = t.spark.createDataFrame(_RULES, "metric_name string, op string, threshold double")
    return S.run_to_end(t.event_log, lambda df: S.stream_threshold_alerts(df, rules))


@query("stream_request_windows", f"""WITH w AS (SELECT client_id, time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '2024-01-01') - to_seconds(10 * k) AS s FROM event_log, range(0, 6) g(k))
SELECT client_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) > 1 AS over_limit FROM w WHERE s + INTERVAL 1 MINUTE <= {_FINAL} GROUP BY client_id, s""", "event_log")
def _(t):
    return S.run_to_end(t.event_log, lambda df: S.stream_request_windows(df, 1))


@query("stream_unprocessed", """SELECT DISTINCT id, concat('Acme ', company_id) AS name, concat('+1212', 2000000 + contact_id) AS phone, 'valid' AS phone_status,
round(0.2::DOUBLE + 0.15::DOUBLE * least(1.0::DOUBLE, length(concat('Acme ', company_id)) / 20.0::DOUBLE), 6) AS score FROM scraped_data WHERE NOT is_processed""", "scraped_data")
def _(t):
    """The stream forgets an id after 30 days, so rows of one id that are further apart are made one in the sink's table."""
    return S.run_to_end(t.scraped_data, lambda df: S.stream_unprocessed(df, "30 days"), time="scraped_at").distinct()
