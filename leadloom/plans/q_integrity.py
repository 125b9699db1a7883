"""Queries: integrity, maintenance and request-log windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.graph import shared_dir
from ..operators import integrity as I
from ..operators import windows as W
from ..sources import rewrite as R
from .registry import query
from .views import AS_OF

RULES = {
    "name_length": "length(name) BETWEEN 2 AND 255", "email_present": "email IS NOT NULL", "email_form": "email LIKE '%@%'", "score_range": "lead_score BETWEEN 0 AND 95",
    "founded_range": "founded_year BETWEEN 1985 AND 2024", "quality_range": "data_quality_score BETWEEN 0 AND 1", "employees_positive": "employee_count > 0",
}


@query("constraint_violations", " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM companies WHERE NOT ({t})" for n, t in RULES.items()), "companies")
def _(t):
    return I.constraint_violations(t.companies, RULES)


@query("orphan_rows", "SELECT id, company_id FROM scraped_data s WHERE NOT EXISTS (SELECT 1 FROM data_exports d WHERE d.id = s.company_id AND d.status = 'completed')", "scraped_data data_exports")
def _(t):
    return I.orphan_rows(t.scraped_data, t.data_exports.where("status = 'completed'"), "company_id").select("id", "company_id")


@query("cascade_delete", "SELECT 'contacts' AS kind, count(*) AS n, count(company_id) AS with_parent FROM contacts WHERE company_id % 4 <> 1 UNION ALL SELECT 'scraped', count(*), count(CASE WHEN company_id % 4 <> 1 THEN 1 END) FROM scraped_data", "contacts scraped_data")
def _(t):
    gone = t.companies.where("id % 4 = 1").select("id")
    kept = I.cascade_delete(gone, t.contacts, "company_id").select(F.lit("contacts").alias("kind"), "company_id")
    nulled = I.cascade_delete(gone, t.scraped_data, "company_id", "set_null").select(F.lit("scraped").alias("kind"), "company_id")
    return kept.union(nulled).groupBy("kind").agg(F.count("*").alias("n"), F.count("company_id").alias("with_parent"))


@query("unique_violations", "SELECT company_id, department, count(*) AS rows FROM contacts WHERE company_id IS NOT NULL AND department IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1", "contacts")
def _(t):
    return I.unique_violations(t.contacts, ["company_id", "department"])


@query("append_stamped", "SELECT id, CAST(CASE WHEN id >= 1000000 AND id % 2 = 0 THEN TIMESTAMP '2024-04-01' ELSE created_at END AS VARCHAR) AS created_at, CAST(CASE WHEN id >= 1000000 THEN TIMESTAMP '2024-04-01' END AS VARCHAR) AS updated_at FROM (SELECT id, created_at FROM companies UNION ALL SELECT id + 1000000, created_at FROM companies WHERE id <= 50)", "companies")
def _(t):
    c = t.companies.select("id", "created_at")
    new = c.where("id <= 50").select((F.col("id") + 1000000).alias("id"), F.when(F.col("id") % 2 != 0, F.col("created_at")).alias("created_at"))
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return I.append_stamped(c, new, AS_OF).select("id", text("created_at"), text("updated_at"))


@query("upsert_rows", "SELECT id, CASE WHEN id % 10 = 0 THEN 99.5 ELSE lead_score END AS lead_score, CASE WHEN id % 20 = 0 THEN 'Biotech' ELSE industry END AS industry, CASE WHEN id % 10 = 0 THEN '2024-04-01 00:00:00' END AS updated_at FROM companies", "companies")
def _(t):
    c = t.companies.select("id", "lead_score", "industry")
    updates = c.where("id % 10 = 0").select("id", F.lit(99.5).alias("lead_score"), F.when(F.col("id") % 20 == 0, "Biotech").alias("industry"))
    extra = updates.select((-1 - F.col("id")).alias("id"), "lead_score", "industry")
    return I.upsert_rows(c, updates.union(extra), "id", AS_OF).select("id", "lead_score", "industry", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("delete_by_ids", "SELECT id FROM contacts WHERE id % 3 <> 0", "contacts")
def _(t):
    return I.delete_by_ids(t.contacts, t.contacts.where("id % 3 = 0")).select("id")


@query("retention", "SELECT 'companies' AS kind, count(*) AS n FROM companies WHERE created_at >= TIMESTAMP '2024-04-01' - INTERVAL 60 DAY UNION ALL SELECT 'jobs', count(*) FROM scraping_jobs WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND end_time < TIMESTAMP '2024-04-01' - INTERVAL 80 DAY)", "companies scraping_jobs")
def _(t):
    a = I.retention(t.companies, 60, "created_at", AS_OF).select(F.lit("companies").alias("kind"))
    b = I.retention(t.scraping_jobs, 80, "end_time", AS_OF, F.col("status").isin("completed", "failed", "cancelled")).select(F.lit("jobs").alias("kind"))
    return a.union(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("archive_split", "SELECT id, id % 7 = 0 AS archived FROM companies", "companies")
def _(t):
    old, rest = I.archive_split(t.companies, t.companies.where("id % 7 = 0"), AS_OF)
    return old.select("id", F.col("archived_at").isNotNull().alias("archived")).union(rest.select("id", F.lit(False).alias("archived")))


def _stored(t, name):
    """The table as stored files, each time in a folder of its own."""
    path = f"{shared_dir(t.spark).rstrip('/')}/stored-{name}-{uuid.uuid4().hex}"
    R.store(getattr(t, name), path, parts=16)
    return path


@query("stored_upsert", """SELECT id, CASE WHEN id % 100 < 3 THEN 50.5 + id % 100 ELSE lead_score END AS lead_score, CASE WHEN id % 100 = 1 THEN 'Biotech' ELSE industry END AS industry, name,
CASE WHEN id % 100 < 3 THEN '2024-04-01 00:00:00' END AS updated_at FROM companies""", "companies")
def _(t):
    path = _stored(t, "companies")
    some = t.companies.where("id % 100 < 3").select("id", F.lit(1.0).alias("lead_score"), F.when(F.col("id") % 100 == 1, "Biotech").alias("industry"), F.lit(1).alias("turn"))
    again = some.select("id", (50.5 + F.col("id") % 100).alias("lead_score"), F.lit(None).cast("string").alias("industry"), F.lit(2).alias("turn"))
    R.upsert(t.spark, path, some.union(again), "id", AS_OF, order="turn")
    return R.load(t.spark, path).select("id", "lead_score", "industry", "name", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("stored_delete", "SELECT id, name FROM companies WHERE id % 50 <> 7", "companies")
def _(t):
    path = _stored(t, "companies")
    R.delete(t.spark, path, t.companies.where("id % 50 = 7").select("id"))
    return R.load(t.spark, path).select("id", "name")


@query("stored_retention", "SELECT id, status FROM scraping_jobs WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND end_time < TIMESTAMP '2024-04-01' - INTERVAL 80 DAY)", "scraping_jobs")
def _(t):
    path = _stored(t, "scraping_jobs")
    R.retain(t.spark, path, 80, "end_time", AS_OF, "status in ('completed', 'failed', 'cancelled')")
    return R.load(t.spark, path).select("id", "status")


@query("stored_archive", "SELECT id, name, id % 30 = 4 AS archived FROM companies", "companies")
def _(t):
    path = _stored(t, "companies")
    R.archive(t.spark, path, f"{path}-archive", t.companies.where("id % 30 = 4").select("id"), AS_OF)
    old, rest = R.load(t.spark, f"{path}-archive"), R.load(t.spark, path)
    return old.select("id", "name", F.col("archived_at").isNotNull().alias("archived")).union(rest.select("id", "name", F.lit(False)))


@query("batch_status_update", "SELECT CASE WHEN id % 6 = 0 THEN 'cancelled' ELSE status END AS status, count(*) AS jobs FROM scraping_jobs GROUP BY 1", "scraping_jobs")
def _(t):
    return I.batch_status_update(t.scraping_jobs, t.scraping_jobs.where("id % 6 = 0"), {"status": "cancelled"})[0].groupBy("status").agg(F.count("*").alias("jobs"))


@query("batch_status_outcome", "SELECT CASE WHEN id % 2 = 0 THEN id ELSE -id END AS id, CASE WHEN id % 2 = 0 THEN 'updated' ELSE 'not_found' END AS outcome FROM scraping_jobs WHERE id % 6 < 2", "scraping_jobs")
def _(t):
    targets = t.scraping_jobs.where("id % 6 < 2").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"))
    return I.batch_status_update(t.scraping_jobs, targets, {"status": "cancelled"})[1]


def _tables(t):
    return {"companies": t.companies, "contacts": t.contacts, "data_exports": t.data_exports}


_STATS = " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS total, count(CASE WHEN created_at >= TIMESTAMP '2024-04-01' - INTERVAL 7 DAY THEN 1 END) AS recent FROM {n}""" for n in ("companies", "contacts", "data_exports"))
_STATS = f"""SELECT "table", total, recent, round(CASE WHEN total - recent > 0 THEN 100.0 * recent / (total - recent) ELSE 0 END::DOUBLE, 4) AS growth_pct FROM ({_STATS})"""


@query("table_stats", _STATS, "companies contacts data_exports")
def _(t):
    return I.table_stats(_tables(t), AS_OF)


@query("table_counts", " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS rows FROM {n}""" for n in ("companies", "contacts", "scraping_jobs", "scraped_data", "data_exports", "event_log")), "companies contacts scraping_jobs scraped_data data_exports event_log")
def _(t):
    return I.table_counts({n: getattr(t, n) for n in ("companies", "contacts", "scraping_jobs", "scraped_data", "data_exports", "event_log")})


@query("table_advice", f"""WITH s AS ({_STATS}) SELECT "table", 'partition by month' AS advice FROM s WHERE total > 500 UNION ALL SELECT "table", 'plan for growth' FROM s WHERE growth_pct > 5 UNION ALL SELECT "table", 'archive old rows' FROM s WHERE total > 0 AND recent = 0""", "companies contacts data_exports")
def _(t):
    return I.table_advice(I.table_stats(_tables(t), AS_OF), 500, 5.0)


@query("request_limit_audit", f"""
WITH r AS (SELECT event_id, domain, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM event_log),
w AS (SELECT *, count(*) OVER m AS in_minute, count(*) OVER h AS in_hour, min(e) OVER m AS fm, min(e) OVER h AS fh FROM r
  WINDOW m AS (PARTITION BY domain ORDER BY e RANGE BETWEEN 60 PRECEDING AND CURRENT ROW), h AS (PARTITION BY domain ORDER BY e RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, in_minute, in_hour, in_minute > 1 AS over_minute, in_hour > 2 AS over_hour,
  greatest(CASE WHEN in_minute > 1 THEN fm + 60 - e ELSE 0 END, CASE WHEN in_hour > 2 THEN fh + 3600 - e ELSE 0 END) AS wait_seconds FROM w""", "event_log")
def _(t):
    return W.request_limit_audit(t.event_log, 1, 2).select("event_id", "in_minute", "in_hour", "over_minute", "over_hour", "wait_seconds")


@query("failure_backoff", """
WITH r AS (SELECT event_id, domain, ts, success, sum(CAST(success AS INT)) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM event_log),
f AS (SELECT event_id, sum(CAST(NOT success AS INT)) OVER (PARTITION BY domain, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM r)
SELECT event_id, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures = 0 THEN 0 ELSE least(pow(2, failures), 300) END AS BIGINT) AS backoff_seconds FROM f""", "event_log")
def _(t):
    return W.failure_backoff(t.event_log).select("event_id", "failures", "backoff_seconds")


@query("recent_error_rate", """
SELECT event_id, round(avg(CAST(NOT success AS INT)) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS error_rate_10,
round(CAST(sum(CAST(response_ms AS DECIMAL(24,6))) OVER w AS DOUBLE) / count(response_ms) OVER w, 4) AS mean_response_100 FROM event_log WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""", "event_log")
def _(t):
    return W.recent_error_rate(t.event_log).select("event_id", "error_rate_10", "mean_response_100")


_ENDPOINTS = """SELECT domain, endpoint, count(*) AS requests, round(100.0 * count(CASE WHEN success THEN 1 END) / count(*), 4)::DOUBLE AS success_pct, round(CAST(sum(CASE WHEN success THEN CAST(response_ms AS DECIMAL(24,6)) END) AS DOUBLE) / count(CASE WHEN success THEN response_ms END), 4) AS mean_response,
CASE WHEN count(CASE WHEN NOT success THEN 1 END) >= 5 THEN 'blocked' WHEN count(CASE WHEN NOT success THEN 1 END) >= 3 THEN 'failing' ELSE 'active' END AS state FROM event_log GROUP BY domain, endpoint"""


@query("endpoint_stats", _ENDPOINTS, "event_log")
def _(t):
    return W.endpoint_stats(t.event_log)


@query("best_endpoint", f"WITH s AS ({_ENDPOINTS}) SELECT domain, endpoint FROM s QUALIFY row_number() OVER (PARTITION BY domain ORDER BY success_pct DESC, mean_response, endpoint) = 1", "event_log")
def _(t):
    return W.best_endpoint(W.endpoint_stats(t.event_log))
