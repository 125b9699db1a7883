"""Queries: aggregates and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .registry import query
from .views import AS_OF


def avg(x: str, places: int = 4, scale: int = 6) -> str:
    return f"round(CAST(sum(CAST({x} AS DECIMAL(24,{scale}))) AS DOUBLE) / count({x}), {places})"


def pct(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) * 100.0 / {whole} ELSE 0 END, 4)"


def cnt(test: str) -> str:
    return f"count(CASE WHEN {test} THEN 1 END)"


def has(x: str) -> str:
    return f"(trim(coalesce(CAST({x} AS VARCHAR), '')) <> '')"


def comp(fields) -> str:
    return "(100.0::DOUBLE * (" + " + ".join(f"CAST({has(f)} AS INT)" for f in fields) + f") / {len(fields)})"


HOURS = "((epoch(end_time) - epoch(start_time)) / 3600.0)"
DAY = "strftime(created_at, '%Y-%m-%d')"
NEW = "created_at >= TIMESTAMP '2024-04-01' - INTERVAL 1 DAY"
SIGNALS = "(CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(id % 5 = 0 AS INT))"


@query("dashboard", f"""
SELECT unnest(['total_leads', 'new_today', 'qualified', 'qualified_pct']) AS metric, unnest([n, d, q, p]) AS value FROM (SELECT CAST(count(*) AS DOUBLE) n, CAST({cnt(NEW)} AS DOUBLE) d, CAST({cnt('lead_score >= 70')} AS DOUBLE) q, {pct(cnt('lead_score >= 70'), 'count(*)')} p FROM companies)
UNION ALL SELECT 'total_contacts', CAST(count(*) AS DOUBLE) FROM contacts
UNION ALL (SELECT 'industry:' || industry, CAST(count(*) AS DOUBLE) FROM companies WHERE industry IS NOT NULL GROUP BY industry ORDER BY count(*) DESC, industry LIMIT 10)""", "companies contacts")
def _(t):
    return A.dashboard(t.companies, t.contacts, AS_OF)


_TREND = f"SELECT {DAY} AS day, count(*) AS leads FROM companies WHERE created_at >= TIMESTAMP '2024-04-01' - INTERVAL 30 DAY GROUP BY 1"


@query("trend_daily", _TREND, "companies")
def _(t):
    return A.trend_daily(t.companies, 30, AS_OF)


@query("trend_growth", f"""WITH d AS ({_TREND}), n AS (SELECT leads, row_number() OVER (ORDER BY day) r, count(*) OVER () c FROM d)
SELECT CAST(coalesce(sum(leads), 0) AS BIGINT) AS total, round(sum(leads) / count(*)::DOUBLE, 4) AS mean_per_day, round(CASE WHEN avg(leads) FILTER (r <= c // 2) > 0 THEN 100.0 * (avg(leads) FILTER (r > c // 2) - avg(leads) FILTER (r <= c // 2)) / avg(leads) FILTER (r <= c // 2) ELSE 0 END, 4) AS growth_pct FROM n""", "companies")
def _(t):
    return A.trend_growth(A.trend_daily(t.companies, 30, AS_OF))


@query("trend_score", f"SELECT {DAY} AS day, {avg('lead_score')} AS average_score, count(lead_score) AS scored FROM companies GROUP BY 1", "companies")
def _(t):
    return A.trend_score(t.companies)


@query("trend_signals", f"SELECT {DAY} AS day, CAST(sum({SIGNALS}) AS BIGINT) AS signals FROM companies GROUP BY 1", "companies")
def _(t):
    return A.trend_signals(t.companies)


_DONE = "status = 'completed'"


@query("job_performance", f"""SELECT count(*) AS total, {cnt(_DONE)} AS completed, {cnt("status = 'failed'")} AS failed, {cnt("status = 'running'")} AS running, {pct(cnt(_DONE), 'count(*)')} AS success_pct,
round(avg(CASE WHEN {_DONE} THEN {HOURS} END), 4) AS mean_hours, {cnt("start_time >= TIMESTAMP '2024-04-01' - INTERVAL 1 DAY")} AS last_day, {pct('sum(processed_targets)', 'sum(total_targets)')} AS targets_pct,
round(CAST(sum(CASE WHEN {_DONE} THEN companies_found END) AS DOUBLE) / {cnt(_DONE)}, 4) AS leads_per_job FROM scraping_jobs""", "scraping_jobs")
def _(t):
    return A.job_performance(t.scraping_jobs, AS_OF)


@query("export_stats", f"""SELECT count(*) AS total, {cnt("status = 'completed'")} AS completed, {cnt("status = 'failed'")} AS failed, {cnt("status = 'pending'")} AS pending, {cnt(NEW)} AS today, CAST(sum(total_records) AS BIGINT) AS records, {pct(cnt("status = 'completed'"), 'count(*)')} AS success_pct FROM data_exports""", "data_exports")
def _(t):
    return A.export_stats(t.data_exports, AS_OF)


@query("job_summary", f"SELECT status, count(*) AS jobs, CAST(sum(companies_found) AS BIGINT) AS companies, CAST(sum(contacts_found) AS BIGINT) AS contacts, round(avg({HOURS}), 4) AS mean_hours FROM scraping_jobs GROUP BY status", "scraping_jobs")
def _(t):
    return A.job_summary(t.scraping_jobs)


@query("lead_summary_by_job", f"""WITH n AS (SELECT job_id, count(*) l, {cnt("validation_status = 'valid'")} v FROM scraped_data GROUP BY 1)
SELECT id, coalesce(l, 0) AS leads, coalesce(v, 0) AS valid, {pct('coalesce(v, 0)', 'coalesce(l, 0)')} AS success_pct, round({HOURS}, 4) AS hours FROM scraping_jobs LEFT JOIN n ON id = job_id""", "scraping_jobs scraped_data")
def _(t):
    return A.lead_summary_by_job(t.scraping_jobs, t.scraped_data)


@query("lead_quality_3", f"SELECT count(*) AS total, {cnt('lead_score >= 80')} AS high, {cnt('lead_score >= 50 AND lead_score < 80')} AS medium, {cnt('lead_score < 50')} AS low, {cnt('lead_score IS NULL')} AS unscored, {avg('lead_score')} AS average FROM companies", "companies")
def _(t):
    return A.lead_quality_3(t.companies)


@query("lead_quality_hot", f"SELECT count(lead_score) AS scored, {cnt('lead_score >= 80')} AS hot, {cnt('lead_score >= 60 AND lead_score < 80')} AS warm, {cnt('lead_score < 60')} AS cold, {avg('lead_score')} AS average FROM companies", "companies")
def _(t):
    return A.lead_quality_hot(t.companies)


@query("score_distribution", "SELECT CASE WHEN lead_score >= 80 THEN 'Hot' WHEN lead_score >= 60 THEN 'Warm' WHEN lead_score >= 40 THEN 'Cold' ELSE 'Poor' END AS band, count(*) AS count FROM companies WHERE lead_score IS NOT NULL GROUP BY 1", "companies")
def _(t):
    return A.score_distribution(t.companies)


@query("score_histogram", "SELECT CASE WHEN lead_score <= 25 THEN '0-25' WHEN lead_score <= 50 THEN '26-50' WHEN lead_score <= 75 THEN '51-75' ELSE '76-100' END AS band, count(*) AS count FROM companies WHERE lead_score IS NOT NULL GROUP BY 1", "companies")
def _(t):
    return A.score_histogram(t.companies)


@query("contact_insights", f"SELECT count(*) AS total, {cnt('is_verified')} AS verified, {cnt('is_decision_maker')} AS decision_makers, {cnt(has('email'))} AS with_email, {cnt(has('phone'))} AS with_phone, {cnt(has('linkedin_url'))} AS with_linkedin, count(DISTINCT job_title) AS titles, round(avg(experience_years), 4) AS mean_experience FROM contacts", "contacts")
def _(t):
    return A.contact_insights(t.contacts)


@query("contact_rates", f"SELECT count(*) AS total, {pct(cnt(has('email')), 'count(*)')} AS email_pct, {pct(cnt(has('phone')), 'count(*)')} AS phone_pct FROM contacts", "contacts")
def _(t):
    return A.contact_rates(t.contacts)


@query("industry_breakdown", " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'Unknown') AS value, count(*) AS count FROM companies GROUP BY 2" for c in ("industry", "company_size", "revenue_range")), "companies")
def _(t):
    return A.industry_breakdown(t.companies)


_TECH = f"SELECT technology, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM companies WHERE technologies_csv IS NOT NULL)')} AS adoption_pct FROM (SELECT unnest(string_split(technologies_csv, ',')) AS technology FROM companies) GROUP BY 1"


@query("technology_counts", _TECH, "companies")
def _(t):
    return A.technology_counts(t.companies)


@query("technology_emerging", f"WITH t AS ({_TECH}) SELECT * FROM t WHERE adoption_pct BETWEEN 5 AND 20 ORDER BY count DESC, technology LIMIT 10", "companies")
def _(t):
    return A.technology_emerging(A.technology_counts(t.companies))


@query("technology_combos", "SELECT array_to_string(list_sort(list_slice(string_split(technologies_csv, ','), 1, 3)), ' + ') AS combo, count(*) AS count FROM companies WHERE len(string_split(technologies_csv, ',')) >= 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "companies")
def _(t):
    return A.technology_combos(t.companies)


@query("comprehensive", f"""SELECT 'leads' AS metric, coalesce(industry, 'Unknown') AS "group", CAST(count(*) AS DOUBLE) AS value FROM companies WHERE created_at < TIMESTAMP '2024-03-01' GROUP BY 2
UNION ALL SELECT 'average_score', coalesce(industry, 'Unknown'), {avg('lead_score')} FROM companies WHERE created_at < TIMESTAMP '2024-03-01' GROUP BY 2""", "companies")
def _(t):
    return A.comprehensive(t.companies, t.contacts, t.scraping_jobs, ("leads", "average_score", "jobs"), "industry", end="2024-03-01 00:00:00")


@query("comprehensive_weekly", f"""SELECT 'qualified' AS metric, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS "group", CAST({cnt('lead_score >= 50')} AS DOUBLE) AS value FROM companies GROUP BY 2
UNION ALL SELECT 'contacts', strftime(date_trunc('week', created_at), '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM contacts GROUP BY 2
UNION ALL SELECT 'jobs', strftime(date_trunc('week', start_time), '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM scraping_jobs GROUP BY 2""", "companies contacts scraping_jobs")
def _(t):
    return A.comprehensive(t.companies, t.contacts, t.scraping_jobs, ("qualified", "contacts", "jobs"), "week")


@query("conversion_rates", f"SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS period, count(*) AS leads, {cnt('lead_score >= 50')} AS qualified, {cnt('lead_score >= 80')} AS high, {pct(cnt('lead_score >= 50'), 'count(*)')} AS qualified_pct, {pct(cnt('lead_score >= 80'), 'count(*)')} AS high_pct FROM companies GROUP BY 1", "companies")
def _(t):
    return A.conversion_rates(t.companies, "month")


@query("conversion_funnel", f"""WITH k AS (SELECT company_id, bool_or(is_verified AND is_decision_maker) d FROM contacts GROUP BY 1),
a AS (SELECT count(*) n1, count(lead_score) n2, {cnt('lead_score >= 50')} n3, {cnt('lead_score >= 50 AND company_id IS NOT NULL')} n4, {cnt('lead_score >= 50 AND d')} n5 FROM companies LEFT JOIN k ON id = company_id)
SELECT 'all' AS stage, 1 AS position, n1 AS companies, 100.0::DOUBLE AS pct_of_previous FROM a UNION ALL SELECT 'scored', 2, n2, {pct('n2', 'n1')} FROM a UNION ALL SELECT 'qualified', 3, n3, {pct('n3', 'n2')} FROM a
UNION ALL SELECT 'contacted', 4, n4, {pct('n4', 'n3')} FROM a UNION ALL SELECT 'decision', 5, n5, {pct('n5', 'n4')} FROM a""", "companies contacts")
def _(t):
    return A.conversion_funnel(t.companies, t.contacts)


def _dq(table: str, fields) -> str:
    return f"SELECT count(*) AS total, {', '.join(f'{cnt(has(f))} AS with_{f}' for f in fields)}, {avg(comp(fields), 4, 8)} AS completeness, CAST(floor({avg(comp(fields), 8, 8)}) AS BIGINT) AS completeness_int FROM {table}"


@query("data_quality_companies", _dq("companies", A.COMPANY_FIELDS), "companies")
def _(t):
    return A.data_quality(t.companies, A.COMPANY_FIELDS)


@query("data_quality_contacts", _dq("contacts", A.CONTACT_FIELDS), "contacts")
def _(t):
    return A.data_quality(t.contacts, A.CONTACT_FIELDS)


@query("data_quality_overall", f"WITH a AS (SELECT {avg(comp(A.COMPANY_FIELDS), 4, 8)} c FROM companies), b AS (SELECT {avg(comp(A.CONTACT_FIELDS), 4, 8)} p FROM contacts) SELECT c AS companies, p AS contacts, round((c + p) / 2, 4) AS overall FROM a, b", "companies contacts")
def _(t):
    return A.data_quality_overall(t.companies, t.contacts)


_INSIGHT = f"""WITH k AS (SELECT company_id, count(*) n, {cnt('is_decision_maker')} d, {cnt('is_verified')} v, {avg('contact_quality_score', 9)} q, {avg('engagement_potential', 9)} e FROM contacts GROUP BY 1)
SELECT id, coalesce(n, 0) AS n_contacts, coalesce(d, 0) AS decision_makers, coalesce(v, 0) AS verified, CAST(coalesce(len(string_split(technologies_csv, ',')), 0) AS BIGINT) AS n_technologies, CAST({SIGNALS} AS BIGINT) AS n_signals@MORE FROM companies LEFT JOIN k ON id = company_id"""


@query("lead_insights", _INSIGHT.replace("@MORE", ""), "companies contacts")
def _(t):
    return A.lead_insights(t.companies, t.contacts)


@query("lead_insights_detail", _INSIGHT.replace("@MORE", ", q AS mean_quality, e AS mean_engagement"), "companies contacts")
def _(t):
    return A.lead_insights(t.companies, t.contacts, detail=True)


@query("lead_recommendations", f"""WITH i AS ({_INSIGHT.replace('@MORE', ', lead_score')}) SELECT id, concat_ws(' | ', CASE WHEN lead_score >= 80 THEN 'High-priority lead: contact at once' END, CASE WHEN lead_score >= 60 AND lead_score < 80 THEN 'Good lead: schedule a follow-up' END,
CASE WHEN coalesce(lead_score, 0) < 60 THEN 'Nurture with content' END, CASE WHEN decision_makers > 0 THEN 'Reach out to the decision makers' END, CASE WHEN n_contacts = 0 THEN 'Find contacts' END, CASE WHEN n_signals > 0 THEN 'Mention recent growth' END) AS recommendations FROM i""", "companies contacts")
def _(t):
    rows = A.lead_insights(t.companies, t.contacts).join(t.companies.select("id", "lead_score"), "id")
    return A.lead_recommendations(rows).select("id", F.array_join("recommendations", " | ").alias("recommendations"))


@query("seniority_by_company", "WITH n AS (SELECT company_id, coalesce(seniority_level, 'Unknown') s, count(*) n FROM contacts GROUP BY 1, 2) SELECT company_id, string_agg(s || '=' || n, ',' ORDER BY s) AS seniority FROM n GROUP BY 1", "contacts")
def _(t):
    rows = A.seniority_by_company(t.contacts)
    return rows.select("company_id", F.array_join(F.transform(F.array_sort(F.map_entries("seniority")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("seniority"))


@query("department_share", "SELECT company_id, coalesce(department, 'Unknown') AS department, count(*) AS contacts, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY company_id), 4)::DOUBLE AS share_pct FROM contacts GROUP BY 1, 2", "contacts")
def _(t):
    return A.department_share(t.contacts)


@query("lead_completeness", f"""WITH k AS (SELECT company_id, CAST(sum(CAST({comp(A.CONTACT_FIELDS)} AS DECIMAL(24,8))) AS DOUBLE) / count(*) p FROM contacts GROUP BY 1), c AS (SELECT id, {comp(('name', 'website', 'industry', 'company_size', 'description', 'phone'))} c FROM companies)
SELECT id, round(c, 4) AS company_pct, round(coalesce(p, 0), 4) AS contact_pct, round((c + coalesce(p, 0)) / 2, 4) AS overall_pct FROM c LEFT JOIN k ON id = company_id""", "companies contacts")
def _(t):
    return A.lead_completeness(t.companies, t.contacts)


@query("lead_list_summary", f"SELECT count(*) AS leads, {avg('lead_score')} AS average_score, string_agg(DISTINCT industry, ',' ORDER BY industry) AS industries, string_agg(DISTINCT company_size, ',' ORDER BY company_size) AS sizes FROM companies", "companies")
def _(t):
    return A.lead_list_summary(t.companies)


@query("job_type_stats", f"""SELECT job_type, count(*) AS submitted, {cnt("status = 'completed'")} AS completed, {cnt("status = 'failed'")} AS failed, {cnt("status = 'cancelled'")} AS cancelled, round(avg(CASE WHEN status = 'completed' THEN {HOURS} END), 4) AS mean_hours FROM scraping_jobs GROUP BY 1""", "scraping_jobs")
def _(t):
    return A.job_type_stats(t.scraping_jobs)


@query("job_status_counts", "SELECT s AS status, count(id) AS jobs FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) s) LEFT JOIN scraping_jobs ON s = status GROUP BY s", "scraping_jobs")
def _(t):
    return A.job_status_counts(t.scraping_jobs)


@query("query_results", f"""SELECT source_type, count(*) AS found, {cnt("validation_status = 'valid'")} AS scraped, {cnt("validation_status = 'invalid'")} AS failed FROM scraped_data GROUP BY 1""", "scraped_data")
def _(t):
    return A.query_results(t.scraped_data)


@query("request_metrics", f"""SELECT domain, count(*) AS requests, {pct(cnt('NOT success'), 'count(*)')} AS error_pct, {avg('response_ms')} AS mean_response, round(quantile_cont(response_ms, 0.95), 4) AS p95_response,
round(count(*) / ((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600.0), 4) AS per_hour FROM event_log GROUP BY 1""", "event_log")
def _(t):
    return A.request_metrics(t.event_log)


@query("metric_trends", f"SELECT metric_name, {avg('metric_value')} AS mean, max(metric_value) AS peak, arg_max(metric_value, row(ts, event_id)) AS latest FROM event_log WHERE ts > TIMESTAMP '2024-04-01' - INTERVAL 1680 HOUR AND ts <= TIMESTAMP '2024-04-01' GROUP BY 1", "event_log")
def _(t):
    return A.metric_trends(t.event_log, 1680, AS_OF)


LIMITS = {"click": 20.0, "error": 60.0, "purchase": 30.0, "signup": 45.0}


@query("health_score", f"""WITH m AS (SELECT metric_name, {avg('metric_value', 9)} v FROM event_log GROUP BY 1), l AS (SELECT unnest({list(LIMITS)}) n, unnest({list(LIMITS.values())}) x),
s AS (SELECT CAST(greatest(0, 100 - coalesce(sum(CASE WHEN v > 2 * x THEN 20 WHEN v > x THEN 10 ELSE 0 END), 0)) AS BIGINT) score FROM m JOIN l ON metric_name = n)
SELECT score, CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'degraded' ELSE 'unhealthy' END AS band FROM s""", "event_log")
def _(t):
    return A.health_score(t.event_log, LIMITS)


@query("daily_report", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, {avg('response_ms')} AS mean_response, max(response_ms) AS peak_response, {pct(cnt('NOT success'), 'count(*)')} AS error_pct, {cnt('response_ms > 100')} AS alerts, round(100 - {pct(cnt('NOT success'), 'count(*)')} / 2, 4) AS score FROM event_log GROUP BY 1", "event_log")
def _(t):
    return A.daily_report(t.event_log, 100.0)


@query("job_quality_metrics", f"""WITH c AS (SELECT DISTINCT s.job_id, c.id, lead_score FROM scraped_data s JOIN companies c ON c.id = s.company_id), k AS (SELECT DISTINCT s.job_id, k.id, k.email, k.phone FROM scraped_data s JOIN contacts k ON k.id = s.contact_id),
a AS (SELECT job_id, {avg('lead_score')} average_score, {cnt('lead_score >= 80')} high, {cnt('lead_score >= 50 AND lead_score < 80')} medium FROM c GROUP BY 1), b AS (SELECT job_id, count(*) n_contacts, {pct(cnt(has('email')), 'count(*)')} email_pct, {pct(cnt(has('phone')), 'count(*)')} phone_pct FROM k GROUP BY 1)
SELECT j.id AS job_id, average_score, high, medium, n_contacts, email_pct, phone_pct FROM scraping_jobs j LEFT JOIN a ON a.job_id = j.id LEFT JOIN b ON b.job_id = j.id""", "scraping_jobs scraped_data companies contacts")
def _(t):
    return A.job_quality_metrics(t.scraping_jobs, t.scraped_data, t.companies, t.contacts)


@query("lead_sources", """WITH p AS (SELECT company_id, source_type s, count(*) n, count(DISTINCT job_id) j, strftime(min(scraped_at), '%Y-%m-%d') a, strftime(max(scraped_at), '%Y-%m-%d') b FROM scraped_data GROUP BY 1, 2)
SELECT company_id, string_agg(concat_ws(':', s, n, j, a, b), ',' ORDER BY s) AS sources FROM p GROUP BY 1""", "scraped_data")
def _(t):
    return A.lead_sources(t.scraped_data).select("company_id", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source_type"], s["rows"], s["jobs"], s["first"], s["last"])), ",").alias("sources"))


@query("business_metrics", f"""SELECT 'hour' AS kind, strftime(created_at, '%Y-%m-%d %H:00') AS "group", count(*) AS leads, {avg('lead_score')} AS average_score, CAST(NULL AS DOUBLE) AS success_pct FROM companies GROUP BY 2
UNION ALL SELECT 'source', source_type, count(*), NULL, {pct(cnt("validation_status = 'valid'"), 'count(*)')} FROM scraped_data GROUP BY 2""", "companies scraped_data")
def _(t):
    return A.business_metrics(t.companies, t.scraped_data)
