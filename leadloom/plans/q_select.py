"""Queries: filters, search, sorting, paging, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..sources import grams as G
from ..sources import paged as PG
from .registry import query

HOST = "nullif(regexp_replace(regexp_extract(lower(trim({0})), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\\.', ''), '')"


@query("filter_dict", "SELECT id, name, lead_score FROM companies WHERE industry IN ('Finance', 'Retail') AND lead_score >= 20 AND lead_score < 90 AND contains(lower(name), 'globex')", "companies")
def _(t):
    return S.filter_dict(t.companies, {"industry": ["Finance", "Retail"], "lead_score": {"gte": 20, "lt": 90}, "name": {"ilike": "GLOBEX"}, "email": None}).select("id", "name", "lead_score")


@query("lead_filters", "SELECT id, industry, city, lead_score FROM companies WHERE contains(lower(industry), 'fin') AND contains(lower(city), 'a') AND lead_score BETWEEN 10 AND 80", "companies")
def _(t):
    return S.lead_filters(t.companies, industry="fin", location="A", min_score=10, max_score=80).select("id", "industry", "city", "lead_score")


@query("lead_search_filters", """
SELECT id, name FROM companies c WHERE industry IN ('Finance', 'Automotive') AND list_has_any(string_split(technologies_csv, ','), ['Python', 'PHP']) AND data_quality_score >= 0.2
AND employee_count <= 1200 AND (id % 2 = 0 OR id % 3 = 0) AND trim(coalesce(website, '')) <> ''
AND EXISTS (SELECT 1 FROM contacts k WHERE k.company_id = c.id AND is_decision_maker AND contact_quality_score >= 0.1 AND (contains(lower(job_title), 'chief') OR contains(lower(job_title), 'lead')))""", "companies contacts")
def _(t):
    return S.lead_search_filters(t.companies, t.contacts, {
        "industries": ["Finance", "Automotive"], "technologies": ["Python", "PHP"], "min_quality": 0.2, "max_employees": 1200, "growth_signals": ["hiring", "funding"],
        "has_website": True, "decision_makers": True, "min_contact_quality": 0.1, "contact_titles": ["chief", "lead"],
    }).select("id", "name")


@query("scrape_target_filters", f"""
SELECT id, name, website FROM companies WHERE (contains(lower(name), 'globex') OR coalesce(contains(lower(description), 'scaling'), false)) AND employee_count >= 100 AND founded_year > 1990
AND {HOST.format("website")} IS DISTINCT FROM 'globex3.com'""", "companies")
def _(t):
    gone = t.spark.createDataFrame([("https://www.globex3.com/",)], "domain string")
    return S.scrape_target_filters(t.companies, {"keywords": ["globex", "scaling"], "min_employees": 100, "founded_after": 1990}, gone).select("id", "name", "website")


@query("search_companies", f"SELECT id, name FROM companies WHERE created_by = 3 AND (contains(lower(name), 'site') OR coalesce(contains({HOST.format('website')}, 'site'), false))", "companies")
def _(t):
    return S.search_companies(t.companies, 3, "Site").select("id", "name")


@query("search_contacts", "SELECT id, last_name, email FROM contacts WHERE created_by = 2 AND (contains(lower(first_name), 'lee1') OR contains(lower(last_name), 'lee1') OR coalesce(contains(lower(email), 'lee1'), false))", "contacts")
def _(t):
    return S.search_contacts(t.contacts, 2, "LEE1").select("id", "last_name", "email")


@query("indexed_search_companies", f"SELECT id, name FROM companies WHERE created_by = 2 AND (contains(lower(name), 'globex 1') OR coalesce(contains({HOST.format('website')}, 'globex 1'), false))", "companies")
def _(t):
    return G.search_companies(t.spark, G.index_companies(t.companies.select("id", "name", "website", "created_by"), parts=8), 2, "Globex 1").select("id", "name")


@query("indexed_search_contacts", "SELECT id, last_name, email FROM contacts WHERE created_by = 2 AND (contains(lower(first_name), 'lee1') OR contains(lower(last_name), 'lee1') OR coalesce(contains(lower(email), 'lee1'), false))", "contacts")
def _(t):
    rows = t.contacts.select("id", "first_name", "last_name", "email", "created_by")
    return G.search_contacts(t.spark, G.index_contacts(rows, parts=8), 2, "LEE1").select("id", "last_name", "email")


@query("search_leads", """
SELECT c.id, name, industry, lead_score, count(k.id) AS contact_count, city, c.created_at FROM companies c LEFT JOIN contacts k ON k.company_id = c.id
WHERE contains(lower(industry), 'e') AND lead_score >= 30 GROUP BY ALL ORDER BY lead_score DESC NULLS LAST, c.created_at DESC, c.id LIMIT 50 OFFSET 10""", "companies contacts")
def _(t):
    return S.search_leads(t.companies, t.contacts, industry="e", min_score=30, limit=50, offset=10)


@query("companies_by_industry", "SELECT id, name FROM companies WHERE industry = 'Finance'", "companies")
def _(t):
    return S.filter_dict(t.companies, {"industry": "Finance"}).select("id", "name")


@query("contacts_by_company", "SELECT id, company_id FROM contacts WHERE company_id IN (1, 2, 4, 5, 7, 8)", "contacts")
def _(t):
    return S.filter_dict(t.contacts, {"company_id": [1, 2, 4, 5, 7, 8]}).select("id", "company_id")


@query("jobs_by_status", "SELECT id, job_name, status FROM scraping_jobs WHERE created_by = 1 AND status IN ('pending', 'running')", "scraping_jobs")
def _(t):
    return S.filter_dict(S.tenant_scope(t.scraping_jobs, 1), {"status": ["pending", "running"]}).select("id", "job_name", "status").orderBy("id")


@query("scraped_by_job", "SELECT id, job_id FROM scraped_data WHERE job_id <= 20 AND validation_status = 'valid'", "scraped_data")
def _(t):
    return S.filter_dict(t.scraped_data, {"job_id": {"lte": 20}, "validation_status": "valid"}).select("id", "job_id")


@query("unprocessed_scraped", "SELECT id, job_id, source_type FROM scraped_data WHERE NOT is_processed", "scraped_data")
def _(t):
    return S.filter_dict(t.scraped_data, {"is_processed": False}).select("id", "job_id", "source_type")


@query("exports_by_status", "SELECT id, export_type FROM data_exports WHERE created_by = 2 AND status = 'completed'", "data_exports")
def _(t):
    return S.filter_dict(S.tenant_scope(t.data_exports, 2), {"status": "completed"}).select("id", "export_type")


@query("user_activity_feed", "SELECT event_id, client_id, metric_name FROM event_log WHERE client_id < 40 AND metric_name = 'click'", "event_log")
def _(t):
    return S.filter_dict(t.event_log, {"client_id": {"lt": 40}, "metric_name": "click"}).orderBy(F.col("ts").desc(), "event_id").select("event_id", "client_id", "metric_name")


@query("metrics_range", "SELECT event_id, metric_value FROM event_log WHERE metric_name = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'", "event_log")
def _(t):
    return S.metrics_range(t.event_log, "purchase", "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("event_id", "metric_value")


@query("tenant_scope", "SELECT k.id, k.company_id FROM contacts k WHERE EXISTS (SELECT 1 FROM companies c WHERE c.id = k.company_id AND c.created_by = 4)", "companies contacts")
def _(t):
    return S.tenant_scope(t.contacts, 4, t.companies, "company_id").select("id", "company_id")


@query("semi_scoped", "SELECT s.id, s.job_id FROM scraped_data s WHERE EXISTS (SELECT 1 FROM scraping_jobs j WHERE j.id = s.job_id AND j.created_by = 5)", "scraped_data scraping_jobs")
def _(t):
    return S.semi_scoped(t.scraped_data, t.scraping_jobs, "job_id", 5).select("id", "job_id")


_QUERIES = "SELECT id, CASE id % 5 WHEN 0 THEN concat('LinkedIn founders ', id) WHEN 1 THEN concat('plumbers on Google ', id) WHEN 2 THEN website WHEN 3 THEN 'x' ELSE concat('credit card list ', id) END AS query FROM companies"


def _queries(t):
    c = F.col("id").cast("string")
    at = lambda n: F.col("id") % 5 == n
    return t.companies.select("id", F.when(at(0), F.concat(F.lit("LinkedIn founders "), c)).when(at(1), F.concat(F.lit("plumbers on Google "), c)).when(at(2), F.col("website")).when(at(3), "x").otherwise(F.concat(F.lit("credit card list "), c)).alias("query"))


@query("classify_query_source", f"""WITH q AS ({_QUERIES}) SELECT CASE WHEN contains(lower(query), 'linkedin') THEN 'linkedin' WHEN contains(lower(query), 'google') OR contains(lower(query), 'maps') THEN 'google_my_business'
WHEN contains(lower(query), 'website') OR contains(lower(query), 'http') OR contains(lower(query), 'www') OR contains(lower(query), '.com') THEN 'website' ELSE 'google_my_business' END AS source, count(*) AS queries FROM q GROUP BY 1""", "companies")
def _(t):
    return S.classify_query_source(_queries(t)).groupBy("source").agg(F.count("*").alias("queries"))


@query("query_screen", f"WITH q AS ({_QUERIES}) SELECT id, query FROM q WHERE length(trim(query)) >= 2 AND NOT contains(lower(query), 'credit card') AND NOT contains(lower(query), 'password') AND NOT contains(lower(query), 'ssn')", "companies")
def _(t):
    return S.query_screen(_queries(t))


@query("sort_by", "SELECT id, lead_score FROM companies ORDER BY lead_score DESC NULLS LAST, id", "companies")
def _(t):
    return S.sort_by(t.companies, "lead_score", "desc").select("id", "lead_score")


@query("page", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS page, 2 < ceil(count(*) / 20.0) AS has_next, true AS has_prev, CASE WHEN 2 < ceil(count(*) / 20.0) THEN CAST(3 AS BIGINT) END AS next_page, CAST(1 AS BIGINT) AS prev_page FROM companies", "companies")
def _(t):
    return S.page(t.companies, 2, 20)[1]


@query("page_rows", "SELECT id, name FROM companies ORDER BY id LIMIT 20 OFFSET 20", "companies")
def _(t):
    return S.page(t.companies, 2, 20)[0].select("id", "name")


@query("indexed_page_rows", "SELECT id, name, employee_count FROM companies ORDER BY employee_count DESC NULLS LAST, id LIMIT 40 OFFSET 80", "companies")
def _(t):
    rows = t.companies.select("id", "name", "employee_count")
    return PG.page(t.spark, PG.ordered(rows, "employee_count", descending=True, parts=8), rows.schema, 3, 40)[0]


@query("indexed_page", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS page, 2 < ceil(count(*) / 20.0) AS has_next, true AS has_prev, CASE WHEN 2 < ceil(count(*) / 20.0) THEN CAST(3 AS BIGINT) END AS next_page, CAST(1 AS BIGINT) AS prev_page FROM companies", "companies")
def _(t):
    rows = t.companies.select("id", "name")
    return PG.page(t.spark, PG.ordered(rows, "name", parts=8), rows.schema, 2, 20)[1]


@query("top_k_counts", "SELECT job_title AS value, count(*) AS count FROM contacts WHERE job_title IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "contacts")
def _(t):
    return S.top_k_counts(t.contacts, "job_title", 10)


@query("lead_view", "SELECT c.id, count(k.id) AS n_contacts, coalesce(string_agg(k.last_name, ',' ORDER BY k.id), '') AS last_names FROM companies c LEFT JOIN contacts k ON k.company_id = c.id GROUP BY c.id", "companies contacts")
def _(t):
    rows = S.lead_view(t.companies, t.contacts)
    return rows.select("id", F.size("contacts").cast("long").alias("n_contacts"), F.array_join(F.transform("contacts", lambda c: c["last_name"]), ",").alias("last_names"))


@query("contact_company_by_name", """
WITH k AS (SELECT id, CASE company_id % 5 WHEN 4 THEN concat('GLOBEX ', company_id - 1, ' Corporation') ELSE concat('initech ', company_id, ' inc.') END AS company_name FROM contacts),
f AS (SELECT lower(name) AS n, min(id) AS company FROM companies GROUP BY 1) SELECT k.id, f.company FROM k LEFT JOIN f ON lower(k.company_name) = f.n""", "companies contacts")
def _(t):
    c = F.col("company_id")
    named = t.contacts.withColumn("company_name", F.when(c % 5 == 4, F.concat(F.lit("GLOBEX "), (c - 1).cast("string"), F.lit(" Corporation"))).otherwise(F.concat(F.lit("initech "), c.cast("string"), F.lit(" inc."))))
    return S.contact_company_by_name(named, t.companies).select("id", F.col("company.id").alias("company"))


@query("exclude_domains", f"SELECT id, website FROM companies WHERE {HOST.format('website')} IS NULL OR {HOST.format('website')} NOT IN ('globex3.com', 'site1.example.org')", "companies")
def _(t):
    gone = t.spark.createDataFrame([("globex3.com",), ("http://Site1.example.org/x",)], "domain string")
    return S.exclude_domains(t.companies, gone).select("id", "website")


@query("dictionary_lookup", "SELECT CASE WHEN contains(lower(job_title), 'chief') THEN 'executive' WHEN contains(lower(job_title), 'vp') THEN 'executive' WHEN contains(lower(job_title), 'engineer') THEN 'technical' ELSE 'other' END AS label, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")
def _(t):
    return S.dictionary_lookup(t.contacts, "job_title", {"chief": "executive", "vp": "executive", "engineer": "technical"}, "contains", "other").groupBy("label").agg(F.count("*").alias("contacts"))


_TERMS = "SELECT concat(CASE WHEN id % 3 = 0 THEN 'GLOBEX ' ELSE '' END, id, CASE WHEN id % 2 = 0 THEN ' ' ELSE '' END) AS term, concat('g', id % 7) AS label, id % 50 AS rank FROM companies"


@query("term_table_contains", f"""WITH t AS ({_TERMS}), n AS (SELECT c.id, min(row(rank, lower(term), label)) AS hit FROM companies c JOIN t ON contains(lower(c.name), lower(term)) GROUP BY c.id)
SELECT id, coalesce(hit[3], 'none') AS label FROM companies LEFT JOIN n USING (id)""", "companies")
def _(t):
    """A term of each company's own: its number, some with the word before or a space behind."""
    i = F.col("id").cast("string")
    terms = t.companies.select(F.concat(F.when(F.col("id") % 3 == 0, "GLOBEX ").otherwise(""), i, F.when(F.col("id") % 2 == 0, " ").otherwise("")).alias("term"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("label"), (F.col("id") % 50).alias("rank"))
    return S.dictionary_lookup(t.companies, "name", terms, "contains", "none").select("id", "label")


@query("term_table_equals", """WITH t AS (SELECT lower(last_name) AS term, min(id) AS first FROM contacts WHERE id % 3 <> 1 GROUP BY 1)
SELECT id, CASE WHEN term IS NULL THEN 'none' ELSE concat('first ', first) END AS label FROM contacts LEFT JOIN t ON lower(last_name) = term""", "contacts")
def _(t):
    terms = t.contacts.where("id % 3 <> 1").select(F.upper("last_name").alias("term"), F.concat(F.lit("first "), F.col("id").cast("string")).alias("label"), F.col("id").alias("rank"))
    return S.dictionary_lookup(t.contacts, "last_name", terms, "equals", "none").select("id", "label")


@query("union_sources", "SELECT kind, count(*) AS n, count(email) AS emails, count(website) AS sites FROM (SELECT 'company' AS kind, email, website FROM companies UNION ALL SELECT 'contact', email, NULL FROM contacts) GROUP BY kind", "companies contacts")
def _(t):
    both = S.union_sources(t.companies.select(F.lit("company").alias("kind"), "email", "website"), t.contacts.select(F.lit("contact").alias("kind"), "email"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("email").alias("emails"), F.count("website").alias("sites"))


@query("distinct_links", "SELECT DISTINCT linkedin_url, company_id FROM contacts", "contacts")
def _(t):
    return S.distinct_links(t.contacts, ["linkedin_url", "company_id"])
