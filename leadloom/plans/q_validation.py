"""Queries: validation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .registry import query


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_MAIL = f"""e AS (SELECT id, email, lower(trim(coalesce(email, ''))) AS v FROM companies),
f AS (SELECT *, regexp_matches(v, '{V.EMAIL.replace("'", "''")}') AND NOT regexp_matches(v, '\\.\\.|^\\.|\\.@') AS ok, string_split(v, '@')[1] AS local, string_split(v, '@')[-1] AS domain FROM e),
m AS (SELECT id, CASE WHEN NOT ok THEN 'invalid' WHEN domain IN {_in(V.DISPOSABLE)} THEN 'disposable' WHEN local IN {_in(V.ROLE_PREFIXES)} THEN 'role_based' ELSE 'valid' END AS status,
  CASE WHEN ok THEN v END AS normalized, CASE WHEN NOT ok OR domain IN {_in(V.DISPOSABLE)} THEN 0.0 WHEN local IN {_in(V.ROLE_PREFIXES)} THEN 0.6 WHEN domain IN {_in(V.FREEMAIL)} THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, domain FROM f)"""


@query("validate_emails", f"WITH {_MAIL} SELECT id, status, normalized, confidence FROM m", "companies")
def _(t):
    return V.validate_emails(t.companies, "email").select("id", "email_check.status", "email_check.normalized", "email_check.confidence")


@query("business_emails", f"WITH {_MAIL} SELECT id FROM m WHERE status = 'valid' AND domain NOT IN {_in(V.FREEMAIL)}", "companies")
def _(t):
    return V.business_emails(t.companies).select("id")


_PHONE = f"""e AS (SELECT id, trim(coalesce(phone, '')) AS v, regexp_replace(trim(coalesce(phone, '')), '[^0-9]', '', 'g') AS d FROM companies),
f AS (SELECT *, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN d[2:] WHEN length(d) = 10 AND v NOT LIKE '+%' THEN d END AS b FROM e),
m AS (SELECT id, CASE WHEN coalesce(regexp_matches(b, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'), false) THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN coalesce(regexp_matches(b, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'), false) THEN concat('+1', b) END AS normalized FROM f)"""


@query("validate_phones", f"WITH {_PHONE} SELECT id, status, normalized, CASE status WHEN 'valid' THEN 0.85 ELSE 0 END::DOUBLE AS confidence FROM m", "companies")
def _(t):
    return V.validate_phones(t.companies, "phone").select("id", "phone_check.status", "phone_check.normalized", "phone_check.confidence")


_URL = f"u AS (SELECT id, coalesce(website, '') = '' AS missing, CASE WHEN regexp_matches(trim(coalesce(website, '')), '^https?://') THEN trim(website) ELSE concat('https://', trim(coalesce(website, ''))) END AS url, trim(coalesce(website, '')) AS v FROM companies)"


@query("validate_urls", f"WITH {_URL} SELECT id, NOT missing AND regexp_matches(url, '{V.URL}') AS is_valid, CASE WHEN NOT missing AND regexp_matches(url, '{V.URL}') THEN url END AS normalized FROM u", "companies")
def _(t):
    return V.validate_urls(t.companies, "website").select("id", "url_check.is_valid", "url_check.normalized")


@query("validate_urls_loose", f"WITH {_URL} SELECT regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS is_valid, count(*) AS companies FROM u GROUP BY 1", "companies")
def _(t):
    return V.validate_urls_loose(t.companies, "website").groupBy("url_check.is_valid").agg(F.count("*").alias("companies"))


_DOM = f"{_URL}, d AS (SELECT id, missing, v, regexp_extract(regexp_replace(lower(v), '^.*?://', ''), '^[^/]*', 0) AS domain FROM u)"


@query("validate_domains", f"WITH {_DOM} SELECT id, NOT missing AND regexp_matches(domain, '{V.DOMAIN}') AS is_valid, CASE WHEN NOT missing AND regexp_matches(domain, '{V.DOMAIN}') THEN string_split(domain, '.')[-1] END AS tld FROM d", "companies")
def _(t):
    return V.validate_domains(t.companies, "website").select("id", "domain_check.is_valid", F.col("domain_check.metadata")["tld"].alias("tld"))


@query("validate_domains_loose", f"WITH {_DOM} SELECT NOT missing AND regexp_matches(v, '{V.LOOSE_DOMAIN}') AS is_valid, count(*) AS companies FROM d GROUP BY 1", "companies")
def _(t):
    return V.validate_domains_loose(t.companies, "website").groupBy("domain_check.is_valid").agg(F.count("*").alias("companies"))


@query("validate_linkedin", f"SELECT id, coalesce(regexp_matches(linkedin_url, '{V.LINKEDIN}'), false) AS is_valid, CASE WHEN coalesce(regexp_matches(linkedin_url, '{V.LINKEDIN}'), false) THEN 0.95 ELSE 0 END::DOUBLE AS confidence FROM contacts", "contacts")
def _(t):
    return V.validate_linkedin(t.contacts, "linkedin_url").select("id", "linkedin_check.is_valid", "linkedin_check.confidence")


@query("validate_company_names", f"SELECT CASE WHEN regexp_matches(n, '{V.SUSPICIOUS}') THEN 'uncertain' ELSE 'valid' END AS status, count(*) AS companies FROM (SELECT CASE id % 4 WHEN 0 THEN '12345' WHEN 1 THEN 'Test Co' ELSE name END AS n FROM companies) GROUP BY 1", "companies")
def _(t):
    rows = t.companies.withColumn("name", F.when(F.col("id") % 4 == 0, "12345").when(F.col("id") % 4 == 1, "Test Co").otherwise(F.col("name")))
    return V.validate_company_names(rows, "name").groupBy("name_check.status").agg(F.count("*").alias("companies"))


@query("validate_contact_names", "SELECT id, regexp_matches(first_name, '^[a-zA-Z\\s\\-''.]+$') AND regexp_matches(last_name, '^[a-zA-Z\\s\\-''.]+$') AS is_valid FROM (SELECT id, first_name, CASE WHEN id % 2 = 0 THEN 'O''Neil-Smith' ELSE last_name END AS last_name FROM contacts)", "contacts")
def _(t):
    rows = t.contacts.withColumn("last_name", F.when(F.col("id") % 2 == 0, "O'Neil-Smith").otherwise(F.col("last_name")))
    return V.validate_contact_names(rows, "first_name", "last_name").select("id", "name_check.is_valid")


_PARTS = f"""{_MAIL}, {_PHONE.replace('e AS', 'pe AS').replace('FROM e)', 'FROM pe)').replace('f AS', 'pf AS', 1).replace('m AS', 'pm AS').replace('FROM f)', 'FROM pf)').replace('(pf AS', 'pf AS')}, {_URL}"""


@query("validate_company_records", f"WITH {_PARTS} SELECT c.id FROM companies c JOIN m USING (id) JOIN pm ON pm.id = c.id JOIN u ON u.id = c.id WHERE (c.email IS NULL OR m.status IN ('valid', 'role_based')) AND (c.phone IS NULL OR pm.status = 'valid') AND (c.website IS NULL OR regexp_matches(u.url, '{V.URL}'))", "companies")
def _(t):
    return V.validate_records(t.companies, strict=True).select("id")


@query("validate_contact_records", "SELECT id FROM contacts WHERE id % 3 <> 0", "contacts")
def _(t):
    rows = t.contacts.withColumn("last_name", F.when(F.col("id") % 3 != 0, "Lee").otherwise(F.col("last_name")))
    return V.validate_records(rows, strict=True).select("id")


@query("validate_all_fields", f"WITH {_PARTS} SELECT 'email' AS field, status, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'phone', status, count(*) FROM pm GROUP BY 2 UNION ALL SELECT 'website', CASE WHEN NOT missing AND regexp_matches(url, '{V.URL}') THEN 'valid' ELSE 'invalid' END, count(*) FROM u GROUP BY 2", "companies")
def _(t):
    return V.validate_all_fields(t.companies.select("id", "email", "phone", "website")).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("triage_scraped", """SELECT CASE WHEN contact_id % 5 = 1 THEN 'duplicate' WHEN company_id % 4 = 0 THEN 'needs_review' ELSE validation_status END AS validation_status, count(*) AS n FROM scraped_data GROUP BY 1""", "scraped_data")
def _(t):
    s = t.scraped_data.where("true")
    results = s.select("id", (F.col("company_id") % 4 != 0).alias("is_valid")).dropDuplicates(["id"])
    groups = s.where("contact_id % 5 = 1").select("id", F.lit("0-0-0-0").alias("group_id")).dropDuplicates(["id"])
    return V.triage_scraped(s, results, groups).groupBy("validation_status").agg(F.count("*").alias("n"))


@query("screen_inputs", r"""WITH r AS (SELECT id, unnest(['name', 'description']) AS "column", unnest([CASE id % 4 WHEN 0 THEN concat(name, '; -- x') WHEN 1 THEN '<script>alert(1)</script>' ELSE name END, description]) AS value FROM companies)
SELECT id, "column", 'sql' AS rule FROM r WHERE regexp_matches(value, '(?i)\b(union\s+select|drop\s+table|insert\s+into|delete\s+from|or\s+1\s*=\s*1)\b|--\s|;\s*--') UNION ALL SELECT id, "column", 'script' FROM r WHERE regexp_matches(value, '(?i)<script|javascript:|on(?:load|error|click)\s*=|<iframe')
UNION ALL SELECT id, "column", 'length' FROM r WHERE length(value) > 60""", "companies")
def _(t):
    c = t.companies
    rows = c.withColumn("name", F.when(F.col("id") % 4 == 0, F.concat("name", F.lit("; -- x"))).when(F.col("id") % 4 == 1, "<script>alert(1)</script>").otherwise(F.col("name")))
    return V.screen_inputs(rows, ["name", "description"], longest=60)
