"""Queries: cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from .registry import query

_MAIL = "m AS (SELECT id, email IS NULL AS none, lower(trim(coalesce(email, ''))) AS raw, replace(lower(trim(coalesce(email, ''))), ' ', '') AS v FROM companies)"


@query("clean_text", "SELECT id, CASE WHEN id % 3 = 0 THEN upper(description) WHEN id % 3 = 1 THEN concat('<b>', description, '</b>  x') ELSE description END IS NULL OR description = '' AND id % 3 <> 1 AS empty, CASE WHEN id % 3 = 1 THEN regexp_replace(trim(concat(description, '  x')), '\\s+', ' ', 'g') WHEN id % 3 = 2 THEN coalesce(description, '') END AS value FROM companies WHERE id % 3 <> 0 AND description IS NOT NULL", "companies")
def _(t):
    rows = t.companies.where("id % 3 <> 0 and description is not null").withColumn("text", F.when(F.col("id") % 3 == 1, F.concat(F.lit("<b>"), "description", F.lit("</b>  x"))).otherwise(F.col("description")))
    return C.clean_text(rows, "text", preserve_case=True).select("id", (F.col("text") == "").alias("empty"), F.col("text_clean.value").alias("value"))


@query("clean_company_names", """SELECT id, CASE id % 5 WHEN 4 THEN name WHEN 3 THEN concat('Globex ', id, ' Corp.') WHEN 2 THEN concat('ACME ', id, ' LLC') ELSE name END AS value, CASE id % 5 WHEN 4 THEN 1.0 WHEN 3 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM companies""", "companies")
def _(t):
    return C.clean_company_names(t.companies).select("id", "name_clean.value", "name_clean.confidence")


@query("clean_person_names", "SELECT id, CASE id % 5 WHEN 0 THEN 'Mary' WHEN 1 THEN 'John' WHEN 2 THEN 'Alex' WHEN 3 THEN 'Sam' ELSE 'Kim' END AS value, CASE id % 5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 4 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM contacts", "contacts")
def _(t):
    return C.clean_person_names(t.contacts, "first_name").select("id", "first_name_clean.value", "first_name_clean.confidence")


@query("clean_emails", f"WITH {_MAIL} SELECT id, CASE WHEN none THEN '' ELSE v END AS value, CASE WHEN none THEN 0 WHEN length(v) - length(replace(v, '@', '')) <> 1 THEN 0.1 WHEN v <> raw THEN 0.9 ELSE 1 END::DOUBLE AS confidence FROM m", "companies")
def _(t):
    return C.clean_emails(t.companies).select("id", "email_clean.value", "email_clean.confidence")


@query("clean_phones", "SELECT id, CASE WHEN phone IS NULL THEN '' ELSE concat('+1', right(regexp_replace(phone, '[^0-9]', '', 'g'), 10)) END AS value, CASE id % 4 WHEN 0 THEN 'Added US country code' WHEN 1 THEN '' WHEN 2 THEN 'Added + prefix' ELSE 'Empty or invalid phone' END AS changes FROM companies", "companies")
def _(t):
    return C.clean_phones(t.companies).select("id", "phone_clean.value", F.array_join("phone_clean.changes", ",").alias("changes"))


@query("normalize_handles", "SELECT id, CASE WHEN id % 3 = 0 THEN concat('@', last_name) WHEN id % 3 = 1 THEN concat('@', last_name) END AS handle FROM contacts", "contacts")
def _(t):
    rows = t.contacts.select("id", F.when(F.col("id") % 3 == 0, F.col("last_name")).when(F.col("id") % 3 == 1, F.concat(F.lit(" @"), "last_name")).alias("handle"))
    return C.normalize_handles(rows, "handle")


@query("clean_urls", "SELECT id, CASE id % 5 WHEN 4 THEN concat('http://globex', id - 1, '.com') WHEN 3 THEN concat('https://globex', id, '.com') WHEN 0 THEN '' ELSE concat('https://site', id, '.example.org/about?q=1') END AS value, CASE id % 5 WHEN 4 THEN 0.9 WHEN 3 THEN 0.9 WHEN 0 THEN 0 ELSE 1 END::DOUBLE AS confidence FROM companies", "companies")
def _(t):
    return C.clean_urls(t.companies).select("id", "website_clean.value", "website_clean.confidence")


_ADDRESS = "concat(id, ' N Main St , Springfield,', CASE id % 3 WHEN 0 THEN 'Texas 75001' WHEN 1 THEN 'NY' ELSE 'ohio' END)"


def _addresses(t):
    tail = F.when(F.col("id") % 3 == 0, "Texas 75001").when(F.col("id") % 3 == 1, "NY").otherwise("ohio")
    return t.companies.select("id", F.concat(F.col("id").cast("string"), F.lit(" N Main St , Springfield,"), tail).alias("address"))


@query("clean_addresses", "SELECT id, concat(id, ' North Main Street, Springfield, ', CASE id % 3 WHEN 0 THEN 'TX 75001' WHEN 1 THEN 'NY' ELSE 'OH' END) AS value, id % 3 = 0 OR id >= 10000 AND id < 100000 AS has_zip FROM companies", "companies")
def _(t):
    return C.clean_addresses(_addresses(t), "address").select("id", "address_clean.value", (F.col("address_clean.metadata")["has_zip"] == "true").alias("has_zip"))


@query("parse_addresses", "SELECT id, CASE WHEN id >= 10000 THEN 'N Main St' ELSE concat(id, ' N Main St') END AS street, 'Springfield' AS city, CASE id % 3 WHEN 0 THEN CASE WHEN id >= 10000 THEN '' ELSE 'TX' END WHEN 1 THEN 'NY' ELSE 'OH' END AS state, CASE WHEN id >= 10000 THEN CAST(id AS VARCHAR) WHEN id % 3 = 0 THEN '75001' ELSE '' END AS zip_code FROM companies", "companies")
def _(t):
    return C.parse_addresses(_addresses(t), "address").select("id", "address_parts.street", "address_parts.city", "address_parts.state", "address_parts.zip_code")


for _name, _op, _pattern in (("extract_emails", C.extract_emails, C.EMAILS), ("extract_phones", C.extract_phones, C.PHONES), ("extract_urls", C.extract_urls, C.URLS)):

    @query(_name, f"SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_pattern}')) AS match FROM documents")
    def _(t, op=_op):
        return op(t.documents, "doc_id", "text")


@query("clean_companies", f"WITH {_MAIL} SELECT c.id, CASE c.id % 5 WHEN 3 THEN concat('Globex ', c.id, ' Corp.') WHEN 2 THEN concat('ACME ', c.id, ' LLC') ELSE name END AS name, CASE WHEN NOT none THEN v END AS email, industry FROM companies c JOIN m USING (id)", "companies")
def _(t):
    return C.clean_companies(t.companies).select("id", "name", "email", "industry")


@query("clean_contacts", "SELECT id, CASE id % 5 WHEN 0 THEN 'Mary' WHEN 1 THEN 'John' WHEN 2 THEN 'Alex' WHEN 3 THEN 'Sam' ELSE 'Kim' END AS first_name, lower(email) AS email, CASE WHEN linkedin_url IS NOT NULL THEN replace(linkedin_url, 'www.', '') END AS linkedin_url FROM contacts", "contacts")
def _(t):
    return C.clean_contacts(t.contacts).select("id", "first_name", "email", "linkedin_url")


@query("cleaning_report", """SELECT 'phone' AS field, CASE id % 4 WHEN 0 THEN 'Added US country code' WHEN 2 THEN 'Added + prefix' ELSE 'Empty or invalid phone' END AS change, count(*) AS rows, CASE WHEN id % 4 = 3 THEN 0 ELSE 0.9 END::DOUBLE AS mean_confidence FROM companies WHERE id % 4 <> 1 GROUP BY 2, 4""", "companies")
def _(t):
    return C.cleaning_report(C.clean_companies(t.companies.select("id", "phone")))
