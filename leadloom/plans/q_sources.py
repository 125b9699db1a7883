"""Queries: reading, exports and the record pipeline. Exports are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.graph import shared_dir
from ..operators import dedup as D
from ..operators import scoring as S
from ..operators import validation as V
from ..sources import tables as T
from . import pipeline as P
from .q_dedup import _SCORED
from .q_scoring import GRADE, WEIGHTS, _category, _scores
from .q_validation import _PARTS
from .registry import query
from .views import AS_OF


def _path(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/export-{uuid.uuid4().hex}"


@query("read_tables", "SELECT count(*) AS rows, count(DISTINCT c_mktsegment) AS segments FROM customer")
def _(t):
    return T.read_tables(t.spark, t.dir, names=("customer",))["customer"].agg(F.count("*").alias("rows"), F.count_distinct("c_mktsegment").alias("segments"))


@query("read_csv_tables", """SELECT CAST(id AS VARCHAR) AS id, name, employee_count, lead_score, CAST(created_at AS VARCHAR) AS created_at, city, coalesce(len(string_split(technologies_csv, ',')), -1) AS n_technologies FROM companies""", "companies")
def _(t):
    """Companies as CSV in another order of columns, read back in their types."""
    path = _path(t)
    c = t.companies.select(F.to_json("location").alias("location"), F.to_json("technologies").alias("technology_stack"), "lead_score", "employee_count", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "id")
    c.write.option("header", True).option("escape", '"').csv(f"{path}/companies.csv")
    rows = T.read_tables(t.spark, path, "csv", ("companies",))["companies"]
    n = F.coalesce(F.size("technology_stack"), F.lit(-1)).cast("long")
    return rows.select("id", "name", "employee_count", "lead_score", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("location.city").alias("city"), F.when(F.col("technology_stack").isNull(), -1).otherwise(n).cast("long").alias("n_technologies"))


@query("conform_companies", "SELECT id, company_size, website, coalesce(len(string_split(technologies_csv, ',')), 0) AS n_technologies, city, state FROM companies", "companies")
def _(t):
    other = t.companies.select("id", F.col("company_size").alias("size_range"), F.col("website").alias("website_url"), F.when(F.col("id") % 2 == 0, F.to_json("technologies")).otherwise(F.col("technologies_csv")).alias("technologies"), F.when(F.col("id") % 2 == 0, F.to_json("location")).otherwise(F.concat_ws(", ", "city", "state", "country")).alias("location"))
    c = T.conform_companies(other)
    return c.select("id", "company_size", "website", F.greatest(F.size(F.coalesce("technology_stack", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_technologies"), F.col("location.city").alias("city"), F.col("location.state").alias("state"))


@query("load_scraped_records", "SELECT id, concat('Acme ', company_id) AS name, concat('+1-212-', 2000000 + contact_id) AS phone FROM scraped_data", "scraped_data")
def _(t):
    return T.load_scraped_records(t.scraped_data)[0].select("id", "name", "phone")


@query("export_csv_companies", "SELECT CAST(id AS VARCHAR) AS id, concat(city, ', ', state, ', ', country) AS place FROM companies ORDER BY created_at DESC, companies.id LIMIT 1000", "companies")
def _(t):
    path = _path(t)
    T.export_csv_companies(t.companies, path)
    return t.spark.read.option("header", True).csv(path).select(F.col("Id").alias("id"), F.col("Location").alias("place"))


@query("export_csv_contacts", "SELECT CAST(id AS VARCHAR) AS id, last_name, CAST(is_verified AS VARCHAR) AS verified FROM contacts ORDER BY created_at DESC, contacts.id LIMIT 500", "contacts")
def _(t):
    path = _path(t)
    T.export_csv_contacts(t.contacts, path, max_records=500)
    return t.spark.read.option("header", True).csv(path).select(F.col("Id").alias("id"), F.col("Last Name").alias("last_name"), F.col("Is Verified").alias("verified"))


@query("export_leads_csv", "SELECT CAST(id AS VARCHAR) AS id, name FROM companies", "companies")
def _(t):
    path = _path(t)
    T.export_leads_csv(t.companies, path)
    return t.spark.read.option("header", True).csv(path).select(F.col("Company ID").alias("id"), F.col("Company Name").alias("name"))


@query("export_json", "SELECT id, name, lead_score FROM companies ORDER BY created_at DESC, id LIMIT 100", "companies")
def _(t):
    path = _path(t)
    T.export_json(t.companies, path, ("id", "name", "lead_score"), 100)
    return t.spark.read.schema("id long, name string, lead_score double").json(path)


@query("export_leads_with_contact", "WITH k AS (SELECT company_id, arg_min(concat(first_name, ' ', last_name), id) AS contact_name FROM contacts GROUP BY 1) SELECT id, contact_name FROM companies LEFT JOIN k ON id = company_id WHERE lead_score >= 60", "companies contacts")
def _(t):
    path = _path(t)
    T.export_leads_with_contact(t.companies, t.contacts, path, min_score=60)
    return t.spark.read.option("header", True).csv(path).select(F.col("id").cast("long").alias("id"), "contact_name")


_CATALOG = {
    "companies": "basic: id name domain website industry company_size employee_count; contact_info: phone address location; business_data: founded_year revenue_range description technology_stack social_media; "
    "analytics: lead_score data_quality_score growth_signals pain_points competitive_landscape; metadata: created_at updated_at contacts_count scraped_data_count",
    "contacts": "basic: id first_name last_name full_name email phone; professional: job_title department seniority_level experience_years skills; social: linkedin_url twitter_handle bio; "
    "analytics: contact_quality_score engagement_potential is_decision_maker is_verified; metadata: created_at updated_at last_activity_date",
}


def _catalog_sql() -> str:
    """Every field of the catalogue with how many rows of its table have it."""
    from .views import FORMULAS

    made = {"location": "count(*)", "growth_signals": "count(*)", "social_media": "count(*) FILTER (id % 3 = 0)"}
    parts = []
    for table, text in _CATALOG.items():
        for group in text.split("; "):
            name, fields = group.split(": ")
            for field in fields.split():
                n = f"count({field})" if field in FORMULAS[table] else made.get(field, "0 * count(*)") if table == "companies" else "0 * count(*)"
                parts.append(f"SELECT '{table}' AS data_type, '{name}' AS field_group, '{field}' AS field, {n} AS n_filled FROM {table}")
    return " UNION ALL ".join(parts)


@query("export_field_catalog", _catalog_sql(), "companies contacts")
def _(t):
    catalog = T.export_field_catalog(t.spark)
    return T.field_use(t.companies, catalog, "companies").union(T.field_use(t.contacts, catalog, "contacts"))


@query("export_cap", "SELECT id FROM companies ORDER BY created_at DESC, id LIMIT 40", "companies")
def _(t):
    return T.export_cap(t.companies, 40).select("id")


@query("crm_field_mapping", """SELECT name AS "Account Name", website AS "Website", employee_count AS "Employees" FROM companies""", "companies")
def _(t):
    return T.crm_field_mapping(t.companies, {"name": "Account Name", "website": "Website", "employee_count": "Employees"})


_FAST = P.Config(enrich=False, estimate=False, metric="levenshtein", as_of=AS_OF)


@query("run_pipeline")
def _(t):
    companies, contacts, _ = P.run_pipeline(t.companies, t.contacts, "default")
    return companies.select("id", "name", "industry", "estimated_size", "revenue_category", F.col("processing.version").alias("version"))


@query("pipeline_report")
def _(t):
    return P.run_pipeline(t.companies, t.contacts, _FAST)[2]


_CHECKED = P.Config(enrich=False, estimate=False, deduplicate=False, as_of=AS_OF)
_STRICT = P.Config(strict=True, clean=False, enrich=False, estimate=False, deduplicate=False, as_of=AS_OF)
_ODD = f"SELECT id, 'phone' AS field FROM companies JOIN pm USING (id) WHERE phone IS NOT NULL AND pm.status <> 'valid' UNION ALL SELECT id, 'email' FROM companies JOIN m USING (id) WHERE email IS NOT NULL AND m.status NOT IN ('valid', 'role_based') UNION ALL SELECT id, 'website' FROM companies JOIN u USING (id) WHERE website IS NOT NULL AND NOT regexp_matches(u.url, '{V.URL}')"


@query("pipeline_counts", f"""WITH {_PARTS}, x AS ({_ODD}), c AS (SELECT count(*) AS n FROM companies), k AS (SELECT count(*) AS n FROM contacts)
SELECT 'validate:companies' AS stage, n AS rows_in, n AS rows_out, 0::BIGINT AS dropped, (SELECT count(*) FROM x) AS errors FROM c UNION ALL SELECT 'clean:companies', n, n, 0, 0 FROM c
UNION ALL SELECT 'validate:contacts', n, n, 0, n FROM k UNION ALL SELECT 'clean:contacts', n, n, 0, 0 FROM k""", "companies contacts")
def _(t):
    """Every contact's last name holds digits, which is an error of each."""
    return P.run_pipeline(t.companies, t.contacts, _CHECKED)[2]


@query("pipeline_errors", f"WITH {_PARTS}, x AS ({_ODD}) SELECT 'validate:companies' AS stage, CAST(id AS VARCHAR) AS id, field FROM x", "companies")
def _(t):
    return P.run_with_errors(t.companies, t.contacts.limit(0), _STRICT)[3].select("stage", "id", "field")


@query("pipeline_strict_counts", f"WITH {_PARTS}, x AS ({_ODD}) SELECT 'validate:companies' AS stage, count(*) AS rows_in, count(*) - (SELECT count(DISTINCT id) FROM x) AS rows_out, (SELECT count(DISTINCT id) FROM x) AS dropped, (SELECT count(*) FROM x) AS errors FROM companies", "companies")
def _(t):
    return P.run_pipeline(t.companies, t.contacts.where("id < 0"), _STRICT)[2].where("stage = 'validate:companies'")


@query("finalize_records", "SELECT id, '1.0' AS version, '2024-04-01 00:00:00' AS processed_at FROM companies", "companies")
def _(t):
    rows = P.finalize_records(t.companies, "1.0", {"clean": True}, AS_OF)
    return rows.select("id", "processing.version", F.date_format("processing.processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))


@query("custom_dictionaries", f"WITH {_SCORED} SELECT id_a, id_b, concat_ws(',', CASE WHEN s_name >= 0.5 THEN 'name' END, CASE WHEN s_domain >= 0.9 THEN 'domain' END, CASE WHEN s_email >= 0.8 THEN 'email' END, CASE WHEN s_phone >= 0.8 THEN 'phone' END) AS matching_fields FROM m", "companies")
def _(t):
    """Caller-given thresholds: a name matches from 0.5 up."""
    found = D.company_matches(t.companies, thresholds={**D.COMPANY_THRESHOLDS, "name": 0.5}, metric="levenshtein")
    return found.select("id_a", "id_b", F.array_join("matching_fields", ",").alias("matching_fields"))


@query("score_leads_flagship", _scores(WEIGHTS).replace("round(total * 100, 4) AS score_percentage", "round(total * 100, 4) AS score_percentage, " + ", ".join(f"round({_category(c)}, 6) AS {c}" for c in WEIGHTS)) + f" SELECT company_id, contact_id, total_score, {GRADE} AS grade, {', '.join(WEIGHTS)} FROM s", "companies contacts")
def _(t):
    """Scores with their breakdown, as the entry point shows them."""
    from ..operators.select import host

    return S.score_leads(t.contacts, t.companies.withColumn("domain", host("website")), AS_OF).select("company_id", "contact_id", "total_score", "grade", "breakdown.*")
