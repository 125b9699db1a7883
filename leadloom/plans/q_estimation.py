"""Queries: estimation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import filled
from ..operators import enrichment as N
from ..operators import estimation as E
from .q_select import HOST
from .registry import query

#: The rules once more, by hand.
def _hits(column: str, words: str) -> str:
    """How many of the comma-separated words are part of the lower-cased value."""
    return f"len(list_filter(string_split('{words}', ','), lambda w: contains(lower(coalesce({column}, '')), w)))"


def _most(column: str, **groups: str) -> str:
    """The first of the groups with the most words in the value."""
    counts = ", ".join(_hits(column, words) for words in groups.values())
    return f"(SELECT CASE WHEN list_max(h) > 0 THEN {list(groups)}[list_position(h, list_max(h))] END FROM (SELECT [{counts}] AS h))"


P = "p AS (SELECT *, replace(technologies_csv, ',', ' ') AS tech, id % 3 = 0 AS has_social, CASE WHEN id % 9 <> 0 THEN id * 20000 END AS funds FROM companies)"
BY_EMPLOYEES = "CASE WHEN employee_count > 1000 THEN 'enterprise' WHEN employee_count > 250 THEN 'large' WHEN employee_count > 50 THEN 'medium' WHEN employee_count > 10 THEN 'small' WHEN employee_count IS NOT NULL THEN 'startup' END"
BY_WORDS = _most(
    "description", startup="startup,founded,early stage,seed,pre-seed,stealth,emerging,new venture,bootstrap", small="small,boutique,local,family,independent,artisan,craft,niche,specialized",
    medium="growing,expanding,regional,mid-size,established,mature,scaling", large="large,major,leading,prominent,significant,substantial,nationwide,multi-location",
    enterprise="enterprise,global,international,fortune,multinational,corporation,conglomerate,worldwide,industry leader,market leader",
)
BY_TECH = _most(
    "tech", startup="mvp,prototype,beta,stealth mode,pre-launch,proof of concept", small="wordpress,squarespace,wix,shopify basic,basic hosting,shared hosting", medium="dedicated server,cloud hosting,cdn,professional email,crm system",
    large="enterprise software,custom development,multiple domains,advanced analytics", enterprise="enterprise architecture,microservices,kubernetes,enterprise security,data centers,global infrastructure",
)
_POINTS = """((website IS NOT NULL)::INT + coalesce(starts_with(website, 'https://'), false)::INT + 2 * coalesce(contains(email, '@') AND NOT regexp_matches(lower(email), '@(gmail|yahoo|hotmail|outlook)[.]com$'), false)::INT
+ has_social::INT + coalesce(len(string_split(website, '.')) > 2, false)::INT)"""
BY_WEB = f"CASE WHEN {_POINTS} < 2 THEN 'startup' WHEN {_POINTS} < 4 THEN 'small' WHEN {_POINTS} < 6 THEN 'medium' ELSE 'large' END"
BY_CONTEXT = "CASE WHEN regexp_matches(lower(industry), 'finance|banking|insurance|automotive|energy') THEN 'large' WHEN regexp_matches(lower(industry), 'consulting|design|marketing|freelance') THEN 'small' WHEN regexp_matches(lower(city), 'new york|san francisco|london|tokyo|singapore') THEN 'medium' END"
_SIZE = f"""z AS (SELECT *, {BY_EMPLOYEES} AS z1, {BY_WORDS} AS z2, {BY_TECH} AS z3, {BY_WEB} AS z4, {BY_CONTEXT} AS z5 FROM p),
s AS (SELECT *, coalesce(z1, z2, z3, z4, z5) AS estimated_size, concat_ws(',', CASE WHEN z1 IS NOT NULL THEN 'employee_count' END, CASE WHEN z2 IS NOT NULL THEN 'keyword_analysis' END, CASE WHEN z3 IS NOT NULL THEN 'technology_analysis' END, 'website_complexity', CASE WHEN z5 IS NOT NULL THEN 'context_analysis' END) AS size_methods,
  round((CASE WHEN z1 IS NULL THEN 0 ELSE 0.9::DOUBLE END + CASE WHEN z2 IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN z3 IS NULL THEN 0 ELSE 0.5::DOUBLE END + 0.4::DOUBLE + CASE WHEN z5 IS NULL THEN 0 ELSE 0.3::DOUBLE END) / ((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT + 1 + (z5 IS NOT NULL)::INT), 6) AS size_confidence FROM z)"""
_RANGE = "CASE estimated_size WHEN 'startup' THEN 1 WHEN 'small' THEN 11 WHEN 'medium' THEN 51 WHEN 'large' THEN 251 ELSE 1001 END AS size_min, CASE estimated_size WHEN 'startup' THEN 10 WHEN 'small' THEN 50 WHEN 'medium' THEN 250 WHEN 'large' THEN 1000 ELSE 10000 END AS size_max"
_BASE = "CASE WHEN employee_count > 0 AND industry IS NOT NULL THEN employee_count::BIGINT * CASE lower(industry) WHEN 'technology' THEN 200000 WHEN 'finance' THEN 300000 WHEN 'healthcare' THEN 150000 WHEN 'consulting' THEN 180000 WHEN 'manufacturing' THEN 120000 WHEN 'retail' THEN 80000 WHEN 'education' THEN 60000 WHEN 'nonprofit' THEN 40000 ELSE 150000 END END"
_ENT, _MID, _BASIC = _hits("tech", "kubernetes,microservices,enterprise,oracle,salesforce,sap,aws enterprise,azure enterprise"), _hits("tech", "aws,azure,google cloud,docker,redis,postgresql,mongodb,elasticsearch"), _hits("tech", "wordpress,shopify,squarespace,wix,basic hosting,shared hosting")


def _by_size(*values: int) -> str:
    return "CASE estimated_size " + " ".join(f"WHEN '{n}' THEN {v}::BIGINT" for n, v in zip(("startup", "small", "medium", "large", "enterprise"), values, strict=True)) + " END"


def _by_tech(*values: int) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {v}::BIGINT" for test, v in zip((f"{_ENT} > 0", f"{_MID} > 2", f"{_MID} > 0", f"{_BASIC} > 0"), values, strict=True)) + " END"


def _by_funds(early: str, growth: str, late: str) -> str:
    return f"CASE WHEN funds > 0 THEN floor(funds::DOUBLE * CASE WHEN funds < 1000000 THEN {early}::DOUBLE WHEN funds < 10000000 THEN {growth}::DOUBLE ELSE {late}::DOUBLE END)::BIGINT END"


MODELS = {
    "employee_industry_model": (f"floor({_BASE} * 0.5)::BIGINT", f"floor({_BASE} * 1.5)::BIGINT", _BASE),
    "size_based_model": (_by_size(0, 100000, 1000000, 10000000, 50000000), _by_size(500000, 5000000, 50000000, 500000000, 500000000), _by_size(250000, 2550000, 25500000, 255000000, 100000000)),
    "technology_analysis": (_by_tech(10000000, 1000000, 100000, 10000), _by_tech(500000000, 50000000, 10000000, 1000000), _by_tech(50000000, 10000000, 2000000, 200000)),
    "funding_based_model": (_by_funds("0.1", "0.3", "0.8"), _by_funds("0.5", "1.5", "3.0"), _by_funds("0.3", "0.9", "1.9")),
}
_REVENUE = f"""v AS (SELECT *, {', '.join(f'{m[2]} AS v{k}' for k, m in enumerate(MODELS.values(), 1))} FROM s),
r AS (SELECT *, coalesce(v1, v2, v3, v4) AS estimate, concat_ws(',', CASE WHEN v1 IS NOT NULL THEN 'employee_industry_model' END, CASE WHEN v2 IS NOT NULL THEN 'size_based_model' END, CASE WHEN v3 IS NOT NULL THEN 'technology_analysis' END, CASE WHEN v4 IS NOT NULL THEN 'funding_based_model' END) AS revenue_methods,
  round((CASE WHEN v1 IS NULL THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN v2 IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN v3 IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN v4 IS NULL THEN 0 ELSE 0.6::DOUBLE END) / ((v1 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT + (v3 IS NOT NULL)::INT + (v4 IS NOT NULL)::INT), 6) AS revenue_confidence FROM v)"""
_BAND = "CASE WHEN estimate IS NULL THEN NULL WHEN estimate > 1000000000 THEN 'over_1b' WHEN estimate > 500000000 THEN '500m_1b' WHEN estimate > 100000000 THEN '100m_500m' WHEN estimate > 50000000 THEN '50m_100m' WHEN estimate > 10000000 THEN '10m_50m' WHEN estimate > 1000000 THEN '1m_10m' ELSE 'under_1m' END"
_EXEC, _DECIDE, _INFLUENCE = (f"coalesce(regexp_matches(lower(job_title), '{w}'), false)" for w in ("ceo|cto|cfo|coo|president|founder|owner", "director|vp|vice president|head|manager", "lead|senior|principal|architect"))
_VALUE = f"""least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN {_EXEC} THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {_DECIDE} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_INFLUENCE} THEN 0.2::DOUBLE ELSE 0 END
+ CASE c_size WHEN 'enterprise' THEN 0.2::DOUBLE WHEN 'large' THEN 0.15::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE 0 END + CASE lower(seniority_level) WHEN 'executive' THEN 0.15::DOUBLE WHEN 'senior' THEN 0.1::DOUBLE WHEN 'mid' THEN 0.05::DOUBLE ELSE 0 END)"""


def _funded(t):
    return t.companies.withColumn("funding_amount", F.when(F.col("id") % 9 != 0, F.col("id") * 20000))


for _name, _op, _sql in (("size_from_employees", E.size_from_employees, BY_EMPLOYEES), ("size_from_keywords", E.size_from_keywords, BY_WORDS), ("size_from_technologies", E.size_from_technologies, BY_TECH), ("size_from_web_presence", E.size_from_web_presence, BY_WEB), ("size_from_context", E.size_from_context, BY_CONTEXT)):

    @query(_name, f"WITH {P} SELECT id, {_sql} AS size FROM p", "companies")
    def _(t, op=_op):
        return op(t.companies).select("id", "size")


@query("estimate_size", f"WITH {P}, {_SIZE} SELECT id, estimated_size, {_RANGE}, size_confidence, size_methods FROM s", "companies")
def _(t):
    return E.estimate_size(t.companies).select("id", "estimated_size", "size_min", "size_max", "size_confidence", F.array_join("size_methods", ",").alias("size_methods"))


for _name, _method in (("revenue_from_employees", "employee_industry_model"), ("revenue_from_size", "size_based_model"), ("revenue_from_technologies", "technology_analysis"), ("revenue_from_funding", "funding_based_model")):
    _low, _high, _mean = MODELS[_method]

    @query(_name, f"WITH {P}, {_SIZE} SELECT id, {_low} AS low, {_high} AS high, {_mean} AS estimate FROM s", "companies")
    def _(t, method=_method):
        return E.revenue_from(E.estimate_size(_funded(t)), method).select("id", F.col("revenue.min").alias("low"), F.col("revenue.max").alias("high"), F.col("revenue.estimate").alias("estimate"))


@query("estimate_revenue", f"WITH {P}, {_SIZE}, {_REVENUE} SELECT id, estimate, revenue_confidence, revenue_methods FROM r", "companies")
def _(t):
    return E.estimate_revenue(E.estimate_size(_funded(t))).select("id", F.col("revenue.estimate").alias("estimate"), "revenue_confidence", F.array_join("revenue_methods", ",").alias("revenue_methods"))


@query("revenue_category", f"WITH {P}, {_SIZE}, {_REVENUE} SELECT {_BAND} AS category, count(*) AS companies FROM r GROUP BY 1", "companies")
def _(t):
    return E.estimate_revenue(E.estimate_size(_funded(t))).groupBy(F.col("revenue_category").alias("category")).agg(F.count("*").alias("companies"))


@query("estimate_companies", f"""WITH {P}, {_SIZE}, {_REVENUE} SELECT id, estimated_size, {_BAND} AS revenue_category,
round(CASE WHEN size_confidence > 0 AND revenue_confidence > 0 THEN (size_confidence + revenue_confidence) / 2 WHEN size_confidence > 0 THEN size_confidence * 0.8::DOUBLE WHEN revenue_confidence > 0 THEN revenue_confidence * 0.8::DOUBLE ELSE 0 END, 6) AS confidence FROM r""", "companies")
def _(t):
    return E.estimate_companies(_funded(t)).select("id", "estimated_size", "revenue_category", "confidence")


@query("estimate_contact_value", f"""WITH {P}, {_SIZE}, c AS (SELECT id AS c_id, estimated_size AS c_size FROM s), v AS (SELECT id, round({_VALUE}, 6) AS value_score,
  concat_ws(',', CASE WHEN {_EXEC} THEN 'executive_role' END, CASE WHEN {_DECIDE} THEN 'decision_maker_role' END, CASE WHEN {_INFLUENCE} THEN 'influencer_role' END, CASE WHEN c_id IS NOT NULL THEN 'company_size_factor' END, CASE WHEN seniority_level IS NOT NULL THEN 'seniority_analysis' END) AS value_methods FROM contacts LEFT JOIN c ON company_id = c_id)
SELECT id, value_score, CASE WHEN value_score >= 0.8 THEN 'high' WHEN value_score >= 0.6 THEN 'medium' ELSE 'low' END AS priority, value_methods FROM v""", "companies contacts")
def _(t):
    return E.estimate_contact_value(t.contacts, E.estimate_size(t.companies)).select("id", "value_score", "priority", F.array_join("value_methods", ",").alias("value_methods"))


# ---- enrichment --------------------------------------------------------------------------------------------------------

_IND = f"CASE WHEN {filled('industry')} THEN industry ELSE {N.INDUSTRY_SQL} END"


@query("infer_industry", f"SELECT id, {N.INDUSTRY_SQL} AS inferred_industry, {_IND} AS industry FROM companies", "companies")
def _(t):
    return N.infer_industry(t.companies).select("id", "inferred_industry", "industry")


@query("describe_size", f"SELECT {N.DESCRIBED_SIZE_SQL} AS size, count(*) AS companies FROM companies GROUP BY 1", "companies")
def _(t):
    return N.describe_size(t.companies).groupBy(F.col("described_size").alias("size")).agg(F.count("*").alias("companies"))


_TEXT = "concat(coalesce(description, ''), ' ', coalesce(website, ''))"
_LINKS = {c: f"nullif(regexp_extract({_TEXT}, '{p.removeprefix('(?i)')}', 0, 'i'), '')" for c, p in N.SOCIAL.items()}


@query("social_from_text", "SELECT id, " + ", ".join(f"{sql} AS {c}" for c, sql in _LINKS.items()) + " FROM companies", "companies")
def _(t):
    return N.social_from_text(t.companies).select("id", *N.SOCIAL)


_SITE = f"CASE WHEN {filled('website')} AND NOT regexp_matches(website, '^https?://') THEN concat('https://', website) ELSE website END"


@query("normalize_company", f"SELECT id, {_SITE} AS website, {HOST.format('website')} AS domain FROM companies", "companies")
def _(t):
    return N.normalize_company(t.companies).select("id", "website", "domain")


_ONE = "CAST({} AS INT)"
_CONF = f"round(least(0.5 + 0.1 * ({_ONE.format(filled('industry'))} + CAST(described_size IS NOT NULL AS INT) + CAST(domain IS NOT NULL AS INT)) + 0.05 * CAST(twitter_url IS NOT NULL AS INT) + 0.05 * CAST(facebook_url IS NOT NULL AS INT), 1.0)::DOUBLE, 6)"


@query("company_enrich_confidence", f"WITH n AS (SELECT id, industry, NULL AS described_size, {HOST.format('website')} AS domain, NULL AS twitter_url, NULL AS facebook_url FROM companies) SELECT id, {_CONF} AS enrich_confidence FROM n", "companies")
def _(t):
    return N.company_enrich_confidence(N.normalize_company(t.companies)).select("id", "enrich_confidence")


@query("enrich_companies", f"""WITH n AS (SELECT id, {_IND} AS industry, {N.DESCRIBED_SIZE_SQL} AS described_size, {HOST.format('website')} AS domain, {', '.join(f'{s} AS {c}' for c, s in _LINKS.items())},
concat_ws(',', CASE WHEN NOT {filled('industry')} AND {N.INDUSTRY_SQL} IS NOT NULL THEN 'industry_inference' END, CASE WHEN {N.DESCRIBED_SIZE_SQL} IS NOT NULL THEN 'size_estimation' END, CASE WHEN coalesce({', '.join(_LINKS.values())}) IS NOT NULL THEN 'social_extraction' END) AS sources FROM companies)
SELECT id, industry, described_size, domain, {_CONF} AS enrich_confidence, sources FROM n""", "companies")
def _(t):
    return N.enrich_companies(t.companies).select("id", "industry", "described_size", "domain", "enrich_confidence", F.array_join("sources", ",").alias("sources"))


@query("job_category", f"SELECT {N.JOB_SQL} AS category, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")
def _(t):
    return N.job_category(t.contacts).groupBy(F.col("job_category").alias("category")).agg(F.count("*").alias("contacts"))


@query("title_seniority4", f"SELECT {N.SENIORITY4_SQL} AS seniority, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")
def _(t):
    return N.title_seniority4(t.contacts).groupBy(F.col("title_seniority").alias("seniority")).agg(F.count("*").alias("contacts"))


@query("split_full_name", "SELECT id, string_split(full_name, ' ')[1] AS first_name, array_to_string(string_split(full_name, ' ')[2:], ' ') AS last_name FROM (SELECT id, concat(first_name, ' van ', last_name) AS full_name FROM contacts)", "contacts")
def _(t):
    rows = t.contacts.select("id", F.concat(F.lit("  "), "first_name", F.lit("  van "), "last_name").alias("full_name"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"))
    return N.split_full_name(rows).select("id", "first_name", "last_name")


def _names(t):
    return t.spark.createDataFrame([("mary", "f"), ("John", "m"), ("sam", "any"), ("Sam", "m")], "name string, label string")


@query("first_name_lookup", "SELECT CASE lower(first_name) WHEN 'mary' THEN 'f' WHEN 'john' THEN 'm' WHEN 'sam' THEN 'any' END AS name_label, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")
def _(t):
    return N.first_name_lookup(t.contacts, _names(t)).groupBy("name_label").agg(F.count("*").alias("contacts"))


def _cconf(category: str, seniority: str) -> str:
    return f"round(least(0.5 + 0.1 * ({' + '.join(_ONE.format(filled(c)) for c in ('first_name', 'last_name', 'email'))}) + 0.05 * ({_ONE.format(filled('job_title'))} + CAST({category} IS NOT NULL AS INT) + CAST({seniority} IS NOT NULL AS INT) + {_ONE.format(filled('phone'))}), 1.0)::DOUBLE, 6)"


@query("contact_enrich_confidence", f"SELECT id, {_cconf('NULL', 'seniority_level')} AS enrich_confidence FROM contacts", "contacts")
def _(t):
    return N.contact_enrich_confidence(t.contacts).select("id", "enrich_confidence")


@query("enrich_contacts", f"WITH n AS (SELECT *, {N.JOB_SQL} AS job_category, coalesce(seniority_level, {N.SENIORITY4_SQL}) AS seniority FROM contacts) SELECT id, job_category, seniority AS seniority_level, {_cconf('job_category', 'seniority')} AS enrich_confidence FROM n", "contacts")
def _(t):
    return N.enrich_contacts(t.contacts, _names(t)).select("id", "job_category", "seniority_level", "enrich_confidence")
