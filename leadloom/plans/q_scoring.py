"""Queries: lead scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from .q_select import HOST
from .registry import query
from .views import AS_OF


#: The rules once more, by hand, over a contact joined to its company (columns ``c_``): part, weight and value of each category.
_DAYS = f"date_diff('day', last_activity_date, TIMESTAMP '{AS_OF}')"
_TITLE = "lower(coalesce(job_title, ''))"


def _title(*patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({_TITLE}, '{p}')" for p in patterns) + ")"


_LEVEL = f"""CASE WHEN {_title(r'(^|[^a-z0-9_])(ceo|cto|cfo|coo|cmo|cpo|chief|president|founder|owner)($|[^a-z0-9_])')} THEN 'c_level'
  WHEN {_title(r'(^|[^a-z0-9_])(vp|vice president|evp|svp)($|[^a-z0-9_])')} THEN 'vp_level' WHEN {_title(r'(^|[^a-z0-9_])(director|head of|lead)($|[^a-z0-9_])')} THEN 'director'
  WHEN {_title(r'(^|[^a-z0-9_])(manager|supervisor)($|[^a-z0-9_])')} THEN 'manager' WHEN {_title(r'(^|[^a-z0-9_])(senior|principal)($|[^a-z0-9_])', r'(^|[^a-z0-9_])sr[.][a-z0-9_]')} THEN 'senior'
  WHEN {_title(r'(^|[^a-z0-9_])(junior|associate|assistant)($|[^a-z0-9_])', r'(^|[^a-z0-9_])jr[.][a-z0-9_]')} THEN 'junior' WHEN {_title(r'(^|[^a-z0-9_])(intern|trainee)($|[^a-z0-9_])')} THEN 'intern' ELSE 'unknown' END"""
_SIZE = """CASE WHEN c_employee_count IS NOT NULL THEN (CASE WHEN c_employee_count > 1000 THEN 'enterprise' WHEN c_employee_count > 200 THEN 'large' WHEN c_employee_count > 50 THEN 'medium' WHEN c_employee_count > 10 THEN 'small' ELSE 'startup' END)
  WHEN regexp_matches(lower(c_company_size), 'startup|1-10|micro') THEN 'startup' WHEN regexp_matches(lower(c_company_size), 'small|11-50|10-50') THEN 'small' WHEN regexp_matches(lower(c_company_size), 'medium|51-200|50-200') THEN 'medium'
  WHEN regexp_matches(lower(c_company_size), 'large|201-1000|200-1000') THEN 'large' WHEN regexp_matches(lower(c_company_size), 'enterprise|1000[+]|fortune') THEN 'enterprise' ELSE 'unknown' END"""
_MODERN = "['react', 'vue', 'angular', 'node.js', 'python', 'aws', 'azure', 'kubernetes', 'docker', 'microservices', 'api', 'cloud', 'machine learning', 'ai', 'blockchain', 'saas']"
HAND = {
    "contact_completeness": (
        ("email", 0.25, "CASE WHEN email IS NULL THEN 0 WHEN email LIKE '%@%' AND email LIKE '%.%' THEN 1 ELSE 0.5 END"),
        ("phone", 0.20, "CASE WHEN phone IS NULL THEN 0 WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN 1 ELSE 0.7 END"),
        ("full_name", 0.15, "least(1.0::DOUBLE, length(trim(first_name || ' ' || last_name)) / 20.0::DOUBLE)"),
        ("job_title", 0.15, "CASE WHEN job_title IS NULL THEN 0 ELSE least(1.0::DOUBLE, length(trim(job_title)) / 20.0::DOUBLE) END"),
        ("linkedin_url", 0.10, "CASE WHEN linkedin_url IS NULL THEN 0 WHEN lower(linkedin_url) LIKE '%linkedin.com%' THEN 1 ELSE 0.5 END"),
        ("department", 0.05, "CASE WHEN department IS NULL THEN 0 ELSE least(1.0::DOUBLE, length(department) / 10.0::DOUBLE) END"),
        ("location", 0.05, "0"),
        ("bio", 0.05, "0"),
    ),
    "business_indicators": (
        ("seniority", 0.30, f"CASE {_LEVEL} WHEN 'c_level' THEN 1.0 WHEN 'vp_level' THEN 0.9 WHEN 'director' THEN 0.8 WHEN 'manager' THEN 0.6 WHEN 'senior' THEN 0.4 WHEN 'junior' THEN 0.2 WHEN 'intern' THEN 0.1 ELSE 0.3 END"),
        ("company_size", 0.25, f"CASE {_SIZE} WHEN 'enterprise' THEN 1.0 WHEN 'large' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'small' THEN 0.4 WHEN 'startup' THEN 0.3 ELSE 0.2 END"),
        ("industry", 0.15, "CASE WHEN regexp_matches(lower(coalesce(c_industry, '')), 'technology|software|fintech|healthcare|artificial intelligence|machine learning|cybersecurity|cloud computing|saas|e-commerce|digital marketing') THEN 1.0 ELSE 0.5 END"),
        ("decision_maker", 0.15, "CASE WHEN is_decision_maker THEN 1.0 ELSE 0.3 END"),
        ("revenue", 0.10, "CASE WHEN regexp_matches(lower(c_revenue_range), 'billion|[$]1b[+]|>1b') THEN 1.0 WHEN regexp_matches(lower(c_revenue_range), 'million|[$]100m[+]|>100m') THEN 0.8 WHEN regexp_matches(lower(c_revenue_range), '[$]10m[+]|>10m') THEN 0.6 WHEN regexp_matches(lower(c_revenue_range), '[$]1m[+]|>1m') THEN 0.4 ELSE 0.2 END"),
        ("growth_signals", 0.05, "CASE WHEN c_id IS NULL THEN 0.2::DOUBLE ELSE least(1.0::DOUBLE, ((c_id % 2 = 0)::INT + (c_id % 3 = 0)::INT + (c_id % 5 = 0)::INT) * 2 / 9.0::DOUBLE) END"),
    ),
    "data_quality": (
        ("verification", 0.25, "CASE WHEN is_verified THEN 1.0 ELSE 0.3 END"),
        ("freshness", 0.20, f"CASE WHEN last_activity_date IS NULL THEN 0.3 WHEN {_DAYS} > 365 THEN 0.2 WHEN {_DAYS} > 180 THEN 0.4 WHEN {_DAYS} > 90 THEN 0.6 WHEN {_DAYS} > 30 THEN 0.8 ELSE 1.0 END"),
        ("source_reliability", 0.15, "CASE source WHEN 'linkedin' THEN 0.9 WHEN 'company_website' THEN 0.8 ELSE 0.5 END"),
        ("consistency", 0.15, "CASE WHEN email IS NOT NULL AND c_domain IS NOT NULL AND NOT contains(lower(split_part(email, '@', -1)), c_domain) THEN 0.7 ELSE 1.0 END"),
        ("contact_quality", 0.15, "coalesce(contact_quality_score, 0.5)"),
        ("company_quality", 0.10, "coalesce(c_data_quality_score, 0.5)"),
    ),
    "engagement_potential": (
        ("social_presence", 0.25, "CASE WHEN linkedin_url IS NULL THEN 0 ELSE 0.6 END"),
        ("professional_activity", 0.25, f"least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN {_DAYS} <= 7 THEN 0.3::DOUBLE WHEN {_DAYS} <= 30 THEN 0.2::DOUBLE WHEN {_DAYS} <= 90 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN experience_years > 5 THEN 0.1::DOUBLE ELSE 0 END)"),
        ("company_engagement", 0.20, "least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN c_id % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN c_website IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + least(0.1::DOUBLE, coalesce(c_n_tech, 0) * 0.02::DOUBLE))"),
        ("accessibility", 0.15, "CASE WHEN email IS NULL THEN 0 ELSE 0.5 END + CASE WHEN phone IS NULL THEN 0 ELSE 0.3 END + CASE WHEN linkedin_url IS NULL THEN 0 ELSE 0.2 END"),
        ("existing_engagement", 0.15, "coalesce(engagement_potential, 0.5)"),
    ),
    "company_profile": (
        ("maturity", 0.30, "CASE WHEN c_founded_year IS NULL THEN 0.5 WHEN c_founded_year > 2022 THEN 0.2 WHEN c_founded_year > 2019 THEN 0.4 WHEN c_founded_year > 2014 THEN 0.6 WHEN c_founded_year > 2004 THEN 0.8 ELSE 1.0 END"),
        ("technology", 0.25, f"CASE WHEN coalesce(c_n_tech, 0) = 0 THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, len(list_filter({_MODERN}, lambda m: len(list_filter(c_tech, lambda t: contains(m, t))) > 0)) / 5.0::DOUBLE) END"),
        ("market_position", 0.25, "least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN lower(c_revenue_range) LIKE '%billion%' THEN 0.3::DOUBLE WHEN lower(c_revenue_range) LIKE '%million%' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c_employee_count > 1000 THEN 0.2::DOUBLE WHEN c_employee_count > 100 THEN 0.1::DOUBLE ELSE 0 END)"),
        ("innovation", 0.20, "least(1.0::DOUBLE, 0.3::DOUBLE + coalesce((c_id % 3 = 0)::INT + (c_id % 5 = 0)::INT, 0) * 0.15::DOUBLE + CASE WHEN c_n_tech > 10 THEN 0.2::DOUBLE WHEN c_n_tech > 5 THEN 0.1::DOUBLE ELSE 0 END)"),
    ),
}
WEIGHTS = {"contact_completeness": 0.25, "business_indicators": 0.30, "data_quality": 0.20, "engagement_potential": 0.15, "company_profile": 0.10}
GRADE = "CASE WHEN {0} < 40 THEN 'F' WHEN {0} < 50 THEN 'D' WHEN {0} < 55 THEN 'C-' WHEN {0} < 60 THEN 'C' WHEN {0} < 65 THEN 'C+' WHEN {0} < 70 THEN 'B-' WHEN {0} < 75 THEN 'B' WHEN {0} < 80 THEN 'B+' WHEN {0} < 85 THEN 'A-' WHEN {0} < 90 THEN 'A' ELSE 'A+' END".format("score_percentage")
ROWS = f"""
c AS (SELECT id AS c_id, website AS c_website, industry AS c_industry, employee_count AS c_employee_count, company_size AS c_company_size, revenue_range AS c_revenue_range, founded_year AS c_founded_year, data_quality_score AS c_data_quality_score,
  {HOST.format('website')} AS c_domain, string_split(lower(technologies_csv), ',') AS c_tech, len(string_split(technologies_csv, ',')) AS c_n_tech FROM companies),
r AS (SELECT k.*, c.* FROM contacts k LEFT JOIN c ON k.company_id = c.c_id)"""


def _category(category: str) -> str:
    return "(" + " + ".join(f"CAST({value} AS DOUBLE) * {weight}::DOUBLE" for _, weight, value in HAND[category]) + ")"


def _scores(weights: dict[str, float]) -> str:
    total = "(" + " + ".join(f"{_category(c)} * {x}::DOUBLE" for c, x in weights.items()) + ")"
    return f"WITH {ROWS}, t AS (SELECT *, {total} AS total FROM r), s AS (SELECT company_id, id AS contact_id, round(total, 6) AS total_score, round(total * 100, 4) AS score_percentage FROM t)"


def _rows(t):
    from ..operators.select import host

    return t.contacts, t.companies.withColumn("domain", host("website"))


@query("seniority8", f"SELECT {_LEVEL} AS seniority, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")
def _(t):
    return t.contacts.groupBy(F.expr(S.SENIORITY_SQL).alias("seniority")).agg(F.count("*").alias("contacts"))


@query("size_class6", f"WITH c AS (SELECT employee_count AS c_employee_count, company_size AS c_company_size FROM companies) SELECT {_SIZE} AS size, count(*) AS companies FROM c GROUP BY 1", "companies")
def _(t):
    c = t.companies.select(F.col("employee_count").alias("c_employee_count"), F.col("company_size").alias("c_company_size"))
    return c.groupBy(F.expr(S.SIZE_SQL).alias("size")).agg(F.count("*").alias("companies"))


for _name, _cat in (("score_contact_completeness", "contact_completeness"), ("score_business_indicators", "business_indicators"), ("score_data_quality", "data_quality"), ("score_engagement", "engagement_potential"), ("score_company_profile", "company_profile")):
    _parts = ", ".join(f"CAST({value} AS DOUBLE) AS p_{part}" for part, _, value in HAND[_cat])

    @query(_name, f"WITH {ROWS} SELECT id, round({_category(_cat)}, 6) AS score, {_parts} FROM r", "companies contacts")
    def _(t, category=_cat):
        rows = S.score_category(S.lead_rows(*_rows(t), AS_OF), category)
        return rows.select("id", F.col(category).alias("score"), *[F.col(f"{category}_parts.{p}").alias(f"p_{p}") for p, _, _ in S.PARTS[category]])


@query("score_leads", _scores(WEIGHTS) + f" SELECT *, {GRADE} AS grade FROM s", "companies contacts")
def _(t):
    return S.score_leads(*_rows(t), AS_OF).select("company_id", "contact_id", "total_score", "score_percentage", "grade")


@query("score_grade", _scores(WEIGHTS) + f" SELECT {GRADE} AS grade, count(*) AS leads FROM s GROUP BY 1", "companies contacts")
def _(t):
    return S.score_leads(*_rows(t), AS_OF).groupBy("grade").agg(F.count("*").alias("leads"))


CUSTOM = {"contact_completeness": 0.2, "business_indicators": 0.2, "data_quality": 0.2, "engagement_potential": 0.2, "company_profile": 0.2}


@query("score_custom_weights", _scores(CUSTOM) + " SELECT contact_id, total_score FROM s", "companies contacts")
def _(t):
    return S.score_leads(*_rows(t), AS_OF, weights=CUSTOM).select("contact_id", "total_score")


_AVG = "CAST(sum(CAST({0} AS DECIMAL(24,6))) AS DOUBLE) / count(*)"


@query("scoring_summary", _scores(WEIGHTS) + f""", g AS (SELECT *, {GRADE} AS grade FROM s)
SELECT unnest(['total_leads', 'average_score', 'average_percentage', 'min_score', 'max_score', 'high', 'medium', 'low']) AS metric, unnest([n, a, p, lo, hi, h, m, l]) AS value FROM (SELECT CAST(count(*) AS DOUBLE) n, round({_AVG.format('total_score')}, 6) a, round({_AVG.format('score_percentage')}, 4) p, min(total_score) lo, max(total_score) hi,
  CAST(count(*) FILTER (score_percentage >= 70) AS DOUBLE) h, CAST(count(*) FILTER (score_percentage >= 40 AND score_percentage < 70) AS DOUBLE) m, CAST(count(*) FILTER (score_percentage < 40) AS DOUBLE) l FROM g)
UNION ALL SELECT 'grade:' || grade, CAST(count(*) AS DOUBLE) FROM g GROUP BY grade""", "companies contacts")
def _(t):
    return S.scoring_summary(S.score_leads(*_rows(t), AS_OF))


@query("score_batch_summary", _scores(WEIGHTS) + f" SELECT count(*) AS leads, round({_AVG.format('score_percentage')}, 4) AS average, count(*) FILTER (score_percentage >= 80) AS high_quality FROM s", "companies contacts")
def _(t):
    return S.score_batch_summary(S.score_leads(*_rows(t), AS_OF))


def _spec() -> str:
    tests = {
        "email_found": "m", "phone_found": "p", "decision_maker_contact": "d", "multiple_contacts": "n > 1", "company_size_match": "company_size IN ('51-200', '201-500')", "industry_relevance": "industry IN ('Software Development', 'Finance')",
        "technology_match": "list_has_any(string_split(technologies_csv, ','), ['Python', 'AWS'])", "growth_signal": "(id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0)", "verified_email": "v", "active_website": "website IS NOT NULL", "recent_activity": "r",
        "social_presence": "(l OR id % 3 = 0)", "job_postings_active": "id % 2 = 0", "funding_news": "id % 3 = 0", "expansion_signals": "id % 5 = 0",
    }
    parts = ["(" + " + ".join(f"CASE WHEN {tests[x]} THEN {n} ELSE 0 END" for x, n in points) + f") * CAST({100.0 * w / sum(n for _, n in points)!r} AS DOUBLE)" for w, points in S.SPEC.values()]
    return f"""WITH k AS (SELECT company_id, bool_or(email IS NOT NULL) m, bool_or(phone IS NOT NULL) p, bool_or(is_decision_maker) d, count(*) n, bool_or(email IS NOT NULL AND is_verified) v, bool_or(last_activity_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) r, bool_or(linkedin_url IS NOT NULL) l FROM contacts GROUP BY 1),
s AS (SELECT id, round({' + '.join(parts)}, 4) AS score FROM companies LEFT JOIN k ON id = company_id) SELECT id, score, CASE WHEN score >= 80 THEN 'hot' WHEN score >= 60 THEN 'warm' WHEN score >= 40 THEN 'cold' ELSE 'poor' END AS band FROM s"""


@query("spec_score", _spec(), "companies contacts")
def _(t):
    return S.spec_score(t.companies, t.contacts, AS_OF)
