"""Estimates of company size and revenue and of contact value: expression chains over one row, no shuffle but the contact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_in, filled, first_of, hits_in, most_hits
from .scoring import with_columns

#: Size words of descriptions, then of technologies, in order.
SIZE_WORDS = {
    "startup": ("startup", "founded", "early stage", "seed", "pre-seed", "stealth", "emerging", "new venture", "bootstrap"),
    "small": ("small", "boutique", "local", "family", "independent", "artisan", "craft", "niche", "specialized"),
    "medium": ("growing", "expanding", "regional", "mid-size", "established", "mature", "scaling"),
    "large": ("large", "major", "leading", "prominent", "significant", "substantial", "nationwide", "multi-location"),
    "enterprise": ("enterprise", "global", "international", "fortune", "multinational", "corporation", "conglomerate", "worldwide", "industry leader", "market leader"),
}
SIZE_TECHNOLOGIES = {
    "startup": ("mvp", "prototype", "beta", "stealth mode", "pre-launch", "proof of concept"),
    "small": ("wordpress", "squarespace", "wix", "shopify basic", "basic hosting", "shared hosting"),
    "medium": ("dedicated server", "cloud hosting", "cdn", "professional email", "crm system"),
    "large": ("enterprise software", "custom development", "multiple domains", "advanced analytics"),
    "enterprise": ("enterprise architecture", "microservices", "kubernetes", "enterprise security", "data centers", "global infrastructure"),
}
SIZE_RANGES = {"startup": (1, 10), "small": (11, 50), "medium": (51, 250), "large": (251, 1000), "enterprise": (1001, 10000)}
LARGE_INDUSTRIES = ("finance", "banking", "insurance", "automotive", "energy")
SMALL_INDUSTRIES = ("consulting", "design", "marketing", "freelance")
HUBS = ("new york", "san francisco", "london", "tokyo", "singapore")
GENERIC_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")
MULTIPLIERS = {"technology": 200000, "finance": 300000, "healthcare": 150000, "consulting": 180000, "manufacturing": 120000, "retail": 80000, "education": 60000, "nonprofit": 40000}
DEFAULT_MULTIPLIER = 150000
#: Least, largest and estimate by size class.
SIZE_REVENUE = {"startup": (0, 500000, 250000), "small": (100000, 5000000, 2550000), "medium": (1000000, 50000000, 25500000), "large": (10000000, 500000000, 255000000), "enterprise": (50000000, 500000000, 100000000)}
ENTERPRISE_TECH = ("kubernetes", "microservices", "enterprise", "oracle", "salesforce", "sap", "aws enterprise", "azure enterprise")
MID_TECH = ("aws", "azure", "google cloud", "docker", "redis", "postgresql", "mongodb", "elasticsearch")
BASIC_TECH = ("wordpress", "shopify", "squarespace", "wix", "basic hosting", "shared hosting")
REVENUE_BANDS = (("under_1m", 1000000), ("1m_10m", 10000000), ("10m_50m", 50000000), ("50m_100m", 100000000), ("100m_500m", 500000000), ("500m_1b", 1000000000))

# ---- rules over: employee_count, description, tech_text, website, email, n_social, industry, city, funding_amount, estimated_size

SIZE_FROM_EMPLOYEES = first_of([("employee_count IS NULL", "NULL"), ("employee_count <= 10", "'startup'"), ("employee_count <= 50", "'small'"), ("employee_count <= 250", "'medium'"), ("employee_count <= 1000", "'large'")], "'enterprise'")
SIZE_FROM_KEYWORDS = most_hits("description", SIZE_WORDS)
SIZE_FROM_TECH = most_hits("tech_text", SIZE_TECHNOLOGIES)
MAIL_DOMAIN = "lower(split_part(email, '@', 2))"
WEB_POINTS = (
    f"(CASE WHEN {filled('website')} THEN 1 ELSE 0 END + CASE WHEN coalesce(website LIKE 'https://%', false) THEN 1 ELSE 0 END + "
    f"CASE WHEN coalesce(contains(email, '@') AND {MAIL_DOMAIN} NOT IN ({', '.join(repr(d) for d in GENERIC_MAIL)}), false) THEN 2 ELSE 0 END + "
    "CASE WHEN n_social >= 3 THEN 2 WHEN n_social >= 1 THEN 1 ELSE 0 END + CASE WHEN coalesce(length(website) - length(replace(website, '.', '')), 0) >= 2 THEN 1 ELSE 0 END)"
)
SIZE_FROM_WEB = f"CASE WHEN {WEB_POINTS} >= 6 THEN 'large' WHEN {WEB_POINTS} >= 4 THEN 'medium' WHEN {WEB_POINTS} >= 2 THEN 'small' ELSE 'startup' END"
SIZE_FROM_CONTEXT = first_of([(any_in("industry", LARGE_INDUSTRIES), "'large'"), (any_in("industry", SMALL_INDUSTRIES), "'small'"), (any_in("city", HUBS), "'medium'")])
#: Method, its estimate and its confidence, in order.
SIZE_METHODS = (("employee_count", SIZE_FROM_EMPLOYEES, 0.9), ("keyword_analysis", SIZE_FROM_KEYWORDS, 0.6), ("technology_analysis", SIZE_FROM_TECH, 0.5), ("website_complexity", SIZE_FROM_WEB, 0.4), ("context_analysis", SIZE_FROM_CONTEXT, 0.3))

MULTIPLIER = first_of([(f"lower(industry) = '{k}'", str(v)) for k, v in MULTIPLIERS.items()], str(DEFAULT_MULTIPLIER))
REVENUE_FROM_EMPLOYEES = f"CASE WHEN coalesce(employee_count, 0) <> 0 AND {filled('industry')} THEN CAST(employee_count AS BIGINT) * {MULTIPLIER} END"


def _size_revenue(k: int) -> str:
    return first_of([(f"estimated_size = '{s}'", f"CAST({v[k]} AS BIGINT)") for s, v in SIZE_REVENUE.items()])


def _tech_revenue(values: tuple[int, int, int, int]) -> str:
    e, m, b = (hits_in("tech_text", w) for w in (ENTERPRISE_TECH, MID_TECH, BASIC_TECH))
    return first_of([(f"{e} > 0", f"CAST({values[0]} AS BIGINT)"), (f"{m} > 2", f"CAST({values[1]} AS BIGINT)"), (f"{m} > 0", f"CAST({values[2]} AS BIGINT)"), (f"{b} > 0", f"CAST({values[3]} AS BIGINT)")])


def _funding(early: str, growth: str, late: str) -> str:
    part = lambda x: f"CAST(floor(CAST(funding_amount AS DOUBLE) * {x}) AS BIGINT)"
    return first_of([("coalesce(funding_amount, 0) = 0", "NULL"), ("funding_amount < 1000000", part(early)), ("funding_amount < 10000000", part(growth))], part(late))


#: Method, (least, largest, estimate) and confidence.
REVENUE_METHODS = (
    ("employee_industry_model", (f"CAST(floor({REVENUE_FROM_EMPLOYEES} * 0.5) AS BIGINT)", f"CAST(floor({REVENUE_FROM_EMPLOYEES} * 1.5) AS BIGINT)", REVENUE_FROM_EMPLOYEES), 0.7),
    ("size_based_model", (_size_revenue(0), _size_revenue(1), _size_revenue(2)), 0.5),
    ("technology_analysis", (_tech_revenue((10000000, 1000000, 100000, 10000)), _tech_revenue((500000000, 50000000, 10000000, 1000000)), _tech_revenue((50000000, 10000000, 2000000, 200000))), 0.4),
    ("funding_based_model", (_funding("0.1", "0.3", "0.8"), _funding("0.5", "1.5", "3.0"), _funding("0.3", "0.9", "1.9")), 0.6),
)


def category_sql(column: str) -> str:
    """Revenue band; an edge belongs to the lower band."""
    return first_of([(f"{column} IS NULL", "NULL"), *((f"{column} <= {top}", f"'{name}'") for name, top in REVENUE_BANDS)], "'over_1b'")


def mean_sql(methods: list[tuple[str, float]]) -> str:
    """Mean confidence of the methods that answer; 0 without any."""
    n = "(" + " + ".join(f"CASE WHEN {sql} IS NOT NULL THEN 1 ELSE 0 END" for sql, _ in methods) + ")"
    total = "(" + " + ".join(f"CASE WHEN {sql} IS NOT NULL THEN CAST({c} AS DOUBLE) ELSE 0 END" for sql, c in methods) + ")"
    return f"CASE WHEN {n} = 0 THEN CAST(0 AS DOUBLE) ELSE {total} / {n} END"


# ---- operators ---------------------------------------------------------------------------------------------------------


def prepared(companies: DataFrame) -> DataFrame:
    """``companies`` with what the rules read: technologies as one text, number of social links, funding."""
    c = with_columns(companies, technologies="array<string>", social_media="map<string,string>", funding_amount="long", city="string", description="string", website="string", email="string", industry="string", employee_count="int")
    return c.withColumns({"tech_text": F.array_join("technologies", " "), "n_social": F.greatest(F.coalesce(F.size(F.map_keys("social_media")), F.lit(0)), F.lit(0))})


def _with(companies: DataFrame, name: str, sql: str) -> DataFrame:
    return prepared(companies).withColumn(name, F.expr(sql)).drop("tech_text", "n_social")


def size_from_employees(companies: DataFrame) -> DataFrame:
    return _with(companies, "size", SIZE_FROM_EMPLOYEES)


def size_from_keywords(companies: DataFrame) -> DataFrame:
    return _with(companies, "size", SIZE_FROM_KEYWORDS)


def size_from_technologies(companies: DataFrame) -> DataFrame:
    return _with(companies, "size", SIZE_FROM_TECH)


def size_from_web_presence(companies: DataFrame) -> DataFrame:
    return _with(companies, "size", SIZE_FROM_WEB)


def size_from_context(companies: DataFrame) -> DataFrame:
    return _with(companies, "size", SIZE_FROM_CONTEXT)


def _methods(methods: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(sql).isNotNull(), name) for name, sql in methods]))


def estimate_size(companies: DataFrame) -> DataFrame:
    """``companies`` with ``estimated_size, size_min, size_max, size_methods, size_confidence``; an earlier estimate is kept over later methods."""
    given = "estimated_size" if "estimated_size" in companies.columns else "NULL"
    made = [f"__size{k}" for k in range(len(SIZE_METHODS))]
    c = prepared(companies).withColumns({m: F.expr(sql) for m, (_, sql, _) in zip(made, SIZE_METHODS, strict=True)})
    size = f"coalesce({made[0]}, {given}, {', '.join(made[1:])})"
    c = c.withColumns({
        "size_methods": _methods([(n, m) for m, (n, _, _) in zip(made, SIZE_METHODS, strict=True)]), "estimated_size": F.expr(size),
        "size_confidence": F.round(F.expr(mean_sql([(m, w) for m, (_, _, w) in zip(made, SIZE_METHODS, strict=True)])), 6),
    }).drop(*made)
    lo, hi = (F.expr(first_of([(f"estimated_size = '{s}'", str(r[k])) for s, r in SIZE_RANGES.items()])) for k in (0, 1))
    return c.withColumns({"size_min": lo, "size_max": hi}).drop("tech_text", "n_social")


def _struct(sql: tuple[str, str, str]) -> Column:
    return F.when(F.expr(sql[2]).isNotNull(), F.struct(F.expr(sql[0]).alias("min"), F.expr(sql[1]).alias("max"), F.expr(sql[2]).alias("estimate")))


def revenue_from(companies: DataFrame, method: str) -> DataFrame:
    """``companies`` with ``revenue`` struct(min, max, estimate) by one method, null if it has no answer."""
    sql = next(s for n, s, _ in REVENUE_METHODS if n == method)
    return with_columns(prepared(companies), estimated_size="string").withColumn("revenue", _struct(sql)).drop("tech_text", "n_social")


def estimate_revenue(companies: DataFrame) -> DataFrame:
    """``companies`` (with estimated_size, if any) with ``revenue, revenue_category, revenue_methods, revenue_confidence``."""
    c = with_columns(prepared(companies), estimated_size="string")
    made = [f"__revenue{k}" for k in range(len(REVENUE_METHODS))]
    c = c.withColumns({m: _struct(sql) for m, (_, sql, _) in zip(made, REVENUE_METHODS, strict=True)})
    c = c.withColumns({
        "revenue": F.coalesce(*made), "revenue_methods": _methods([(n, m) for m, (n, _, _) in zip(made, REVENUE_METHODS, strict=True)]),
        "revenue_confidence": F.round(F.expr(mean_sql([(m, w) for m, (_, _, w) in zip(made, REVENUE_METHODS, strict=True)])), 6),
    }).drop(*made)
    return c.withColumn("revenue_category", F.expr(category_sql("revenue.estimate"))).drop("tech_text", "n_social")


def estimate_companies(companies: DataFrame) -> DataFrame:
    """Size, then revenue from it; combined ``confidence``, less a fifth if one of the two is missing."""
    c = estimate_revenue(estimate_size(companies))
    a, b = F.col("size_confidence"), F.col("revenue_confidence")
    both = F.when((a > 0) & (b > 0), (a + b) / 2).when(a > 0, a * 0.8).when(b > 0, b * 0.8).otherwise(0.0)
    return c.withColumns({"methods": F.concat("size_methods", "revenue_methods"), "confidence": F.round(both, 6)})


EXECUTIVE = ("ceo", "cto", "cfo", "coo", "president", "founder", "owner")
DECIDER = ("director", "vp", "vice president", "head", "manager")
INFLUENCER = ("lead", "senior", "principal", "architect")
VALUE = (
    f"least(1.0, CAST(0.5 AS DOUBLE) + CASE WHEN {any_in('job_title', EXECUTIVE)} THEN 0.4 ELSE 0 END + CASE WHEN {any_in('job_title', DECIDER)} THEN 0.3 ELSE 0 END + CASE WHEN {any_in('job_title', INFLUENCER)} THEN 0.2 ELSE 0 END + "
    "CASE WHEN c_size = 'enterprise' THEN 0.2 WHEN c_size = 'large' THEN 0.15 WHEN c_size = 'medium' THEN 0.1 ELSE 0 END + "
    "CASE lower(seniority_level) WHEN 'executive' THEN 0.15 WHEN 'senior' THEN 0.1 WHEN 'mid' THEN 0.05 ELSE 0 END)"
)
VALUE_METHODS = (("executive_role", any_in("job_title", EXECUTIVE)), ("decision_maker_role", any_in("job_title", DECIDER)), ("influencer_role", any_in("job_title", INFLUENCER)), ("company_size_factor", "c_id IS NOT NULL"), ("seniority_analysis", filled("seniority_level")))


def estimate_contact_value(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """``contacts`` with ``value_score, priority, value_methods``, from title, seniority and the size of the company (by company_id)."""
    c = companies.select(F.col("id").alias("c_id"), F.col("estimated_size").alias("c_size"))
    rows = contacts.join(c, F.col("company_id") == F.col("c_id"), "left").withColumn("value_score", F.round(F.expr(VALUE), 6))
    s = F.col("value_score")
    methods = F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in VALUE_METHODS]))
    return rows.withColumns({"priority": F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low"), "value_methods": methods}).drop("c_id", "c_size")
