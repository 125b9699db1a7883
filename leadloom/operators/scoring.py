"""Lead scoring: five weighted categories per contact of a company, and summaries.

All scores are expressions over one joined row (contact columns as they are, company columns prefixed ``c_``), so a job is one
equi-join and a projection inside code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..functions.rules import any_in, filled, first_of, matches

#: Category weights; they must sum to 1.
WEIGHTS = {"contact_completeness": 0.25, "business_indicators": 0.30, "data_quality": 0.20, "engagement_potential": 0.15, "company_profile": 0.10}

#: Title patterns by level, first match wins.
SENIORITY = (
    ("c_level", (r"\b(ceo|cto|cfo|coo|cmo|cpo|chief)\b", r"\bpresident\b", r"\bfounder\b", r"\bowner\b")),
    ("vp_level", (r"\b(vp|vice president)\b", r"\bevp\b", r"\bsvp\b")),
    ("director", (r"\bdirector\b", r"\bhead of\b", r"\blead\b")),
    ("manager", (r"\bmanager\b", r"\bsupervisor\b", r"\bteam lead\b")),
    ("senior", (r"\bsenior\b", r"\bsr\.\b", r"\bprincipal\b")),
    ("junior", (r"\bjunior\b", r"\bjr\.\b", r"\bassociate\b", r"\bassistant\b")),
    ("intern", (r"\bintern\b", r"\btrainee\b")),
)
SENIORITY_SCORES = {"c_level": 1.0, "vp_level": 0.9, "director": 0.8, "manager": 0.6, "senior": 0.4, "junior": 0.2, "intern": 0.1, "unknown": 0.3}
SIZE_SCORES = {"enterprise": 1.0, "large": 0.8, "medium": 0.6, "small": 0.4, "startup": 0.3, "unknown": 0.2}
SIZE_WORDS = (
    ("startup", ("startup", "1-10", "micro")), ("small", ("small", "11-50", "10-50")), ("medium", ("medium", "51-200", "50-200")),
    ("large", ("large", "201-1000", "200-1000")), ("enterprise", ("enterprise", "1000+", "fortune")),
)
HIGH_VALUE_INDUSTRIES = (
    "technology", "software", "fintech", "healthcare", "biotechnology", "artificial intelligence", "machine learning", "cybersecurity", "cloud computing",
    "saas", "e-commerce", "digital marketing",
)
POSITIVE_SIGNALS = ("hiring", "expansion", "funding", "new_product", "partnership", "acquisition", "ipo", "revenue_growth", "market_expansion")
INNOVATION_SIGNALS = ("new_product", "partnership", "funding", "expansion")
SOURCE_SCORES = {"linkedin": 0.9, "company_website": 0.8, "google_my_business": 0.7, "crunchbase": 0.8, "apollo": 0.7, "zoominfo": 0.7}
MODERN = ("react", "vue", "angular", "node.js", "python", "aws", "azure", "kubernetes", "docker", "microservices", "api", "cloud", "machine learning", "ai", "blockchain", "saas")
GRADES = ((90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "B-"), (60, "C+"), (55, "C"), (50, "C-"), (40, "D"))

# ---- rules as SQL text -------------------------------------------------------------------------------------------------

SENIORITY_SQL = first_of([(" OR ".join(matches("lower(job_title)", p) for p in patterns), f"'{level}'") for level, patterns in SENIORITY], "'unknown'")
SIZE_SQL = first_of([
    ("c_employee_count <= 10", "'startup'"), ("c_employee_count <= 50", "'small'"), ("c_employee_count <= 200", "'medium'"), ("c_employee_count <= 1000", "'large'"),
    ("c_employee_count > 1000", "'enterprise'"), *((any_in("c_company_size", words), f"'{size}'") for size, words in SIZE_WORDS),
], "'unknown'")


def _score_of(sql: str, scores: dict[str, float]) -> str:
    return f"CASE {sql} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.items()) + " END"


def _long(column: str, full: int) -> str:
    return f"CASE WHEN {filled(column)} THEN least(1.0, length(trim({column})) / {full}.0) ELSE 0 END"


#: Parts of each category: (name, weight, expression).
PARTS = {
    "contact_completeness": (
        ("email", 0.25, f"CASE WHEN NOT {filled('email')} THEN 0 WHEN contains(email, '@') AND contains(email, '.') THEN 1.0 ELSE 0.5 END"),
        ("phone", 0.20, f"CASE WHEN NOT {filled('phone')} THEN 0 WHEN phone_digits >= 10 THEN 1.0 ELSE 0.7 END"),
        ("full_name", 0.15, _long("full_name", 20)),
        ("job_title", 0.15, _long("job_title", 20)),
        ("linkedin_url", 0.10, f"CASE WHEN NOT {filled('linkedin_url')} THEN 0 WHEN contains(lower(linkedin_url), 'linkedin.com') THEN 1.0 ELSE 0.5 END"),
        ("department", 0.05, _long("department", 10)),
        ("location", 0.05, _long("contact_location", 10)),
        ("bio", 0.05, _long("bio", 10)),
    ),
    "business_indicators": (
        ("seniority", 0.30, _score_of(SENIORITY_SQL, SENIORITY_SCORES)),
        ("company_size", 0.25, _score_of(SIZE_SQL, SIZE_SCORES)),
        ("industry", 0.15, f"CASE WHEN {any_in('c_industry', HIGH_VALUE_INDUSTRIES)} THEN 1.0 ELSE 0.5 END"),
        ("decision_maker", 0.15, "CASE WHEN is_decision_maker THEN 1.0 ELSE 0.3 END"),
        ("revenue", 0.10, first_of([(any_in("c_revenue_range", ("billion", "$1b+", ">1b")), "1.0"), (any_in("c_revenue_range", ("million", "$100m+", ">100m")), "0.8"), (any_in("c_revenue_range", ("$10m+", ">10m")), "0.6"), (any_in("c_revenue_range", ("$1m+", ">1m")), "0.4")], "0.2")),
        ("growth_signals", 0.05, "CASE WHEN c_n_signals_known = 0 THEN 0.2 ELSE least(1.0, c_n_signals * 2 / 9.0) END"),
    ),
    "data_quality": (
        ("verification", 0.25, "CASE WHEN is_verified THEN 1.0 ELSE 0.3 END"),
        ("freshness", 0.20, "CASE WHEN days_old IS NULL THEN 0.3 WHEN days_old <= 30 THEN 1.0 WHEN days_old <= 90 THEN 0.8 WHEN days_old <= 180 THEN 0.6 WHEN days_old <= 365 THEN 0.4 ELSE 0.2 END"),
        ("source_reliability", 0.15, first_of([(any_in("source", (s,)), str(v)) for s, v in SOURCE_SCORES.items()], "0.5")),
        ("consistency", 0.15, f"CASE WHEN {filled('email')} AND {filled('c_domain')} AND NOT contains(email_domain, lower(c_domain)) THEN 0.7 ELSE 1.0 END"),
        ("contact_quality", 0.15, "coalesce(contact_quality_score, 0.5)"),
        ("company_quality", 0.10, "coalesce(c_data_quality_score, 0.5)"),
    ),
    "engagement_potential": (
        ("social_presence", 0.25, f"(CASE WHEN {filled('linkedin_url')} THEN 0.6 ELSE 0 END + CASE WHEN {filled('twitter_handle')} THEN 0.3 ELSE 0 END + CASE WHEN {filled('bio')} THEN 0.1 ELSE 0 END)"),
        ("professional_activity", 0.25, "least(1.0, 0.5 + CASE WHEN days_old <= 7 THEN 0.3 WHEN days_old <= 30 THEN 0.2 WHEN days_old <= 90 THEN 0.1 ELSE 0 END + CASE WHEN n_skills > 3 THEN 0.1 ELSE 0 END + CASE WHEN experience_years > 5 THEN 0.1 ELSE 0 END)"),
        ("company_engagement", 0.20, f"least(1.0, 0.5 + least(0.3, c_n_social * 0.1) + CASE WHEN {filled('c_website')} THEN 0.1 ELSE 0 END + least(0.1, c_n_technologies * 0.02))"),
        ("accessibility", 0.15, f"(CASE WHEN {filled('email')} THEN 0.5 ELSE 0 END + CASE WHEN {filled('phone')} THEN 0.3 ELSE 0 END + CASE WHEN {filled('linkedin_url')} THEN 0.2 ELSE 0 END)"),
        ("existing_engagement", 0.15, "coalesce(engagement_potential, 0.5)"),
    ),
    "company_profile": (
        ("maturity", 0.30, "CASE WHEN coalesce(c_founded_year, 0) = 0 THEN 0.5 WHEN as_of_year - c_founded_year >= 20 THEN 1.0 WHEN as_of_year - c_founded_year >= 10 THEN 0.8 WHEN as_of_year - c_founded_year >= 5 THEN 0.6 WHEN as_of_year - c_founded_year >= 2 THEN 0.4 ELSE 0.2 END"),
        ("technology", 0.25, "CASE WHEN c_n_technologies = 0 THEN 0.3 ELSE least(1.0, c_n_modern / 5.0) END"),
        ("market_position", 0.25, f"least(1.0, 0.5 + CASE WHEN {any_in('c_revenue_range', ('billion',))} THEN 0.3 WHEN {any_in('c_revenue_range', ('million',))} THEN 0.2 ELSE 0 END + CASE WHEN c_employee_count > 1000 THEN 0.2 WHEN c_employee_count > 100 THEN 0.1 ELSE 0 END)"),
        ("innovation", 0.20, "least(1.0, 0.3 + c_n_innovation * 0.15 + CASE WHEN c_n_technologies > 10 THEN 0.2 WHEN c_n_technologies > 5 THEN 0.1 ELSE 0 END)"),
    ),
}


def category_sql(category: str) -> str:
    """Weighted sum of a category's parts, in double."""
    return "(" + " + ".join(f"CAST({sql} AS DOUBLE) * CAST({weight} AS DOUBLE)" for _, weight, sql in PARTS[category]) + ")"


def check_weights(weights: dict[str, float] | None) -> dict[str, float]:
    w = WEIGHTS if weights is None else weights
    if set(w) != set(WEIGHTS):
        raise ValueError(f"weights must name {sorted(WEIGHTS)}")
    if abs(sum(w.values()) - 1.0) > 0.001:
        raise ValueError(f"weights must sum to 1, got {sum(w.values())}")
    return w


def grade_sql(column: str) -> str:
    return first_of([(f"{column} >= {low}", f"'{grade}'") for low, grade in GRADES], "'F'")


# ---- operators ---------------------------------------------------------------------------------------------------------


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with typed nulls for optional columns that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def lead_rows(contacts: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Contacts joined to their company by ``company_id``, with the counts that the rules read. A contact without company stays."""
    k = with_columns(contacts, twitter_handle="string", bio="string", skills="array<string>", contact_location="string", department="string", experience_years="int", source="string")
    if "full_name" not in k.columns:
        k = k.withColumn("full_name", F.concat_ws(" ", "first_name", "last_name"))
    k = k.withColumns({
        "phone_digits": F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")), "n_skills": F.coalesce(F.size(F.coalesce("skills", F.array().cast("array<string>"))), F.lit(0)),
        "email_domain": F.lower(F.element_at(F.split("email", "@"), -1)), "as_of_year": F.year(F.lit(as_of).cast("timestamp")),
        "days_old": F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_activity_date").cast("timestamp"))) / 86400),
    })
    c = with_columns(companies, domain="string", technologies="array<string>", growth_signals="map<string,boolean>", social_media="map<string,string>")
    signals = F.coalesce("growth_signals", F.create_map().cast("map<string,boolean>"))
    techs = F.transform(F.coalesce("technologies", F.array().cast("array<string>")), F.lower)
    on = lambda names: F.size(F.map_filter(signals, lambda key, v: F.coalesce(v, F.lit(False)) & key.isin(*names)))
    modern = F.filter(F.array(*map(F.lit, MODERN)), lambda m: F.exists(techs, lambda t: F.contains(m, t)))
    plain = ("name", "website", "industry", "employee_count", "company_size", "revenue_range", "founded_year", "data_quality_score", "domain")
    c = c.select(
        F.col("id").alias("c_id"), *[F.col(x).alias(f"c_{x}") for x in plain], F.size(signals).alias("c_n_signals_known"), on(POSITIVE_SIGNALS).alias("c_n_signals"), on(INNOVATION_SIGNALS).alias("c_n_innovation"),
        F.size(techs).alias("c_n_technologies"), F.size(modern).alias("c_n_modern"), F.coalesce(F.size(F.map_keys("social_media")), F.lit(0)).alias("c_n_social"),
    )
    return k.join(c.withColumn("c_n_social", F.greatest("c_n_social", F.lit(0))), F.col("company_id") == F.col("c_id"), "left")


def score_category(rows: DataFrame, category: str) -> DataFrame:
    """``rows`` (from ``lead_rows``) with the category's score and a struct of its parts."""
    parts = F.struct(*[F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, _, sql in PARTS[category]])
    return rows.withColumns({category: F.round(F.expr(category_sql(category)), 6), f"{category}_parts": parts})


def score_leads(contacts: DataFrame, companies: DataFrame, as_of: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``(company_id, contact_id, total_score, score_percentage, grade, breakdown, factors)`` per contact."""
    w = check_weights(weights)
    rows = lead_rows(contacts, companies, as_of)
    total = "(" + " + ".join(f"__{c} * CAST({x} AS DOUBLE)" for c, x in w.items()) + ")"
    rows = rows.withColumns({f"__{c}": F.expr(category_sql(c)) for c in w})  # each category once; the total reads the results
    rows = rows.withColumns({c: F.round(f"__{c}", 6) for c in w} | {"total": F.expr(total)})
    rows = rows.withColumn("score_percentage", F.round(F.col("total") / F.lit(float(sum(w.values()))) * 100, 4))
    factors = F.struct(
        F.expr(SENIORITY_SQL).alias("seniority_level"), F.expr(SIZE_SQL).alias("company_size"), F.col("c_industry").alias("industry"), F.coalesce("is_decision_maker", F.lit(False)).alias("is_decision_maker"),
        F.coalesce("is_verified", F.lit(False)).alias("is_verified"), F.expr(filled("email")).alias("has_email"), F.expr(filled("phone")).alias("has_phone"), F.expr(filled("linkedin_url")).alias("has_linkedin"),
    )
    return rows.select("company_id", F.col("id").alias("contact_id"), F.round("total", 6).alias("total_score"), "score_percentage", F.expr(grade_sql("score_percentage")).alias("grade"), F.struct(*w).alias("breakdown"), factors.alias("factors"))


def scoring_summary(scores: DataFrame) -> DataFrame:
    """``(metric, value)``: leads, mean, least and largest score, mean %, high from 70, medium from 40, low, and one row per grade."""
    p = F.col("score_percentage")
    by = scores.rollup("grade").agg(
        F.grouping("grade").alias("all"), F.count("*").cast("double").alias("total_leads"), F.round(exact_avg("total_score"), 6).alias("average_score"), F.round(exact_avg("score_percentage"), 4).alias("average_percentage"),
        F.min("total_score").alias("min_score"), F.max("total_score").alias("max_score"), F.count_if(p >= 70).cast("double").alias("high"), F.count_if((p >= 40) & (p < 70)).cast("double").alias("medium"), F.count_if(p < 40).cast("double").alias("low"),
    )
    names = [c for c in by.columns if c not in ("grade", "all")]
    pair = lambda name, value: F.struct(name.alias("metric"), F.col(value).alias("value"))
    whole, one = F.array(*[pair(F.lit(n), n) for n in names]), F.array(pair(F.concat(F.lit("grade:"), "grade"), "total_leads"))
    return by.select(F.inline(F.when(F.col("all") == 1, whole).otherwise(one)))


def score_batch_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("leads"), F.round(exact_avg("score_percentage"), 4).alias("average"), F.count_if(F.col("score_percentage") >= 80).alias("high_quality"))


#: Fixed values of the requirement scheme: weight of a category, and points of its tests.
SPEC = {
    "contact_completeness": (0.25, (("email_found", 20), ("phone_found", 15), ("decision_maker_contact", 25), ("multiple_contacts", 10))),
    "business_indicators": (0.35, (("company_size_match", 30), ("industry_relevance", 25), ("technology_match", 20), ("growth_signal", 25))),
    "data_quality": (0.25, (("verified_email", 20), ("active_website", 15), ("recent_activity", 20), ("social_presence", 10))),
    "engagement_potential": (0.15, (("job_postings_active", 15), ("funding_news", 20), ("expansion_signals", 10))),
}


def spec_score(companies: DataFrame, contacts: DataFrame, as_of: str, sizes: tuple[str, ...] = ("51-200", "201-500"), industries: tuple[str, ...] = ("Software Development", "Finance"), technologies: tuple[str, ...] = ("Python", "AWS")) -> DataFrame:
    """``(id, score, band)``: per category the share of its points reached, weighted, on 100; contacts are summed before the join."""
    recent = F.col("last_activity_date") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    mail = F.expr(filled("email"))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    per = contacts.groupBy(F.col("company_id").alias("id")).agg(any_(mail).alias("m"), any_(F.expr(filled("phone"))).alias("p"), any_(F.col("is_decision_maker")).alias("d"), F.count("*").alias("n"), any_(mail & F.col("is_verified")).alias("v"), any_(recent).alias("r"), any_(F.expr(filled("linkedin_url"))).alias("l"))
    rows = companies.join(per, "id", "left")
    signal = lambda s: F.coalesce(F.col("growth_signals")[s], F.lit(False))
    tests = {
        "email_found": F.col("m") == 1, "phone_found": F.col("p") == 1, "decision_maker_contact": F.col("d") == 1, "multiple_contacts": F.col("n") > 1,
        "company_size_match": F.col("company_size").isin(*sizes), "industry_relevance": F.col("industry").isin(*industries), "technology_match": F.arrays_overlap("technologies", F.array(*map(F.lit, technologies))),
        "growth_signal": F.size(F.map_filter("growth_signals", lambda k, v: v)) > 0, "verified_email": F.col("v") == 1, "active_website": F.expr(filled("website")), "recent_activity": F.col("r") == 1,
        "social_presence": (F.col("l") == 1) | F.col("social_media").isNotNull(), "job_postings_active": signal("hiring"), "funding_news": signal("funding"), "expansion_signals": signal("expansion"),
    }
    score = F.lit(0.0)
    for weight, points in SPEC.values():
        got = sum((F.when(tests[name], n).otherwise(0) for name, n in points), F.lit(0))
        score = score + got * (100.0 * weight / sum(n for _, n in points))
    rows = rows.withColumn("score", F.round(score, 4))
    s = F.col("score")
    return rows.select("id", "score", F.when(s >= 80, "hot").when(s >= 60, "warm").when(s >= 40, "cold").otherwise("poor").alias("band"))
