"""Enrichment of companies and contacts: inferred industry, size, links, title category, seniority, name parts, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_in, filled, first_of, most_hits, text
from .scoring import with_columns
from .select import host

#: Industry words; ties go to the first industry.
INDUSTRY_WORDS = {
    "Technology": ("software", "tech", "ai", "machine learning", "saas", "cloud", "data"),
    "Healthcare": ("health", "medical", "pharma", "biotech", "hospital", "clinic"),
    "Finance": ("bank", "finance", "fintech", "investment", "insurance", "trading"),
    "E-commerce": ("ecommerce", "retail", "shopping", "marketplace", "store"),
    "Education": ("education", "learning", "school", "university", "training"),
    "Marketing": ("marketing", "advertising", "agency", "digital marketing"),
    "Consulting": ("consulting", "advisory", "services", "strategy"),
    "Manufacturing": ("manufacturing", "production", "factory", "industrial"),
    "Real Estate": ("real estate", "property", "construction", "development"),
    "Media": ("media", "publishing", "news", "entertainment", "content"),
}
SIZE_WORDS = (
    ("startup", ("startup", "founded", "early stage", "seed")), ("small", ("small", "boutique", "local", "family")), ("medium", ("growing", "expanding", "regional")),
    ("large", ("enterprise", "global", "international", "fortune", "multinational")), ("enterprise", ("corporation", "inc.", "corp.", "enterprise", "worldwide")),
)
JOB_WORDS = (
    ("Executive", ("ceo", "cto", "cfo", "coo", "president", "founder", "owner")), ("Management", ("manager", "director", "head", "lead", "supervisor", "chief")),
    ("Sales", ("sales", "account", "business development", "revenue")), ("Marketing", ("marketing", "brand", "content", "social media", "seo")),
    ("Engineering", ("engineer", "developer", "programmer", "architect", "devops")), ("Design", ("designer", "ux", "ui", "creative", "art")),
    ("Operations", ("operations", "logistics", "supply chain", "admin")), ("HR", ("hr", "human resources", "recruiter", "talent")),
    ("Finance", ("finance", "accounting", "controller", "analyst")), ("Legal", ("legal", "counsel", "attorney", "compliance")),
)
SENIORITY_WORDS = (
    ("Executive", ("ceo", "cto", "cfo", "coo", "president", "founder", "owner", "partner")), ("Senior", ("senior", "sr", "principal", "lead", "head", "director", "vp", "vice president")),
    ("Mid", ("manager", "supervisor", "coordinator", "specialist")), ("Junior", ("junior", "jr", "associate", "assistant", "intern", "trainee")),
)
SOCIAL = {
    "twitter_url": r"(?i)https?://(?:www\.)?twitter\.com/[a-zA-Z0-9_]+", "facebook_url": r"(?i)https?://(?:www\.)?facebook\.com/[a-zA-Z0-9.]+",
    "instagram_url": r"(?i)https?://(?:www\.)?instagram\.com/[a-zA-Z0-9_.]+", "youtube_url": r"(?i)https?://(?:www\.)?youtube\.com/[a-zA-Z0-9_]+",
}

INDUSTRY_SQL = most_hits("concat(coalesce(name, ''), ' ', coalesce(description, ''), ' ', coalesce(industry, ''))", INDUSTRY_WORDS)
DESCRIBED_SIZE_SQL = first_of([(any_in("description", words), text(size)) for size, words in SIZE_WORDS])
JOB_SQL = first_of([(f"NOT {filled('job_title')}", "NULL"), *((any_in("job_title", words), text(c)) for c, words in JOB_WORDS)], "'Other'")
SENIORITY4_SQL = first_of([(f"NOT {filled('job_title')}", "NULL"), *((any_in("job_title", words), text(s)) for s, words in SENIORITY_WORDS)], "'Mid'")


def infer_industry(companies: DataFrame) -> DataFrame:
    """``companies`` with ``inferred_industry``, and ``industry`` filled from it where empty."""
    c = companies.withColumn("inferred_industry", F.expr(INDUSTRY_SQL))
    return c.withColumn("industry", F.when(F.expr(filled("industry")), F.col("industry")).otherwise(F.col("inferred_industry")))


def describe_size(companies: DataFrame) -> DataFrame:
    return companies.withColumn("described_size", F.expr(DESCRIBED_SIZE_SQL))


def social_from_text(companies: DataFrame) -> DataFrame:
    """``companies`` with the first link per platform in description and website; a given LinkedIn link stays."""
    where = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("website", F.lit("")))
    return companies.withColumns({c: F.nullif(F.regexp_extract(where, p, 0), F.lit("")) for c, p in SOCIAL.items()})


def normalize_company(companies: DataFrame) -> DataFrame:
    """https:// before a website without scheme; ``domain`` from the website where absent."""
    site = F.col("website")
    c = with_columns(companies, domain="string").withColumn("website", F.when(F.expr(filled("website")) & ~site.rlike("^https?://"), F.concat(F.lit("https://"), site)).otherwise(site))
    return c.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), host("website")))


def company_enrich_confidence(companies: DataFrame) -> DataFrame:
    """``companies`` with ``enrich_confidence`` from industry, described_size, domain, technology_confidence and three social links."""
    c = with_columns(companies, described_size="string", domain="string", technology_confidence="double", linkedin_url="string", twitter_url="string", facebook_url="string")
    one = lambda x: F.expr(filled(x)).cast("int")
    score = F.lit(0.5) + 0.1 * (one("industry") + one("described_size") + one("domain")) + F.coalesce("technology_confidence", F.lit(0.0)) * 0.3 + 0.05 * (one("linkedin_url") + one("twitter_url") + one("facebook_url"))
    return c.withColumn("enrich_confidence", F.round(F.least(score, F.lit(1.0)), 6))


def enrich_companies(companies: DataFrame, technologies: DataFrame | None = None) -> DataFrame:
    """The company job: industry, size, links, website and domain, confidence, and ``sources`` of what was added.

    ``technologies(domain, technologies, confidence)`` is a roll-up of page signatures, joined by domain.
    """
    had = F.expr(filled("industry"))
    c = companies.withColumn("__had", had).transform(infer_industry).transform(describe_size).transform(social_from_text).transform(normalize_company)
    if technologies is not None:
        t = technologies.select(F.col("domain").alias("__domain"), F.col("technologies").alias("detected_technologies"), F.col("confidence").alias("technology_confidence"))
        c = c.join(t, F.col("domain") == F.col("__domain"), "left").drop("__domain")
    else:
        c = with_columns(c, detected_technologies="array<string>", technology_confidence="double")
    links = F.coalesce(*SOCIAL)
    sources = F.array_compact(F.array(F.when(F.col("technology_confidence").isNotNull(), "website_analysis"), F.when(~F.col("__had") & F.col("inferred_industry").isNotNull(), "industry_inference"), F.when(F.col("described_size").isNotNull(), "size_estimation"), F.when(links.isNotNull(), "social_extraction")))
    return c.withColumn("sources", sources).transform(company_enrich_confidence).drop("__had")


def job_category(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("job_category", F.expr(JOB_SQL))


def title_seniority4(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("title_seniority", F.expr(SENIORITY4_SQL))


def split_full_name(contacts: DataFrame) -> DataFrame:
    """First word as first_name and the rest as last_name, where first_name is empty and full_name is given."""
    words = F.split(F.trim(F.regexp_replace("full_name", r"\s+", " ")), " ")
    use = ~F.expr(filled("first_name")) & F.expr(filled("full_name"))
    rest = F.nullif(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(""))
    return contacts.withColumns({"first_name": F.when(use, F.get(words, F.lit(0))).otherwise(F.col("first_name")), "last_name": F.when(use, F.coalesce(rest, F.col("last_name"))).otherwise(F.col("last_name"))})


def first_name_lookup(contacts: DataFrame, names: DataFrame) -> DataFrame:
    """``contacts`` with ``name_label`` from ``names(name, label)`` by lower-cased first name, one label per name."""
    n = names.groupBy(F.lower("name").alias("__name")).agg(F.min("label").alias("name_label"))
    return contacts.join(n, F.lower("first_name") == F.col("__name"), "left").drop("__name")


def contact_enrich_confidence(contacts: DataFrame) -> DataFrame:
    c = with_columns(contacts, job_category="string", seniority_level="string")
    one = lambda x: F.expr(filled(x)).cast("int")
    score = F.lit(0.5) + 0.1 * (one("first_name") + one("last_name") + one("email")) + 0.05 * (one("job_title") + one("job_category") + one("seniority_level") + one("phone"))
    return c.withColumn("enrich_confidence", F.round(F.least(score, F.lit(1.0)), 6))


def enrich_contacts(contacts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The contact job: category, seniority (fills an empty one), name parts, label, confidence and ``sources``."""
    c = with_columns(contacts, full_name="string").transform(job_category).transform(title_seniority4)
    split = ~F.expr(filled("first_name")) & F.expr(filled("full_name"))
    c = c.withColumn("__split", split).transform(split_full_name)
    c = first_name_lookup(c, names) if names is not None else with_columns(c, name_label="string")
    c = c.withColumn("seniority_level", F.when(F.expr(filled("seniority_level")), F.col("seniority_level")).otherwise(F.col("title_seniority")))
    sources = F.array_compact(F.array(F.when(F.col("job_category").isNotNull(), "job_categorization"), F.when(F.col("title_seniority").isNotNull(), "seniority_analysis"), F.when(F.col("__split"), "name_parsing"), F.when(F.col("name_label").isNotNull(), "name_lookup")))
    return c.withColumn("sources", sources).transform(contact_enrich_confidence).drop("__split")
