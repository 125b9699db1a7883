"""Filters, search, sorting, paging, top-k, joins and set operations over the lead tables.

All are lazy DataFrame transforms; filters stay plain column predicates so that they reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import saved


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; true if there are none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains_any_case(column: str | Column, term: str) -> Column:
    """The term is part of the value, any case; the term's own wildcards are taken literally."""
    value = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(value), F.lit(term.lower()))


def filter_dict(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Predicates from a dict: a scalar equals, a list is IN, a dict has gte/lte/gt/lt/like/ilike; null values are skipped."""
    ops = {
        "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
        "like": lambda c, v: F.contains(c, F.lit(v)), "ilike": lambda c, v: contains_any_case(c, v),
    }

    def one(name: str, value: Any) -> Column | None:
        c = F.col(name)
        if value is None:
            return None
        if isinstance(value, (list, tuple, set)):
            return c.isin(*value)
        if isinstance(value, dict):
            unknown = set(value) - set(ops)
            if unknown:
                raise ValueError(f"unknown filter operators: {sorted(unknown)}")
            return all_of(*[ops[k](c, v) for k, v in value.items() if v is not None])
        return c == value

    return df.where(all_of(*[one(k, v) for k, v in filters.items()]))


def lead_filters(companies: DataFrame, industry: str | None = None, location: str | None = None, company_size: str | None = None, min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """Industry and city contain, size equals, score in range."""
    score = F.col("lead_score")
    return companies.where(all_of(
        contains_any_case("industry", industry) if industry else None,
        contains_any_case("location.city", location) if location else None,
        F.col("company_size") == company_size if company_size else None,
        score >= min_score if min_score is not None else None,
        score <= max_score if max_score is not None else None,
    ))


def lead_search_filters(companies: DataFrame, contacts: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Companies by company predicates, and by having a contact that meets all contact predicates.

    Keys: industries, sizes, cities, technologies (any of), min_score, max_score, min_quality, min_employees, max_employees,
    growth_signals (any set), has_website, has_email, created_from, created_to; contact_titles (any contained), seniority,
    departments, decision_makers, verified, min_contact_quality, contact_has_email.
    """
    f = {k: v for k, v in filters.items() if v is not None}
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    tests: dict[str, Column] = {}
    company = {
        "industries": lambda v: F.col("industry").isin(*v), "sizes": lambda v: F.col("company_size").isin(*v), "cities": lambda v: F.col("location.city").isin(*v),
        "technologies": lambda v: F.arrays_overlap("technologies", F.array(*map(F.lit, v))),
        "min_score": lambda v: F.col("lead_score") >= v, "max_score": lambda v: F.col("lead_score") <= v, "min_quality": lambda v: F.col("data_quality_score") >= v,
        "min_employees": lambda v: F.col("employee_count") >= v, "max_employees": lambda v: F.col("employee_count") <= v,
        "growth_signals": lambda v: F.size(F.map_filter("growth_signals", lambda k, x: x & k.isin(*v))) > 0,
        "has_website": lambda v: has("website") == v, "has_email": lambda v: has("email") == v,
        "created_from": lambda v: F.col("created_at") >= F.lit(v).cast("timestamp_ntz"), "created_to": lambda v: F.col("created_at") <= F.lit(v).cast("timestamp_ntz"),
    }
    contact = {
        "contact_titles": lambda v: reduce(lambda a, b: a | b, [contains_any_case("job_title", t) for t in v]), "seniority": lambda v: F.col("seniority_level").isin(*v),
        "departments": lambda v: F.col("department").isin(*v), "decision_makers": lambda v: F.col("is_decision_maker") == v, "verified": lambda v: F.col("is_verified") == v,
        "min_contact_quality": lambda v: F.col("contact_quality_score") >= v, "contact_has_email": lambda v: has("email") == v,
    }
    unknown = set(f) - set(company) - set(contact)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    tests = {k: contact[k](v) for k, v in f.items() if k in contact}
    out = companies.where(all_of(*[company[k](v) for k, v in f.items() if k in company]))
    if tests:
        ids = contacts.where(all_of(*tests.values())).select(F.col("company_id").alias("__company"))
        out = out.join(ids, F.col("id") == F.col("__company"), "left_semi")
    return out


def host(url: str | Column) -> Column:
    """Host of a URL with or without scheme, lower case, no www."""
    value = F.lower(F.trim(F.col(url) if isinstance(url, str) else url))
    return F.nullif(F.regexp_replace(F.regexp_extract(value, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1), r"^www\.", ""), F.lit(""))


def scrape_target_filters(companies: DataFrame, params: dict[str, Any], excluded: DataFrame | None = None) -> DataFrame:
    """Targets by keywords (name or description contains any), industries, sizes, employee range, founded after, revenue, technologies, limit."""
    p = {k: v for k, v in params.items() if v is not None}
    words = [contains_any_case("name", w) | F.coalesce(contains_any_case("description", w), F.lit(False)) for w in p.get("keywords", [])]
    out = companies.where(all_of(
        reduce(lambda a, b: a | b, words) if words else None,
        F.col("industry").isin(*p["industries"]) if "industries" in p else None,
        F.col("company_size").isin(*p["sizes"]) if "sizes" in p else None,
        F.col("employee_count") >= p["min_employees"] if "min_employees" in p else None,
        F.col("employee_count") <= p["max_employees"] if "max_employees" in p else None,
        F.col("founded_year") > p["founded_after"] if "founded_after" in p else None,
        F.col("revenue_range").isin(*p["revenue_ranges"]) if "revenue_ranges" in p else None,
        F.arrays_overlap("technologies", F.array(*map(F.lit, p["technologies"]))) if "technologies" in p else None,
    ))
    if excluded is not None:
        out = exclude_domains(out, excluded)
    return out.orderBy("id").limit(p["max_results"]) if "max_results" in p else out


def exclude_domains(df: DataFrame, domains: DataFrame, url: str = "website") -> DataFrame:
    """Rows whose host is not among ``domains(domain)``; rows without a host stay."""
    gone = domains.select(host("domain").alias("__domain"))
    return df.withColumn("__host", host(url)).join(gone, F.col("__host") == F.col("__domain"), "left_anti").drop("__host")


def tenant_scope(df: DataFrame, user_id: int, parent: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """A user's own rows; with a parent, the rows whose parent (``on`` to its id) is the user's own."""
    if parent is None:
        return df.where(F.col("created_by") == user_id)
    own = parent.where(F.col("created_by") == user_id).select(F.col("id").alias("__parent"))
    return df.join(own, F.col(on) == F.col("__parent"), "left_semi")


def semi_scoped(child: DataFrame, parent: DataFrame, on: str, user_id: int) -> DataFrame:
    return tenant_scope(child, user_id, parent, on)


def company_texts() -> list[Column]:
    """What a search over companies looks in, lower-cased."""
    return [F.lower("name"), host("website")]


def contact_texts() -> list[Column]:
    """What a search over contacts looks in, lower-cased."""
    return [F.lower("first_name"), F.lower("last_name"), F.lower("email")]


def holds(texts: list[Column], term: str) -> Column:
    """One of the lower-cased texts contains the term, any case; null texts contain nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(t, F.lit(term.lower())), F.lit(False)) for t in texts])


def search_companies(df: DataFrame, user_id: int, term: str) -> DataFrame:
    """A tenant's companies whose name or host contains the term, any case. ``sources.grams`` finds the same from a stored index."""
    return tenant_scope(df, user_id).where(holds(company_texts(), term))


def search_contacts(df: DataFrame, user_id: int, term: str) -> DataFrame:
    """A tenant's contacts whose first or last name or e-mail contains the term, any case."""
    return tenant_scope(df, user_id).where(holds(contact_texts(), term))


def search_leads(companies: DataFrame, contacts: DataFrame, industry: str | None = None, city: str | None = None, min_score: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Leads with their contact counts, best score and newest first. Contacts are counted before the join."""
    found = lead_filters(companies, industry, city, min_score=min_score)
    counts = contacts.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("contact_count"))
    rows = found.join(counts, "id", "left").select("id", "name", "industry", "lead_score", F.coalesce("contact_count", F.lit(0)).alias("contact_count"), F.col("location.city").alias("city"), "created_at")
    return rows.orderBy(F.col("lead_score").desc_nulls_last(), F.col("created_at").desc(), "id").offset(offset).limit(limit)


def metrics_range(metrics: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """A metric's rows in a time range, newest first."""
    at = F.col("ts")
    return metrics.where((F.col("metric_name") == name) & at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy(at.desc(), "event_id")


#: What routes a query table to its source, first match wins.
SOURCE_WORDS = (("linkedin", ("linkedin",)), ("google_my_business", ("google", "maps")), ("website", ("website", "http", "www", ".com")))
PROHIBITED = ("password", "credit card", "ssn", "social security")


def classify_query_source(queries: DataFrame, column: str = "query") -> DataFrame:
    """``queries`` with ``source``; default google_my_business."""
    text = F.lower(F.col(column))
    out = None
    for source, words in SOURCE_WORDS:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(hit, source) if out is None else out.when(hit, source)
    return queries.withColumn("source", out.otherwise("google_my_business"))


def query_screen(queries: DataFrame, column: str = "query", prohibited: tuple[str, ...] = PROHIBITED) -> DataFrame:
    """Queries of two characters or more without a prohibited term."""
    text = F.lower(F.trim(F.col(column)))
    bad = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in prohibited])
    return queries.where((F.length(text) >= 2) & ~bad)


def sort_by(df: DataFrame, column: str, order: str = "asc", key: str = "id") -> DataFrame:
    """Sorted by one column, nulls last; ties by key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if order == "desc" else c.asc_nulls_last(), key)


def page(df: DataFrame, number: int, size: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A page of rows in key order, and one row of ``total, pages, page, has_next, has_prev, next_page, prev_page``."""
    total = F.count("*")
    pages = F.ceil(total / size).cast("long")
    info = df.agg(total.alias("total"), pages.alias("pages")).withColumn("page", F.lit(number).cast("long"))
    info = info.withColumns({"has_next": F.col("page") < F.col("pages"), "has_prev": F.col("page") > 1})
    info = info.withColumns({"next_page": F.when(F.col("has_next"), F.col("page") + 1), "prev_page": F.when(F.col("has_prev"), F.col("page") - 1)})
    return df.orderBy(key).offset((number - 1) * size).limit(size), info


def top_k_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def lead_view(companies: DataFrame, contacts: DataFrame, columns: tuple[str, ...] = ("id", "first_name", "last_name", "email", "job_title")) -> DataFrame:
    """Companies with their contacts as an array of structs, in id order; none: an empty array."""
    nested = contacts.groupBy(F.col("company_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("contacts"))
    rows = companies.join(nested, F.col("id") == F.col("__id"), "left").drop("__id")
    return rows.withColumn("contacts", F.coalesce("contacts", F.array().cast(dict(nested.dtypes)["contacts"])))


def contact_company_by_name(contacts: DataFrame, companies: DataFrame, name: str = "company_name") -> DataFrame:
    """Contacts with the first company (lowest id) of equal lower-cased name, as a struct; null if none."""
    first = companies.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("__name")).agg(F.min_by(F.struct("id", "name", "industry", "employee_count"), "id").alias("company"))
    return contacts.join(first, F.lower(name) == F.col("__name"), "left").drop("__name")


#: A term table of up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 10_000


def pieces(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given lengths."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(0)), F.lit(1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(text) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))


def terms_within(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``(value, term)`` of ``values(value)`` and ``terms(term)``, both distinct and not null, where the value contains the term.

    A term is posted under the rarest of its 3-grams among the values (a shorter term under itself), a value is looked up with
    all of its own, and what meets is verified. So neither side is held anywhere whole and no value meets all terms.
    """
    short = [r[0] for r in terms.where(F.length("term").between(1, 2)).select(F.length("term")).distinct().collect()]
    at = saved(values.select("value", F.explode(pieces(F.col("value"), (3, *sorted(short)))).alias("piece")), "term-pieces")
    own = F.when(F.length("term") < 3, F.array("term")).otherwise(pieces(F.col("term"), (3,)))
    asked = saved(terms.where(F.length("term") > 0).select("term", F.explode(own).alias("piece")), "terms-asked")
    counts = at.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no value has makes its term unfindable: its count is 0 and it is the rarest.
    post = asked.join(saved(counts, "term-counts"), "piece", "left").groupBy("term").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    post = saved(post, "term-posts")
    post = F.broadcast(post) if post.count() <= BROADCAST_TERMS else post
    return at.join(post, "piece").where(F.contains("value", F.col("term"))).select("value", "term")


def _looked_up(df: DataFrame, column: str, terms: DataFrame, mode: str, default: str | None) -> DataFrame:
    order = F.col("rank") if "rank" in terms.columns else F.lit(0)
    known = terms.select(F.lower("term").alias("term"), F.struct(order.alias("rank"), F.lower("term").alias("term"), "label").alias("hit")).where("term <> ''")
    first = saved(known.groupBy("term").agg(F.min("hit").alias("hit")), "term-first")
    if mode == "equals":
        found = first.select(F.col("term").alias("__value"), F.col("hit.label").alias("label"))
        found = F.broadcast(found) if first.count() <= BROADCAST_TERMS else found
    else:
        values = df.where(F.col(column).isNotNull()).select(F.lower(column).alias("value")).distinct()
        best = terms_within(values, first.select("term")).join(first, "term").groupBy("value").agg(F.min("hit").alias("hit"))
        found = saved(best.select(F.col("value").alias("__value"), F.col("hit.label").alias("label")), "terms-found")
    rows = df.drop("label").withColumn("__key", F.lower(column)).join(found, F.col("__key") == F.col("__value"), "left").withColumn("__found", F.col("__value").isNotNull())
    return rows.withColumn("label", F.when(F.col("__found"), F.col("label")).otherwise(F.lit(default)).cast("string")).drop("__key", "__value", "__found")


def dictionary_lookup(df: DataFrame, column: str, dictionary: dict[str, str] | DataFrame, mode: str = "equals", default: str | None = None) -> DataFrame:
    """``df`` with ``label``: of the term that the value equals or contains (any case), the first in dictionary order.

    A dict is the caller's, so bounded by what the driver holds; it becomes literals of the plan, no join. A term table
    ``(term, label[, rank])`` may be of any size: its first term by rank, then text counts; terms meet values by equal keys, or through
    postings of 3-grams (``terms_within``). Null and empty terms of a table are left out, null values have the default label; a
    ``label`` column of ``df`` is replaced.
    """
    if isinstance(dictionary, DataFrame):
        return _looked_up(df, column, dictionary, mode, default)
    value = F.lower(F.col(column))
    hit = (lambda term: value == term.lower()) if mode == "equals" else (lambda term: F.contains(value, F.lit(term.lower())))
    out = None
    for term, label in dictionary.items():
        out = F.when(hit(term), label) if out is None else out.when(hit(term), label)
    return df.withColumn("label", (out.otherwise(F.lit(default)) if out is not None else F.lit(default)).cast("string"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_links(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def first_per(df: DataFrame, keys: list[str], order: list[Any]) -> DataFrame:
    """The first row per key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
