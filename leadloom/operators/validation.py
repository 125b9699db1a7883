"""Validation jobs: each adds a struct (is_valid, status, normalized, confidence, errors, metadata) for one field, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import with_columns

#: Fixed values.
DISPOSABLE = ("10minutemail.com", "guerrillamail.com", "mailinator.com", "tempmail.org", "yopmail.com", "throwaway.email", "temp-mail.org", "getnada.com", "maildrop.cc")
ROLE_PREFIXES = ("admin", "administrator", "info", "contact", "support", "sales", "marketing", "noreply", "no-reply", "help", "service", "office", "team", "general", "mail")
FREEMAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com")
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")
EMAIL = r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
DOMAIN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"
LOOSE_DOMAIN = r"^[a-zA-Z0-9][a-zA-Z0-9-]*[a-zA-Z0-9]*\.([a-zA-Z]{2,}|xn--[a-zA-Z0-9]+)$"
LINKEDIN = r"(?i)^https?://(?:www\.)?linkedin\.com/(in|company)/[a-zA-Z0-9-]+/?$"
SUSPICIOUS = r"(?i)^[0-9]+$|^[^a-zA-Z]*$|test|example|sample|demo"
NAME = r"^[a-zA-Z\s\-'.À-ſ]+$"


def result(valid: Column, status: Column, normalized: Column, confidence: Column, error: Column, **metadata: Column) -> Column:
    """The result struct; ``error`` is null where there is none."""
    meta = F.map_filter(F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()) if metadata else F.create_map().cast("map<string,string>")
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("is_valid"), status.alias("status"), F.when(normalized.isNotNull(), normalized).alias("normalized"), confidence.cast("double").alias("confidence"),
        F.array_compact(F.array(error)).alias("errors"), meta.alias("metadata"),
    )


def _plain(valid: Column, normalized: Column, confidence: float, error: str, missing: Column, missing_error: str, **metadata: Column) -> Column:
    ok = valid & ~missing
    kept = {k: F.when(ok, v) for k, v in metadata.items()}
    return result(ok, F.when(ok, "valid").otherwise("invalid"), F.when(ok, normalized), F.when(ok, confidence).otherwise(0.0), F.when(missing, missing_error).when(~ok, error), **kept)


def email_result(column: str) -> Column:
    """disposable, role_based, valid (business .9, personal .7) or invalid; the value trimmed and lower-cased."""
    value = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    form = value.rlike(EMAIL) & ~value.rlike(r"\.\.|^\.|\.@")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    disposable, role, free = domain.isin(*DISPOSABLE), local.isin(*ROLE_PREFIXES), domain.isin(*FREEMAIL)
    status = F.when(~form, "invalid").when(disposable, "disposable").when(role, "role_based").otherwise("valid")
    confidence = F.when(~form | disposable, 0.0).when(role, 0.6).when(free, 0.7).otherwise(0.9)
    error = F.when(F.coalesce(F.col(column), F.lit("")) == "", "Email is required and must be a string").when(~form, "Invalid email format").when(disposable, "Disposable email address")
    kind = F.when(disposable, "disposable").when(role, "role_based").when(free, "personal").otherwise("business")
    return result(form & ~disposable, status, F.when(form, value), confidence, error, domain=F.when(form, domain), type=F.when(form, kind))


def phone_result(column: str) -> Column:
    """NANP numbers: E.164 form, toll_free .6 else fixed_or_mobile .85; other regions (leading + and not 1) are uncertain."""
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    digits = F.regexp_replace(value, "[^0-9]", "")
    foreign = value.startswith("+") & ~digits.startswith("1") & F.length(digits).between(7, 15)
    bare = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when((F.length(digits) == 10) & ~value.startswith("+"), digits)
    ok = F.coalesce(bare.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), F.lit(False)) & ~value.rlike("[A-Za-z]")
    toll = F.substring(bare, 1, 3).isin(*TOLL_FREE)
    missing = value == ""
    status = F.when(ok, "valid").when(foreign, "uncertain").otherwise("invalid")
    error = F.when(missing, "Phone number is required and must be a string").when(foreign, "Region not checked").when(~ok, "Invalid phone number format")
    form = F.when(ok, F.concat(F.lit("+1"), bare)).when(foreign, F.concat(F.lit("+"), digits))
    return result(ok, status, form, F.when(ok & toll, 0.6).when(ok, 0.85).when(foreign, 0.5).otherwise(0.0), error, type=F.when(ok & toll, "toll_free").when(ok, "fixed_or_mobile"))


def _given(column: str) -> tuple[Column, Column]:
    value = F.coalesce(F.col(column), F.lit(""))
    return F.trim(value), value == ""


def url_result(column: str) -> Column:
    value, missing = _given(column)
    url = F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://"), value))
    return _plain(url.rlike(URL), url, 0.9, "Invalid URL format", missing, "URL is required and must be a string", protocol=F.substring_index(url, "://", 1))


def url_loose_result(column: str) -> Column:
    """Scheme and host are there."""
    value, missing = _given(column)
    return _plain(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), value, 1.0, "Invalid URL", missing, "Invalid URL")


def domain_result(column: str) -> Column:
    value, missing = _given(column)
    domain = F.regexp_extract(F.regexp_replace(F.lower(value), "^.*?://", ""), "^[^/]*", 0)
    return _plain(domain.rlike(DOMAIN), domain, 0.9, "Invalid domain format", missing, "Domain is required and must be a string", tld=F.substring_index(domain, ".", -1))


def domain_loose_result(column: str) -> Column:
    value, missing = _given(column)
    return _plain(value.rlike(LOOSE_DOMAIN), value, 1.0, "Invalid domain", missing, "Invalid domain")


def linkedin_result(column: str) -> Column:
    value, missing = _given(column)
    return _plain(value.rlike(LINKEDIN), value, 0.95, "Invalid LinkedIn URL format", missing, "LinkedIn URL is required and must be a string", type=F.when(F.contains(value, F.lit("/company/")), "company").otherwise("personal"))


def company_name_result(column: str) -> Column:
    """2 to 200 characters; suspicious ones are valid but uncertain (.3)."""
    value, missing = _given(column)
    n = F.length(value)
    ok = n.between(2, 200) & ~missing
    odd = value.rlike(SUSPICIOUS)
    error = F.when(missing, "Company name is required and must be a string").when(n < 2, "Company name too short").when(n > 200, "Company name too long").when(odd, "Suspicious company name pattern")
    return result(ok, F.when(ok & odd, "uncertain").when(ok, "valid").otherwise("invalid"), F.when(ok, value), F.when(ok & odd, 0.3).when(ok, 0.9).otherwise(0.0), error, length=F.when(ok, n))


def name_loose_result(column: str, longest: int) -> Column:
    value, _ = _given(column)
    return _plain(F.length(value).between(2, longest), value, 1.0, "Invalid name", F.lit(False), "")


def contact_name_result(first: str, last: str) -> Column:
    a, b = F.trim(F.coalesce(F.col(first), F.lit(""))), F.trim(F.coalesce(F.col(last), F.lit("")))
    missing = (a == "") | (b == "")
    return _plain(a.rlike(NAME) & b.rlike(NAME), F.concat_ws(" ", a, b), 0.9, "Invalid characters in name", missing, "First and last name are required")


def _adder(make, name: str):
    def job(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumn(name, make(*columns))

    return job


validate_emails, validate_phones = _adder(email_result, "email_check"), _adder(phone_result, "phone_check")
validate_urls, validate_urls_loose = _adder(url_result, "url_check"), _adder(url_loose_result, "url_check")
validate_domains, validate_domains_loose = _adder(domain_result, "domain_check"), _adder(domain_loose_result, "domain_check")
validate_linkedin, validate_company_names, validate_contact_names = _adder(linkedin_result, "linkedin_check"), _adder(company_name_result, "name_check"), _adder(contact_name_result, "name_check")


def business_emails(df: DataFrame, column: str = "email") -> DataFrame:
    check = email_result(column)
    return df.where(check["is_valid"] & (F.coalesce(check["metadata"]["type"], F.lit("")) == "business"))


def _checks(df: DataFrame) -> dict[str, Column]:
    made = {
        "email": lambda: email_result("email"), "phone": lambda: phone_result("phone"), "website": lambda: url_result("website"), "domain": lambda: domain_result("domain"), "linkedin_url": lambda: linkedin_result("linkedin_url"),
        "name": lambda: company_name_result("name"),
    }
    out = {c: make() for c, make in made.items() if c in df.columns}
    if {"first_name", "last_name"} <= set(df.columns):
        out["contact_name"] = contact_name_result("first_name", "last_name")
    return out


def checked_fields(df: DataFrame) -> list[str]:
    """The fields of ``df`` that ``validate_records`` checks."""
    return list(_checks(df))


def validate_records(df: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with ``validation``, a map from field to result, for the fields that it has; strict keeps rows whose given fields are all valid."""
    checks = _checks(df)
    out = df.withColumn("validation", F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)]))
    if strict:
        given = {k: F.col(k).isNotNull() if k in df.columns else F.lit(True) for k in checks}
        bad = F.exists(F.array(*[F.struct((F.col("validation")[k]["is_valid"] | ~given[k]).alias("ok")) for k in checks]), lambda x: ~x["ok"])
        out = out.where(~bad)
    return out


def validate_all_fields(df: DataFrame, key: str = "id") -> DataFrame:
    """Long form ``(id, field, is_valid, status, confidence, errors)``."""
    rows = [F.struct(F.lit(k).alias("field"), v["is_valid"].alias("is_valid"), v["status"].alias("status"), v["confidence"].alias("confidence"), v["errors"].alias("errors")) for k, v in _checks(df).items()]
    return df.select(F.col(key), F.inline(F.array(*rows)))


def triage_scraped(scraped: DataFrame, results: DataFrame, groups: DataFrame) -> DataFrame:
    """``scraped`` with a new ``validation_status`` and ``duplicate_of``.

    ``results(id, is_valid)``: false means needs_review; ``groups(id, group_id)``: a row other than its group's id is a
    duplicate of it; a missing contact_id is flagged incomplete. Duplicate comes first, then review, then incomplete.
    """
    r = results.select(F.col("id").alias("__r"), F.col("is_valid").alias("__ok"))
    g = groups.where("id <> group_id").select(F.col("id").alias("__g"), F.col("group_id").alias("duplicate_of"))
    rows = with_columns(scraped, contact_id="long").drop("duplicate_of").join(r, F.col("id") == F.col("__r"), "left").join(g, F.col("id") == F.col("__g"), "left")
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(~F.col("__ok"), "needs_review").when(F.col("contact_id").isNull(), "incomplete").otherwise(F.col("validation_status"))
    return rows.withColumn("validation_status", status).drop("__r", "__ok", "__g")


#: What screened text must not hold.
SCREENS = {
    "sql": r"(?i)\b(union\s+select|drop\s+table|insert\s+into|delete\s+from|or\s+1\s*=\s*1)\b|--\s|;\s*--",
    "script": r"(?i)<script|javascript:|on(?:load|error|click)\s*=|<iframe",
    "path": r"\.\./|\.\.\\",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
}


def screen_inputs(df: DataFrame, columns: list[str], key: str = "id", longest: int = 1000) -> DataFrame:
    """``(id, column, rule)`` for each text with an injection, script, path or control pattern, or over-long."""
    rows = df.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    hit = [F.when(F.col("value").rlike(p), name) for name, p in SCREENS.items()] + [F.when(F.length("value") > longest, "length")]
    return rows.select(key, "column", F.explode(F.array_compact(F.array(*hit))).alias("rule"))
