"""Cleaning jobs: each adds a struct (value, changes, confidence, metadata) for one field.

Expressions only, but for Unicode decomposition (NFKD), which has no built-in: an Arrow function that only rows with a
non-ASCII character reach.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SUFFIX_FORMS = {"inc": "Inc.", "corp": "Corp.", "llc": "LLC", "ltd": "Ltd.", "co": "Co."}
BUSINESS_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "llc", "l.l.c", "ltd", "limited", "co", "company", "lp", "l.p", "llp", "l.l.p", "pllc", "p.l.l.c",
    "gmbh", "ag", "sa", "srl", "bv", "nv", "oy", "ab", "as",
)
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "madam")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")
STREETS = {"st": "Street", "ave": "Avenue", "rd": "Road", "blvd": "Boulevard", "dr": "Drive", "ln": "Lane", "ct": "Court", "pl": "Place", "cir": "Circle", "way": "Way"}
DIRECTIONS = {"n": "North", "s": "South", "e": "East", "w": "West", "ne": "Northeast", "se": "Southeast", "sw": "Southwest", "nw": "Northwest"}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
EMAILS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = r"[+]?[1-9]?[0-9]{7,15}"
URLS = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
ZIP = r"\b[0-9]{5}(-[0-9]{4})?\b"


def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x))


def nfkd(column: Column) -> Column:
    """NFKD form, in Arrow batches."""
    return F.pandas_udf(_decomposed, "string")(column)


def result(value: Column, changes: Column, confidence: Column, empty: Column, message: str, **metadata: Column) -> Column:
    """The result struct; where ``empty``, an empty value with one message and confidence 0."""
    meta = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]) if metadata else F.create_map().cast("map<string,string>")
    return F.when(empty, F.struct(F.lit("").alias("value"), F.array(F.lit(message)).alias("changes"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("metadata"))).otherwise(
        F.struct(value.alias("value"), changes.alias("changes"), F.round(confidence, 6).alias("confidence"), meta.alias("metadata"))
    )


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper case, others lower: restarts after any non-letter."""
    marked = F.regexp_replace(F.lower(text), r"(?<!\p{L})(\p{L})", "\u0000$1")
    parts = F.split(marked, "\u0000")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647)))), "")


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _step(df: DataFrame, before: Column, after: Column, change: str | Column) -> DataFrame:
    """One rule over the working columns ``__v`` and ``__c``: the new value, and the change noted if it differs."""
    note = F.lit(change) if isinstance(change, str) else change
    new = df.withColumn("__n", after)
    return new.withColumns({"__c": F.when(F.col("__n") != before, F.array_append("__c", note)).otherwise(F.col("__c")), "__v": F.col("__n")}).drop("__n")


def _basic(df: DataFrame, column: str, preserve_case: bool) -> DataFrame:
    v = F.col("__v")
    df = df.withColumns({"__v": F.coalesce(F.col(column), F.lit("")), "__c": F.array().cast("array<string>")})
    df = _step(df, v, F.regexp_replace(v, "<[^>]+>", ""), "Removed HTML tags")
    df = _step(df, v, F.when(v.rlike(r"[^\x00-\x7F]"), nfkd(v)).otherwise(v), "Normalized unicode characters")
    df = _step(df, v, F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), "Normalized whitespace")
    if not preserve_case:
        letters = v.rlike(r"\p{L}")
        df = _step(df, v, F.when(letters & ((v == F.upper(v)) | (v == F.lower(v))), title_case(v)).otherwise(v), "Normalized case")
    return df


def _done(df: DataFrame, column: str, name: str, floor: float, each: float, message: str, **metadata: Column) -> DataFrame:
    confidence = F.greatest(F.lit(floor), 1.0 - F.size("__c") * each)
    return df.withColumn(name, result(F.col("__v"), F.col("__c"), confidence, _empty(column), message, **metadata)).drop("__v", "__c")


def clean_text(df: DataFrame, column: str, preserve_case: bool = False) -> DataFrame:
    """``df`` with ``<column>_clean``: tags out, NFKD, white space collapsed, title case if all upper or all lower."""
    return _done(_basic(df, column, preserve_case), column, f"{column}_clean", 0.5, 0.1, "Empty or invalid input")


def clean_company_names(df: DataFrame, column: str = "name") -> DataFrame:
    """Also a leading article off, a final suffix in its standard form, repeated words out."""
    v = F.col("__v")
    df = _basic(df, column, True)
    article = F.lower(F.regexp_extract(v, r"(?i)^(the|an|a) ", 1))
    df = _step(df, v, F.regexp_replace(v, r"(?i)^(the|an|a) ", ""), F.concat(F.lit("Removed prefix '"), article, F.lit("'")))
    last = F.regexp_replace(F.lower(F.element_at(F.split(v, " "), -1)), r"\.+$", "")
    forms = F.create_map(*[F.lit(x) for pair in SUFFIX_FORMS.items() for x in pair])
    suffixed = F.when(forms[last].isNotNull(), F.regexp_replace(v, r"\S+$", forms[last])).otherwise(v)
    df = df.withColumns({"__c": F.when(forms[last].isNotNull(), F.array_append("__c", F.lit("Standardized business suffix"))).otherwise(F.col("__c")), "__v": suffixed})
    words = F.split(v, " ")
    df = df.withColumn("__l", F.transform(words, F.lower))
    seen = F.transform("__l", lambda w, i: F.array_contains(F.slice("__l", F.lit(1), i), w))
    pairs = F.arrays_zip(words.alias("w"), seen.alias("s"))
    gone = F.transform(F.filter(pairs, lambda p: p["s"]), lambda p: F.concat(F.lit("Removed duplicate word '"), p["w"], F.lit("'")))
    kept = F.array_join(F.transform(F.filter(pairs, lambda p: ~p["s"]), lambda p: p["w"]), " ")
    df = df.withColumns({"__c": F.concat("__c", gone), "__v": F.trim(kept)}).drop("__l")
    has = F.exists(F.split(v, " "), lambda w: F.regexp_replace(F.lower(w), r"\.+$", "").isin(*BUSINESS_SUFFIXES))
    return _done(df, column, f"{column}_clean", 0.6, 0.05, "Empty or invalid company name", word_count=F.size(F.split(v, " ")), has_suffix=has)


def clean_person_names(df: DataFrame, column: str) -> DataFrame:
    """Titles and suffixes off, every word capitalised."""
    v = F.col("__v")
    df = _basic(df, column, False)
    words = F.filter(F.split(v, " "), lambda w: w != "")
    drop = lambda w: F.regexp_replace(F.lower(w), r"\.+$", "").isin(*TITLES, *NAME_SUFFIXES)
    gone = F.transform(F.filter(words, drop), lambda w: F.concat(F.lit("Removed title/suffix '"), w, F.lit("'")))
    kept = F.transform(F.filter(words, lambda w: ~drop(w)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2147483647))))
    df = df.withColumns({"__c": F.concat("__c", gone), "__v": F.array_join(kept, " ")})
    return _done(df, column, f"{column}_clean", 0.7, 0.1, "Empty or invalid name", word_count=F.size(F.filter(F.split(v, " "), lambda w: w != "")))


def clean_emails(df: DataFrame, column: str = "email") -> DataFrame:
    """Trimmed, lower case, without spaces; .1 if it has not exactly one @, .9 if spaces went, else 1."""
    raw = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    value = F.replace(raw, F.lit(" "), F.lit(""))
    spaces, bad = value != raw, F.length(value) - F.length(F.replace(value, F.lit("@"), F.lit(""))) != 1
    changes = F.array_compact(F.array(F.when(spaces, "Removed spaces"), F.when(bad, "Invalid email format")))
    return df.withColumn(f"{column}_clean", result(value, changes, F.when(bad, 0.1).when(spaces, 0.9).otherwise(1.0), _empty(column), "Empty or invalid email", domain=F.when(~bad, F.substring_index(value, "@", -1))))


def clean_phones(df: DataFrame, column: str = "phone") -> DataFrame:
    """Digits and one leading +; +1 before ten digits, + before eleven that begin with 1."""
    raw, bare, value = F.col("__r"), F.col("__b"), F.col("__v")  # working columns: as one expression a step is copied into all that read it
    plus = F.contains(raw, F.lit("+")) & ((F.length(raw) - F.length(F.replace(raw, F.lit("+"), F.lit(""))) > 1) | ~raw.startswith("+"))
    ten, eleven = (F.length(bare) == 10) & ~bare.startswith("+"), (F.length(bare) == 11) & bare.startswith("1")
    df = df.withColumn("__r", F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[^0-9+]", ""))
    df = df.withColumn("__p", plus).withColumn("__b", F.when(F.col("__p"), F.replace(raw, F.lit("+"), F.lit(""))).otherwise(raw))
    df = df.withColumns({"__t": ten, "__e": eleven})
    ten, eleven = F.col("__t"), F.col("__e")
    df = df.withColumn("__v", F.when(ten, F.concat(F.lit("+1"), bare)).when(eleven, F.concat(F.lit("+"), bare)).otherwise(bare))
    changes = F.array_compact(F.array(F.when(F.col("__p"), "Removed invalid + characters"), F.when(ten, "Added US country code").when(eleven, "Added + prefix")))
    done = result(value, changes, F.when(F.length(value) >= 10, 0.9).otherwise(0.5), _empty(column), "Empty or invalid phone", length=F.length(value))
    return df.withColumn(f"{column}_clean", done).drop("__r", "__p", "__b", "__t", "__e", "__v")


def normalize_handles(df: DataFrame, column: str) -> DataFrame:
    c = F.trim(F.col(column))
    return df.withColumn(column, F.when((c != "") & ~c.startswith("@"), F.concat(F.lit("@"), c)).otherwise(c))


def clean_urls(df: DataFrame, column: str = "website") -> DataFrame:
    """https:// if there is no scheme, host in lower case without www., no trailing slash, query kept, fragment dropped."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    bare = ~raw.rlike("^https?://")
    url = F.when(bare, F.concat(F.lit("https://"), raw)).otherwise(raw)
    part = lambda k: F.regexp_extract(url, r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    www = F.lower(part(2)).startswith("www.")
    host, path = F.regexp_replace(F.lower(part(2)), r"^www\.", ""), F.regexp_replace(part(3), "/+$", "")
    query = F.when(part(4) == "?", "").otherwise(part(4))
    changes = F.array_compact(F.array(F.when(bare, "Added HTTPS protocol"), F.when(www, "Removed www prefix")))
    return df.withColumn(f"{column}_clean", result(F.concat(part(1), F.lit("://"), host, path, query), changes, F.when(bare | www, 0.9).otherwise(1.0), _empty(column), "Empty or invalid URL", domain=host, has_path=path != "", has_query=query != ""))


def clean_addresses(df: DataFrame, column: str, strict_states: bool = False) -> DataFrame:
    """Street and direction words spelled out, then states abbreviated, commas put right.

    Street words come first, so CT is a Court; ``strict_states`` leaves a street or direction word alone in the last part.
    """
    v = F.col("__v")
    df = _basic(df, column, True)
    before = r"(?=.*,)" if strict_states else ""
    rules = [(rf"(?i)\b{a}\b{before}", full, f"Expanded '{a}' to '{full}'") for a, full in STREETS.items()]
    rules += [(rf"(?i)\b{a}\b{before}", full, f"Expanded direction '{a}' to '{full}'") for a, full in DIRECTIONS.items()]
    rules += [(rf"(?i)\b{name}\b", code, f"Abbreviated state '{name}' to '{code}'") for name, code in STATES.items()]
    # All rules in one pair of folds over the row: the value, and which rules found something when their turn came.
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(m).alias("m")) for p, r, m in rules])
    folded = F.aggregate(
        table, F.struct(v.alias("v"), F.col("__c").alias("c")),
        lambda acc, x: F.struct(F.regexp_replace(acc["v"], x["p"], x["r"]).alias("v"), F.when(F.regexp_like(acc["v"], x["p"]), F.array_append(acc["c"], x["m"])).otherwise(acc["c"]).alias("c")),
    )
    df = df.withColumn("__f", folded).withColumns({"__v": F.col("__f.v"), "__c": F.col("__f.c")}).drop("__f")
    df = df.withColumn("__v", F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(v, r"\s*,\s*", ", "), ",+", ",")), ",+$", ""))
    return _done(df, column, f"{column}_clean", 0.7, 0.05, "Empty or invalid address", has_zip=v.rlike(ZIP), is_po_box=v.rlike(r"(?i)\b(po|p\.o\.|post office)\s*box\s*[0-9]+\b"))


def parse_addresses(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_parts`` struct(street, city, state, zip_code, country), by commas; empty where unknown."""
    raw = F.coalesce(F.col(column), F.lit(""))
    code = F.regexp_extract(raw, ZIP, 0)
    parts = F.transform(F.split(F.trim(F.when(code != "", F.replace(raw, code, F.lit(""))).otherwise(raw)), ","), lambda p: F.trim(p))
    n = F.size(parts)
    at = lambda k, least: F.when(n >= least, F.get(parts, F.lit(k))).otherwise("")
    third = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    state = F.when(n < 3, "").when(F.upper(third).isin(*STATES.values()), F.upper(third)).otherwise(F.coalesce(names[F.lower(third)], F.lit("")))
    return df.withColumn(f"{column}_parts", F.struct(at(0, 1).alias("street"), at(1, 2).alias("city"), state.alias("state"), code.alias("zip_code"), F.lit("").alias("country")))


def _extract(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return df.select(F.col(key), F.explode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(pattern), F.lit(0))).alias("match"))


def extract_emails(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, match)`` per e-mail address in a text, in one scan."""
    return _extract(df, key, column, EMAILS)


def extract_phones(df: DataFrame, key: str, column: str) -> DataFrame:
    return _extract(df, key, column, PHONES)


def extract_urls(df: DataFrame, key: str, column: str) -> DataFrame:
    return _extract(df, key, column, URLS)


def _job(df: DataFrame, steps: dict, suffix: str = "_clean") -> DataFrame:
    """Apply each step to its column where the frame has it; the clean value replaces the field, results stay in ``cleaning``."""
    had = [c for c in steps if c in df.columns]
    out = df
    for c in had:
        out = steps[c](out, c)
    out = out.withColumn("cleaning", F.create_map(*[x for c in had for x in (F.lit(c), F.col(f"{c}{suffix}"))]))
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.col(f"{c}{suffix}.value")) for c in had}).drop(*[f"{c}{suffix}" for c in had])


def clean_companies(df: DataFrame) -> DataFrame:
    """The company job: name, e-mail, phone, website, address and description; other columns as they are."""
    return _job(df, {"name": clean_company_names, "email": clean_emails, "phone": clean_phones, "website": clean_urls, "address": clean_addresses, "description": lambda d, c: clean_text(d, c, True)})


def clean_contacts(df: DataFrame) -> DataFrame:
    return _job(df, {"first_name": clean_person_names, "last_name": clean_person_names, "email": clean_emails, "phone": clean_phones, "linkedin_url": clean_urls, "job_title": clean_text})


def cleaning_report(df: DataFrame) -> DataFrame:
    """``(field, change, rows, mean_confidence)`` from the ``cleaning`` column of a job."""
    rows = df.select(F.explode("cleaning").alias("field", "r")).select("field", F.explode("r.changes").alias("change"), F.col("r.confidence").alias("confidence"))
    return rows.groupBy("field", "change").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("mean_confidence"))
