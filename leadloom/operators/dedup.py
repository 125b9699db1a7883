"""Duplicates: blocking keys, candidate pairs, similarities, groups and merges.

Rows that share a key form a block, and all pairs of a block are candidates. Keys are host, e-mail, phone, its last ten digits and
name; bands of minimum hashes over the name's 3-grams are keys of their own where near names are wanted (``fuzzy``). In a block of
more than ``full`` rows the shared key says little, and a pair is a candidate if something else speaks for it as well: a second
equal key or user of an e-mail, or a near name, e-mail or phone, found by an exact set-similarity join of 3-grams (``near_sets``)
that loses no pair. Rows that have no other field in common, so that nothing speaks against them, are linked through the first
row of each pattern of given fields.
Groups are connected components by repeated minimum, never gathered.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import filled
from ..functions.graph import components, saved
from .scoring import with_columns
from .select import host

#: Fixed values.
NAME_SUFFIXES = ("inc", "llc", "ltd", "corp", "corporation", "company", "co")
COMPANY_THRESHOLDS = {"name": 0.85, "domain": 0.9, "email": 0.8, "phone": 0.8}
CONTACT_THRESHOLDS = {"name": 0.85, "email": 0.9, "phone": 0.8}
COMPANY_FIELDS = ("name", "domain", "website", "email", "phone", "address", "description")
CONTACT_FIELDS = ("first_name", "last_name", "email", "phone", "job_title", "company")
#: Blocks of up to so many rows give all their pairs; in larger ones values are near from this Jaccard similarity of their 3-grams on.
FULL, NEAR = 1000, 0.6
KEYS = ("host_key", "email_key", "phone_key", "phone10_key", "name_key")
#: Minimum hashes of name 3-grams: bands of two. Names whose 3-grams have a Jaccard similarity of 0.6 share one with probability 0.99.
BANDS, BAND_ROWS = 10, 2
ENTRIES = "array<struct<kind: int, value: string>>"
#: The kind of an e-mail's user, which is a second key only.
USER = 1000


def norm_name(c: Column) -> Column:
    """Lower case, white space collapsed, punctuation and business suffixes off."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), "[.,;:!?\"'-]", "")
    return F.trim(F.regexp_replace(out, rf"\b(?:{'|'.join(NAME_SUFFIXES)})\b", ""))


def norm_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def norm_url(c: Column) -> Column:
    value = F.lower(F.trim(c))
    return F.regexp_replace(F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://"), value)), "/+$", "")


def norm_keys(df: DataFrame) -> DataFrame:
    """``df`` with ``name_key, phone_key, phone10_key, url_key, host_key, email_key`` for the fields that it has; empty ones null."""
    none = lambda c: F.nullif(c, F.lit(""))
    keys = {}
    if "name" in df.columns:
        keys["name_key"] = none(norm_name(F.col("name")))
    elif {"first_name", "last_name"} <= set(df.columns):
        keys["name_key"] = none(norm_name(F.concat_ws(" ", "first_name", "last_name")))
    if "phone" in df.columns:
        phone = norm_phone(F.col("phone"))
        keys |= {"phone_key": none(phone), "phone10_key": F.when(F.length(phone) >= 10, F.substring(phone, -10, 10))}
    if "website" in df.columns:
        keys |= {"url_key": F.when(filled("website"), norm_url(F.col("website"))), "host_key": host("website")}
    if "email" in df.columns:
        mail = F.lower(F.trim("email"))
        keys["email_key"] = F.when(F.contains(mail, F.lit("@")), mail)
    return df.withColumns(keys)


def grams3(c: Column) -> Column:
    """Distinct 3-grams of a text, the whole of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1)))
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(3)))))


def name_bands(name: Column, bands: int = BANDS, rows: int = BAND_ROWS) -> Column:
    """Array of band keys of a normalised name, null for null: minimum MD5 of its distinct 3-grams (the whole of a shorter one)."""
    least = lambda k: F.array_min(F.transform(grams3(name), lambda g: F.md5(F.concat(F.lit(f"{k}:"), g))))
    return F.when(name.isNotNull(), F.array(*[F.concat(*[F.substring(least(b * rows + r), 1, 12) for r in range(rows)]) for b in range(bands)]))


def _bin(size: Column) -> Column:
    """Lower end of the range of sizes that ``size`` lies in: single sizes up to 16, then eight ranges to each doubling."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(size) + 1e-9) - 3)).cast("int")
    return (F.floor(size / step) * step).cast("int")


def _least(share: float, n: Column) -> Column:
    return F.ceil(F.round(share * n, 9)).cast("int")


def near_keys(sets: DataFrame, threshold: float = NEAR) -> DataFrame:
    """The rows that ``near_sets`` joins: ``(group, gram, low, high, value, grams, size, bin, pos)``, saved.

    A set's first grams by rarity in the group, for each range of sizes (``bin``) that the group has and that can be similar
    enough; ``low`` and ``high`` are the set's own range and the other one, ``pos`` is the gram's place, from 0.
    """
    sets = sets.where("group is not null and value is not null and size(grams) > 0")
    sets = sets.select("group", "value", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"))
    tokens = saved(sets.select("group", "value", F.explode("grams").alias("gram")), "near-grams")
    counts = saved(tokens.groupBy("group", "gram").agg(F.count("*").alias("n")), "near-counts")
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"])
    ordered = tokens.join(counts, ["group", "gram"]).groupBy("group", "value").agg(rarest.alias("grams")).withColumn("size", F.size("grams"))
    ordered = saved(ordered.withColumn("bin", _bin(F.col("size"))), "near-ordered")
    bins = saved(ordered.groupBy("group", "bin").agg(F.min("size").alias("from"), F.max("size").alias("to")), "near-bins")
    towards = bins.groupBy("group").agg(F.collect_list(F.struct("bin", "from", "to")).alias("bins"))
    keyed = ordered.join(saved(towards, "near-towards"), "group").select("group", "value", "grams", "size", "bin", F.explode("bins").alias("other"))
    # The smallest size of the range that can be similar enough says how many grams two sets must share at least.
    other = F.greatest(F.col("other.from"), _least(threshold, F.col("size")))
    head = F.col("size") - _least(threshold / (1 + threshold), F.col("size") + other) + 1
    keyed = keyed.where((F.col("other.to") >= other) & (F.col("other.from") <= F.floor(F.round(F.col("size") / threshold, 9))) & (head > 0))
    keyed = keyed.select("group", "value", "grams", "size", "bin", F.least("bin", "other.bin").alias("low"), F.greatest("bin", "other.bin").alias("high"), F.posexplode(F.slice("grams", F.lit(1), head)).alias("pos", "gram"))
    # Small in bytes but not in work, so dealt out evenly: rows that were read as one small file would be compared in one task.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(keyed.repartition(parts, "group", "value", "pos"), "near-prefixes")


def near_sets(sets: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Exact set-similarity self-join of ``sets(group, value, grams)``: ``(group, value_a, value_b)`` with value_a < value_b.

    Pairs of one group whose ``grams`` (distinct strings) have a Jaccard similarity of ``threshold`` or more, each once; ``value``
    is unique in its group. The grams of a set are put in order of rarity in the group; two sets that are similar enough have
    about equal sizes (length filter) and share one of their first few grams (prefix filter). How many depends on both sizes, and
    sets of one size need the fewest, so a set is keyed for each range of sizes by itself (``near_keys``), and a gram that many sets
    have is a key only where it is needed. Survivors are verified on the whole sets. Groups, values and sets that are null are left
    out, as are empty sets. Rows grow with the sets and with the pairs that share a rare gram, not with the square of a group.
    """
    keyed = near_keys(sets, threshold)
    side = lambda s, at: keyed.where(F.col("bin") == F.col(at)).select("group", "gram", "low", "high", *[F.col(c).alias(f"{c}_{s}") for c in ("value", "grams", "size", "pos")])
    wanted = _least(threshold / (1 + threshold), F.col("size_a") + F.col("size_b"))
    left = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))  # positions count from 0
    met = side("a", "low").join(side("b", "high"), ["group", "gram", "low", "high"])
    met = met.where(((F.col("low") < F.col("high")) | (F.col("value_a") < F.col("value_b"))) & (left >= wanted))
    met = met.where((F.col("size_b") >= threshold * F.col("size_a") - 1e-9) & (F.col("size_a") >= threshold * F.col("size_b") - 1e-9))
    first = ~F.arrays_overlap(F.slice("grams_a", 1, F.col("pos_a")), F.slice("grams_b", 1, F.col("pos_b")))  # no earlier gram is shared
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return met.where((shared >= wanted) & first).select("group", F.least("value_a", "value_b").alias("value_a"), F.greatest("value_a", "value_b").alias("value_b"))


def _near_pairs(leads: DataFrame, values: DataFrame, full: int, near: float) -> DataFrame:
    """``(id_a, id_b)`` of rows of one block whose ``values(__id, kind, known, scope, value, grams)`` are near or equal.

    Values of which a key in ``known`` made the block say nothing in it and are left out.

    A value that over ``full`` rows of the block hold is met through the first of them, to which the others are linked.
    """
    held = leads.join(values, (F.col("id") == F.col("__id")) & ~F.arrays_overlap("kinds", "known"))
    held = saved(held.select("id", F.xxhash64("block", "kind", "scope").alias("group"), F.xxhash64("value").alias("value"), "grams"), "dup-values")
    classes = saved(held.groupBy("group", "value").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.any_value("grams").alias("grams")), "dup-classes")
    pairs = saved(near_sets(classes, near), "dup-near")
    members = saved(held.join(classes.drop("grams"), ["group", "value"]).where((F.col("n") <= full) | (F.col("id") == F.col("rep"))).select("group", "value", "id"), "dup-members")
    side = lambda s: members.select("group", F.col("value").alias(f"value_{s}"), F.col("id").alias(f"id_{s}"))
    met = pairs.join(side("a"), ["group", "value_a"]).join(side("b"), ["group", "value_b"]).select("id_a", "id_b")
    met = met.union(members.where("id is not null").join(members.withColumnRenamed("id", "__other"), ["group", "value"]).select("id", "__other"))
    links = held.join(classes.drop("grams"), ["group", "value"]).where((F.col("n") > full) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b").union(links)


def dup_candidate_pairs(
    df: DataFrame, key: str = "id", keys: tuple[str, ...] = KEYS, full: int = FULL, fuzzy: bool = False, exhaustive: bool = False, near: float = NEAR
) -> DataFrame:
    """Distinct ``(id_a, id_b)`` with id_a < id_b of rows that share a key.

    All pairs of a block of up to ``full`` rows. In a larger one a row with all keys equal to an earlier one's pairs with that
    only; the others pair with the block's first row for each pattern of given keys (16 at most), so that rows that have nothing
    but the block's key in common are of one group. They pair with each other where a second key, or the part of e-mails before
    the @, is equal too (if over ``full`` rows share both, the same holds for these: at most one level per kind of key) or where
    names, phones, or the parts before the @ of e-mails of one domain are near: a Jaccard similarity of ``near`` or more of their
    3-grams, all such pairs, however many rows the block has. Rows that share one of the near values with over ``full`` others are
    met through the first of these, with which they pair.
    ``fuzzy`` adds name bands as keys. ``exhaustive`` compares all rows, for small tables only. Null keys share nothing; a null id
    pairs with nothing; an empty table gives no pairs.
    """
    if exhaustive:
        a, b = df.select(F.col(key).alias("id_a")), df.select(F.col(key).alias("id_b"))
        return a.join(b, F.col("id_a") < F.col("id_b"))
    given = [k for k in keys if k in df.columns]
    named = ["name_key"] if "name_key" in df.columns else []
    mailed = ["email_key"] if "email_key" in df.columns else []
    phoned = ["phone_key"] if "phone_key" in df.columns else []
    alike = list(dict.fromkeys([*given, *named, *mailed, *phoned]))
    same = F.xxhash64(F.lit(0), *alike, *[F.col(k).isNull() for k in alike])
    entries = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(k).alias("value")) for n, k in enumerate(given)]).cast(ENTRIES)
    fields = [k for k in alike if k != "phone10_key"]
    pattern = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") * 2**n for n, k in enumerate(fields)], F.lit(0))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), same.alias("same"), pattern.alias("pattern"), entries.alias("keys"), *[*named, *mailed, *phoned])
    if fuzzy and named:
        banded = F.transform(name_bands(F.col("name_key")), lambda v, n: F.struct((n + len(given)).alias("kind"), v.alias("value")))
        every = F.concat("keys", F.coalesce(banded.cast(ENTRIES), F.array().cast(ENTRIES)))
    else:
        every = F.col("keys")
    # A block is named by the hash of its kinds and values; kinds come in ascending order, so a set of keys makes one block.
    name = lambda *c: F.xxhash64(*c)
    level = rows.select("id", "same", "pattern", F.inline(every)).where("value is not null")
    level = level.select("id", "same", "pattern", F.array("kind").alias("kinds"), name("kind", "value").alias("block"))
    level, second, pairs = saved(level, "dup-keys"), None, []
    while True:
        sizes = saved(level.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "dup-blocks")
        small = saved(level.join(sizes.where(F.col("n") <= full), "block").select("block", "id"), "dup-small")
        pairs.append(small.select("block", F.col("id").alias("id_a")).join(small.select("block", F.col("id").alias("id_b")), "block").where("id_a < id_b").select("id_a", "id_b"))
        large = sizes.where(F.col("n") > full)
        if large.isEmpty():
            return reduce(DataFrame.union, pairs).distinct()
        inside = saved(level.join(large, "block"), "dup-large")
        least = saved(inside.groupBy("block", "same").agg(F.min("id").alias("lead")), "dup-leads")
        told = saved(inside.join(least, ["block", "same"]), "dup-told")
        pairs.append(told.where("id <> lead").select(F.col("lead").alias("id_a"), F.col("id").alias("id_b")))
        leads = told.where("id = lead")
        firsts = saved(leads.groupBy("block", "pattern").agg(F.min("id").alias("first")).drop("pattern"), "dup-firsts")
        linked = leads.join(firsts, "block").where("id <> first")
        pairs.append(linked.select(F.least("id", "first").alias("id_a"), F.greatest("id", "first").alias("id_b")))
        if second is None:
            second = saved(_second_keys(rows, given), "dup-second")
            values = saved(_near_values(rows, given), "dup-near-values")
        pairs.append(_near_pairs(leads, values, full, near))
        more = leads.join(second, (F.col("id") == F.col("__id")) & (F.col("kind") > F.element_at("kinds", -1)) & ~F.arrays_overlap("kinds", "known"))
        level = saved(more.select("id", "same", "pattern", F.concat("kinds", F.array("kind")).alias("kinds"), name("block", "kind", "value").alias("block")), "dup-level")


def _numbers(given: list[str], *keys: str) -> Column:
    """The kinds of keys as an array; -1 for one that is not used."""
    return F.array(*[F.lit(given.index(k) if k in given else -1) for k in keys])


def _second_keys(rows: DataFrame, given: list[str]) -> DataFrame:
    """``(__id, kind, known, value)``: the keys of a row, and the user of its e-mail in any domain."""
    keys = rows.select(F.col("id").alias("__id"), F.inline("keys")).select("__id", "kind", F.array().cast("array<int>").alias("known"), "value")
    if "email_key" in rows.columns:
        user = F.nullif(F.substring_index("email_key", "@", 1), F.lit(""))
        keys = keys.union(rows.select("id", F.lit(USER), _numbers(given, "email_key"), user))
    return keys.where("value is not null")


def _near_values(rows: DataFrame, given: list[str]) -> DataFrame:
    """``(__id, kind, known, scope, value, grams)``: names, phones, and e-mails by domain, with their 3-grams."""
    user, domain, none = F.substring_index("email_key", "@", 1), F.substring_index("email_key", "@", -1), F.lit("")
    cells = {
        "name_key": (_numbers(given, "name_key"), none, F.col("name_key"), F.col("name_key")),
        "email_key": (_numbers(given, "email_key"), domain, F.col("email_key"), user),
        "phone_key": (_numbers(given, "phone_key", "phone10_key"), none, F.col("phone_key"), F.col("phone_key")),
    }
    told = [
        F.struct(F.lit(k).alias("kind"), known.alias("known"), scope.alias("scope"), value.alias("value"), grams3(text).alias("grams"))
        for k, (known, scope, value, text) in cells.items()
        if k in rows.columns
    ]
    if not told:
        return rows.sparkSession.createDataFrame([], "__id long, kind string, known array<int>, scope string, value string, grams array<string>")
    return rows.select(F.col("id").alias("__id"), F.inline(F.array(*told))).where("value is not null")


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def common_characters(a: Column, b: Column) -> Column:
    """Characters that two texts share, each as often as in both."""
    held = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(held(a, c), held(b, c)))


def ratio(a: Column, b: Column, metric: str = "ratio") -> Column:
    """0 if one is empty, 1 if equal, else 2M/T by matching blocks (Arrow batches), or 1 - distance / longer (native).

    ``bound`` is what neither can exceed, native: the characters that both have, whatever their order, in place of the matching ones.
    """
    if metric == "bound":
        near = 2.0 * common_characters(a, b) / (F.length(a) + F.length(b))
    elif metric == "levenshtein":
        near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)).cast("double")
    else:
        near = F.pandas_udf(_ratios, "double")(a, b)
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, 0.0).when(a == b, 1.0).otherwise(near)


def _either_empty(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")


def string_score(a: Column, b: Column, metric: str) -> Column:
    x, y = norm_name(a), norm_name(b)
    return F.when(_either_empty(a, b), 0.0).when(x == y, 1.0).otherwise(ratio(x, y, metric))


def email_score(a: Column, b: Column, metric: str) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    at = F.contains(x, F.lit("@")) & F.contains(y, F.lit("@"))
    user, domain = (lambda c: F.substring_index(c, "@", 1)), (lambda c: F.get(F.split(c, "@"), F.lit(1)))
    return F.when(_either_empty(a, b), 0.0).when(x == y, 1.0).when(at & (domain(x) == domain(y)), 0.5 + 0.5 * string_score(user(x), user(y), metric)).otherwise(string_score(x, y, metric))


def phone_score(a: Column, b: Column, metric: str) -> Column:
    x, y = norm_phone(a), norm_phone(b)
    return F.when(_either_empty(a, b), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(string_score(x, y, metric))


def url_score(a: Column, b: Column, metric: str) -> Column:
    x, y = norm_url(a), norm_url(b)
    return F.when(_either_empty(a, b), 0.0).when(x == y, 1.0).when(host(x) == host(y), 0.9).otherwise(string_score(x, y, metric))


def _scored(pairs: DataFrame, a: str, b: str, name: str, score, metric: str) -> DataFrame:
    return pairs.withColumn(name, F.round(score(F.col(a), F.col(b), metric), 6))


def string_similarity(pairs: DataFrame, a: str, b: str, metric: str = "ratio") -> DataFrame:
    """``pairs`` with ``similarity`` of two name columns."""
    return _scored(pairs, a, b, "similarity", string_score, metric)


def email_similarity(pairs: DataFrame, a: str, b: str, metric: str = "ratio") -> DataFrame:
    return _scored(pairs, a, b, "similarity", email_score, metric)


def phone_similarity(pairs: DataFrame, a: str, b: str, metric: str = "ratio") -> DataFrame:
    return _scored(pairs, a, b, "similarity", phone_score, metric)


def url_similarity(pairs: DataFrame, a: str, b: str, metric: str = "ratio") -> DataFrame:
    return _scored(pairs, a, b, "similarity", url_score, metric)


#: Types of match from the surest down, with the least confidence of each.
TYPES = {"exact": 0.9, "high": 0.8, "medium": 0.6, "low": 0.4}


def _mean(scores: list[Column]) -> Column:
    some = F.filter(F.array(*scores), lambda s: s.isNotNull())
    return F.when(F.size(some) > 0, F.round(F.aggregate(some, F.lit(0.0), lambda a, s: a + s) / F.size(some), 6)).otherwise(0.0)


def _possible(met: DataFrame, scores: dict, thresholds: dict[str, float], decisive: str, least: str) -> DataFrame:
    """The pairs that may be matches of type ``least`` or surer: those whose scores' bounds reach its confidence, or the decisive field's threshold."""
    given = lambda c: filled(f"{c}_a") & filled(f"{c}_b")
    bounds = {f: F.when(given(c), F.round(score(F.col(f"{c}_a"), F.col(f"{c}_b"), "bound"), 6)) for f, (c, score) in scores.items()}
    met = met.withColumns({f"__b_{f}": b for f, b in bounds.items()})
    reached = (_mean([F.col(f"__b_{f}") for f in scores]) >= TYPES[least]) | F.coalesce(F.col(f"__b_{decisive}") >= thresholds[decisive], F.lit(False))
    return met.where(reached).drop(*[f"__b_{f}" for f in scores])


def _matches(df: DataFrame, pairs: DataFrame, scores: dict, thresholds: dict[str, float], decisive: str, metric: str, least: str | None = None) -> DataFrame:
    fields = list(scores)
    side = lambda s: df.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c, _ in scores.values()])
    met = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    given = lambda c: filled(f"{c}_a") & filled(f"{c}_b")
    if least is not None and metric == "ratio":  # saved, so that what is left is dealt out evenly before Python compares it
        met = saved(_possible(met, scores, thresholds, decisive, least), "dup-possible")
    met = met.withColumns({f"s_{f}": F.when(given(c), F.round(score(F.col(f"{c}_a"), F.col(f"{c}_b"), metric), 6)) for f, (c, score) in scores.items()})
    pick = lambda test: F.array_compact(F.array(*[F.when(test(F.col(f"s_{f}"), thresholds[f]), f) for f in fields]))
    met = met.withColumns({"matching_fields": pick(lambda s, t: s >= t), "conflicting_fields": pick(lambda s, t: (s < 0.3) & (s < t))})
    met = met.withColumn("confidence", _mean([F.col(f"s_{f}") for f in fields]))
    c, any_ = F.col("confidence"), F.coalesce(*[F.col(f"s_{f}") for f in fields]).isNotNull()
    kind = F.when(any_ & ((c >= TYPES["exact"]) | F.array_contains("matching_fields", decisive)), "exact").when(c >= TYPES["high"], "high").when(c >= TYPES["medium"], "medium").when(c >= TYPES["low"], "low").otherwise("no_match")
    if least is not None:
        met = met.where(kind.isin(*list(TYPES)[: list(TYPES).index(least) + 1]))
    return met.select("id_a", "id_b", kind.alias("match_type"), "confidence", "matching_fields", "conflicting_fields", F.struct(*[F.col(f"s_{f}").alias(f) for f in fields]).alias("field_scores"))


def company_matches(
    df: DataFrame, thresholds: dict[str, float] = COMPANY_THRESHOLDS, metric: str = "ratio", pairs: DataFrame | None = None, fuzzy: bool = False, least: str | None = None
) -> DataFrame:
    """Candidate pairs with scores of name, domain (or website), e-mail and phone, their mean, and the type of match.

    ``fuzzy`` takes as candidates also rows of near names that share no key. ``least`` keeps matches of this type and surer ones;
    pairs that cannot be one by the characters of their fields are left out natively before any is compared block by block.
    """
    c = with_columns(df, domain="string")
    c = c.withColumn("site", F.coalesce(F.nullif("domain", F.lit("")), "website"))
    pairs = dup_candidate_pairs(norm_keys(c), fuzzy=fuzzy) if pairs is None else pairs
    return _matches(c, pairs, {"name": ("name", string_score), "domain": ("site", url_score), "email": ("email", email_score), "phone": ("phone", phone_score)}, thresholds, "domain", metric, least)


def contact_matches(
    df: DataFrame, thresholds: dict[str, float] = CONTACT_THRESHOLDS, metric: str = "ratio", pairs: DataFrame | None = None, fuzzy: bool = False, least: str | None = None
) -> DataFrame:
    """The same over contacts: scores of full name, e-mail (which decides) and phone."""
    c = df.withColumn("full", F.concat_ws(" ", "first_name", "last_name"))
    pairs = dup_candidate_pairs(norm_keys(df), fuzzy=fuzzy) if pairs is None else pairs
    return _matches(c, pairs, {"name": ("full", string_score), "email": ("email", email_score), "phone": ("phone", phone_score)}, thresholds, "email", metric, least)


def duplicate_groups(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """``(id, group_id)`` over exact and high matches; the group is its smallest id, a row without match its own group."""
    edges = matches.where(F.col("match_type").isin("exact", "high")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    groups = components(edges, "dup-groups")
    return ids.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group_id"))


def _grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(groups.select(F.col("id").alias("__id"), "group_id"), F.col("id") == F.col("__id")).drop("__id")


def merge_keep_first(df: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of the lowest id per group."""
    return _grouped(df, groups).groupBy("group_id").agg(F.min_by(F.struct(*df.columns), "id").alias("r")).select("group_id", "r.*")


def merge_keep_last(df: DataFrame, groups: DataFrame) -> DataFrame:
    return _grouped(df, groups).groupBy("group_id").agg(F.max_by(F.struct(*df.columns), "id").alias("r")).select("group_id", "r.*")


def completeness(df: DataFrame, fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [filled(f).cast("int") for f in fields if f in df.columns], F.lit(0))


def merge_most_complete(df: DataFrame, groups: DataFrame, fields: tuple[str, ...] = COMPANY_FIELDS) -> DataFrame:
    """The row with the most of the fields filled, the lowest id on a tie."""
    return _grouped(df, groups).groupBy("group_id").agg(F.min_by(F.struct(*df.columns), F.struct(-completeness(df, fields), "id")).alias("r")).select("group_id", "r.*")


def merge_highest_confidence(df: DataFrame, groups: DataFrame, quality: str = "data_quality_score") -> DataFrame:
    return _grouped(df, groups).groupBy("group_id").agg(F.min_by(F.struct(*df.columns), F.struct(-F.coalesce(quality, F.lit(0.0)), "id")).alias("r")).select("group_id", "r.*")


def merge_all(df: DataFrame, groups: DataFrame, priority: tuple[str, ...] = ("name", "domain", "website", "email", "phone", "address")) -> DataFrame:
    """Per group: first non-blank of the priority fields, first non-null of others, union of string lists, by id order.

    Each list of a group's row has the group's distinct strings, so a row grows with them.
    """
    rows = _grouped(df, groups)
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if kinds[c] == "array<string>":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        given = filled(c) if c in priority else F.col(c).isNotNull()
        value = F.struct(F.col(c)) if kinds[c].startswith("map") else F.col(c)
        out = F.min_by(F.when(given, value), F.when(given, F.col("id")))
        return (out[c] if kinds[c].startswith("map") else out).alias(c)

    return rows.groupBy("group_id").agg(F.min("id").alias("id"), *[one(c) for c in df.columns if c != "id"])


def dedup_report(df: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: rows before and after, groups of more than one, rows removed."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("removed"))


def exact_duplicates(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows beyond the first, by key, per value of the columns; nulls are equal. Rows that repeat the first one's key are that row.

    The minima are saved before they meet the rows, so that a hot value can be split.
    """
    first = saved(df.groupBy(*columns).agg(F.min(key).alias("__first")), "first-of-equal").withColumnsRenamed({c: f"__{c}" for c in columns})
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return df.join(first, equal).where(F.col(key) > F.col("__first")).select(*df.columns)
