"""Queries: duplicates. Similarities in queries with an oracle use the native metric; the other is held to hand rows in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from .q_select import HOST
from .registry import query

_L = "regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '[.,;:!?\"''-]', '', 'g')"


def _name(c: str) -> str:
    out = _L.format(c)
    for s in D.NAME_SUFFIXES:
        out = f"regexp_replace({out}, '\\b{s}\\b', '', 'g')"
    return f"trim({out})"


def _phone(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN ({d})[2:] ELSE {d} END"


def _url(c: str) -> str:
    return f"regexp_replace(CASE WHEN regexp_matches(lower(trim({c})), '^https?://') THEN lower(trim({c})) ELSE concat('https://', lower(trim({c}))) END, '/+$', '')"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


_KEYS = f"""k AS (SELECT id, nullif({_name('name')}, '') AS name_key, nullif({_phone('phone')}, '') AS phone_key, CASE WHEN length({_phone('phone')}) >= 10 THEN right({_phone('phone')}, 10) END AS phone10_key,
{HOST.format('website')} AS host_key, CASE WHEN contains(email, '@') THEN lower(trim(email)) END AS email_key FROM companies)"""
_PAIRS = f"""{_KEYS}, l AS (SELECT id, 'h' AS kind, host_key AS v FROM k UNION ALL SELECT id, 'e', email_key FROM k UNION ALL SELECT id, 'p', phone_key FROM k UNION ALL SELECT id, 't', phone10_key FROM k UNION ALL SELECT id, 'n', name_key FROM k),
p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM l a JOIN l b ON a.kind = b.kind AND a.v = b.v AND a.id < b.id)"""


@query("norm_keys", f"WITH {_KEYS} SELECT id, name_key, phone_key, phone10_key, host_key, email_key FROM k", "companies")
def _(t):
    return D.norm_keys(t.companies).select("id", "name_key", "phone_key", "phone10_key", "host_key", "email_key")


@query("dup_candidate_pairs", f"WITH {_PAIRS} SELECT id_a, id_b FROM p", "companies")
def _(t):
    return D.dup_candidate_pairs(D.norm_keys(t.companies))


def _linked(sql: str) -> str:
    """The same over the companies of which some come again."""
    return sql.replace("FROM companies", "FROM linked_companies").replace("JOIN companies", "JOIN linked_companies")


_GRAMS = f"""k AS (SELECT id, nullif({_name('name')}, '') AS name_key FROM companies),
g AS (SELECT id, CASE WHEN length(name_key) < 3 THEN [name_key] ELSE list_distinct(list_transform(range(1, length(name_key) - 1), lambda i: substr(name_key, i, 3))) END AS grams FROM k WHERE name_key IS NOT NULL),
b AS (SELECT id, band, left(list_min(list_transform(grams, lambda g: md5((2 * band) || ':' || g))), 12) || left(list_min(list_transform(grams, lambda g: md5((2 * band + 1) || ':' || g))), 12) AS v FROM g, range(0, 10) r(band))"""


@query("fuzzy_candidate_pairs", f"WITH {_GRAMS} SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM b x JOIN b y ON x.band = y.band AND x.v = y.v AND x.id < y.id", "companies")
def _(t):
    return D.dup_candidate_pairs(D.norm_keys(t.companies), keys=(), fuzzy=True)


#: In a large block rows without e-mail are equal in all keys, and all are linked to the first row with and without one.
_CROWD = f"""k AS (SELECT id, {_name("concat_ws(' ', first_name, last_name)")} AS v, CASE WHEN contains(email, '@') THEN lower(trim(email)) END AS mail FROM crowded_contacts),
s AS (SELECT v, count(*) AS n, min(id) FILTER (mail IS NOT NULL) AS mailed, min(id) FILTER (mail IS NULL) AS bare FROM k GROUP BY v),
g AS (SELECT id, v, n, mail, mailed, bare, string_split(mail, '@')[1] AS user_part, string_split(mail, '@')[2] AS domain, list_distinct(list_transform(range(1, length(string_split(mail, '@')[1]) - 1), lambda i: substr(mail, i, 3))) AS grams FROM k JOIN s USING (v)),
f AS (SELECT id, mailed AS o FROM g WHERE n > {D.FULL} AND (mail IS NOT NULL OR id = bare) UNION ALL SELECT id, bare FROM g WHERE n > {D.FULL}),
p AS (SELECT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.v = b.v AND a.id < b.id WHERE a.n <= {D.FULL} UNION SELECT least(id, o), greatest(id, o) FROM f WHERE id <> o
UNION SELECT a.id, b.id FROM g a JOIN g b ON a.v = b.v AND a.user_part = b.user_part AND a.id < b.id WHERE a.n > {D.FULL}
UNION SELECT a.id, b.id FROM g a JOIN g b ON a.v = b.v AND a.domain = b.domain AND a.id < b.id WHERE a.n > {D.FULL} AND len(list_intersect(a.grams, b.grams)) >= {D.NEAR} * (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) - 1e-9)"""


@query("crowded_candidate_pairs", f"WITH {_CROWD} SELECT id_a, id_b FROM p", "crowded_contacts")
def _(t):
    return D.dup_candidate_pairs(D.norm_keys(t.crowded_contacts.select("id", "first_name", "last_name", "email")), keys=("name_key",))


def _pairs(t):
    c = t.companies
    side = lambda s: c.select(F.col("id").alias(f"id_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in ("name", "email", "phone", "website")])
    return D.dup_candidate_pairs(D.norm_keys(c)).join(side("a"), "id_a").join(side("b"), "id_b")


_TABLE = f"{_PAIRS}, j AS (SELECT p.*, a.name na, b.name nb, a.email ea, b.email eb, a.phone pa, b.phone pb, a.website wa, b.website wb FROM p JOIN companies a ON a.id = id_a JOIN companies b ON b.id = id_b)"
_STRING = f"CASE WHEN coalesce({{a}}, '') = '' OR coalesce({{b}}, '') = '' THEN 0.0 ELSE {_ratio(_name('{a}'), _name('{b}'))} END"


def _string(a: str, b: str) -> str:
    return _STRING.replace("{a}", a).replace("{b}", b)


def _none(a: str, b: str, rest: str) -> str:
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 {rest} END"


_X, _Y = "lower(trim(ea))", "lower(trim(eb))"
_EMAIL = _none("ea", "eb", f"WHEN {_X} = {_Y} THEN 1.0 WHEN contains({_X}, '@') AND contains({_Y}, '@') AND string_split({_X}, '@')[2] = string_split({_Y}, '@')[2] THEN 0.5 + 0.5 * ({_string(f'string_split({_X}, chr(64))[1]', f'string_split({_Y}, chr(64))[1]')}) ELSE {_string(_X, _Y)}")
_PHONES = _none("pa", "pb", f"WHEN {_phone('pa')} = {_phone('pb')} THEN 1.0 WHEN contains({_phone('pa')}, {_phone('pb')}) OR contains({_phone('pb')}, {_phone('pa')}) THEN 0.8 ELSE {_string('(' + _phone('pa') + ')', '(' + _phone('pb') + ')')}")
_URLS = _none("wa", "wb", f"WHEN {_url('wa')} = {_url('wb')} THEN 1.0 WHEN {HOST.format('wa')} = {HOST.format('wb')} THEN 0.9 ELSE {_string(_url('wa'), _url('wb'))}")
_NAMES = _string("na", "nb")

for _key, _op, _sql, _field in (("string_similarity", D.string_similarity, _NAMES, "name"), ("email_similarity", D.email_similarity, _EMAIL, "email"), ("phone_similarity", D.phone_similarity, _PHONES, "phone"), ("url_similarity", D.url_similarity, _URLS, "website")):

    @query(_key, f"WITH {_TABLE} SELECT id_a, id_b, round(CAST({_sql} AS DOUBLE), 6) AS similarity FROM j", "companies")
    def _(t, op=_op, field=_field):
        return op(_pairs(t), f"{field}_a", f"{field}_b", "levenshtein").select("id_a", "id_b", "similarity")


_LISTS = ", ".join(
    f"concat_ws(',', {', '.join(f'CASE WHEN {test.format(column, least)} THEN {name!r} END' for name, column, least in (('name', 'n', 0.85), ('domain', 'd', 0.9), ('email', 'e', 0.8), ('phone', 'f', 0.8)))}) AS {title}"
    for title, test in (("matching_fields", "{0} >= {1}"), ("conflicting_fields", "{0} < 0.3"))
)
_SCORED = f"""{_TABLE}, s AS (SELECT id_a, id_b, CASE WHEN trim(na) <> '' AND trim(nb) <> '' THEN round(CAST({_NAMES} AS DOUBLE), 6) END n, CASE WHEN trim(wa) <> '' AND trim(wb) <> '' THEN round(CAST({_URLS} AS DOUBLE), 6) END d,
  CASE WHEN trim(ea) <> '' AND trim(eb) <> '' THEN round(CAST({_EMAIL} AS DOUBLE), 6) END e, CASE WHEN trim(pa) <> '' AND trim(pb) <> '' THEN round(CAST({_PHONES} AS DOUBLE), 6) END f FROM j),
c AS (SELECT *, round((coalesce(n, 0) + coalesce(d, 0) + coalesce(e, 0) + coalesce(f, 0)) / ((n IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT), 6) AS confidence FROM s),
m AS (SELECT id_a, id_b, confidence, CASE WHEN confidence >= 0.9 OR coalesce(d >= 0.9, false) THEN 'exact' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'no_match' END AS match_type,
  {_LISTS}, n AS s_name, d AS s_domain, e AS s_email, f AS s_phone FROM c)"""


def _shown(matches):
    lists = [F.array_join(c, ",").alias(c) for c in ("matching_fields", "conflicting_fields")]
    fields = [f for f in ("name", "domain", "email", "phone") if f in matches.schema["field_scores"].dataType.names]
    return matches.select("id_a", "id_b", "match_type", "confidence", *lists, *[F.col(f"field_scores.{f}").alias(f"s_{f}") for f in fields])


@query("company_matches", f"WITH {_linked(_SCORED)} SELECT * FROM m", "linked_companies")
def _(t):
    return _shown(D.company_matches(t.linked_companies, metric="levenshtein"))


@query("sure_company_matches", f"WITH {_linked(_SCORED)} SELECT * FROM m WHERE match_type IN ('exact', 'high')", "linked_companies")
def _(t):
    return _shown(D.company_matches(t.linked_companies, metric="levenshtein", least="high"))


_FULL_NAMES = "concat_ws(' ', first_name, last_name)"
_PEOPLE = f"""k AS (SELECT id, nullif({_name(_FULL_NAMES)}, '') AS name_key, nullif({_phone('phone')}, '') AS phone_key, CASE WHEN contains(email, '@') THEN lower(trim(email)) END AS email_key FROM contacts),
l AS (SELECT id, 'e' AS kind, email_key AS v FROM k UNION ALL SELECT id, 'p', phone_key FROM k UNION ALL SELECT id, 't', CASE WHEN length(phone_key) >= 10 THEN right(phone_key, 10) END FROM k UNION ALL SELECT id, 'n', name_key FROM k),
p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM l a JOIN l b ON a.kind = b.kind AND a.v = b.v AND a.id < b.id),
j AS (SELECT p.*, concat_ws(' ', a.first_name, a.last_name) na, concat_ws(' ', b.first_name, b.last_name) nb, a.email ea, b.email eb, a.phone pa, b.phone pb FROM p JOIN contacts a ON a.id = id_a JOIN contacts b ON b.id = id_b),
s AS (SELECT id_a, id_b, CASE WHEN trim(na) <> '' AND trim(nb) <> '' THEN round(CAST({_NAMES} AS DOUBLE), 6) END n, CASE WHEN trim(ea) <> '' AND trim(eb) <> '' THEN round(CAST({_EMAIL} AS DOUBLE), 6) END e,
  CASE WHEN trim(pa) <> '' AND trim(pb) <> '' THEN round(CAST({_PHONES} AS DOUBLE), 6) END f FROM j),
c AS (SELECT *, round((coalesce(n, 0) + coalesce(e, 0) + coalesce(f, 0)) / ((n IS NOT NULL)::INT + (e IS NOT NULL)::INT + (f IS NOT NULL)::INT), 6) AS confidence FROM s)
SELECT id_a, id_b, CASE WHEN confidence >= 0.9 OR coalesce(e >= 0.9, false) THEN 'exact' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'no_match' END AS match_type, confidence,
  concat_ws(',', CASE WHEN n >= 0.85 THEN 'name' END, CASE WHEN e >= 0.9 THEN 'email' END, CASE WHEN f >= 0.8 THEN 'phone' END) AS matching_fields,
  concat_ws(',', CASE WHEN n < 0.3 THEN 'name' END, CASE WHEN e < 0.3 THEN 'email' END, CASE WHEN f < 0.3 THEN 'phone' END) AS conflicting_fields, n AS s_name, e AS s_email, f AS s_phone FROM c"""


@query("contact_matches", f"WITH {_PEOPLE}", "contacts")
def _(t):
    return _shown(D.contact_matches(t.contacts, metric="levenshtein"))


#: Groups by walking the links from every row to all that it reaches.
_GROUPS = _linked(f"""{_SCORED}, e AS (SELECT id_a AS a, id_b AS b FROM m WHERE match_type IN ('exact', 'high') UNION SELECT id_b, id_a FROM m WHERE match_type IN ('exact', 'high')),
w AS (SELECT id, id AS met FROM companies UNION SELECT w.id, e.b FROM w JOIN e ON w.met = e.a), g AS (SELECT id, min(met) AS group_id FROM w GROUP BY id)""")


def _groups(t):
    return D.duplicate_groups(t.linked_companies, D.company_matches(t.linked_companies, metric="levenshtein", least="high"))


@query("duplicate_groups", f"WITH RECURSIVE {_GROUPS} SELECT id, group_id FROM g", "linked_companies")
def _(t):
    return _groups(t)


@query("merge_keep_first", f"WITH RECURSIVE {_GROUPS} SELECT group_id, arg_min(c.name, c.id) AS name, min(c.id) AS id FROM linked_companies c JOIN g USING (id) GROUP BY 1", "linked_companies")
def _(t):
    return D.merge_keep_first(t.linked_companies, _groups(t)).select("group_id", "name", "id")


@query("merge_keep_last", f"WITH RECURSIVE {_GROUPS} SELECT group_id, arg_max(c.name, c.id) AS name, max(c.id) AS id FROM linked_companies c JOIN g USING (id) GROUP BY 1", "linked_companies")
def _(t):
    return D.merge_keep_last(t.linked_companies, _groups(t)).select("group_id", "name", "id")


_FULL = " + ".join(f"CAST(trim(coalesce({f}, '')) <> '' AS INT)" for f in ("name", "website", "email", "phone", "description"))


@query("merge_most_complete", f"WITH RECURSIVE {_GROUPS} SELECT group_id, arg_min(c.id, row(-({_FULL}), c.id)) AS id FROM linked_companies c JOIN g USING (id) GROUP BY 1", "linked_companies")
def _(t):
    return D.merge_most_complete(t.linked_companies, _groups(t)).select("group_id", "id")


@query("merge_highest_confidence", f"WITH RECURSIVE {_GROUPS} SELECT group_id, arg_min(c.id, row(-data_quality_score, c.id)) AS id FROM linked_companies c JOIN g USING (id) GROUP BY 1", "linked_companies")
def _(t):
    return D.merge_highest_confidence(t.linked_companies, _groups(t)).select("group_id", "id")


@query("merge_all", f"""WITH RECURSIVE {_GROUPS} SELECT group_id, arg_min(email, c.id) FILTER (trim(coalesce(email, '')) <> '') AS email, arg_min(phone, c.id) FILTER (trim(coalesce(phone, '')) <> '') AS phone, arg_min(employee_count, c.id) FILTER (employee_count IS NOT NULL) AS employee_count,
coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM unnest(flatten(list(string_split(technologies_csv, ',')) FILTER (technologies_csv IS NOT NULL))) u(x)), '') AS technologies FROM linked_companies c JOIN g USING (id) GROUP BY group_id""", "linked_companies")
def _(t):
    return D.merge_all(t.linked_companies, _groups(t)).select("group_id", "email", "phone", "employee_count", F.array_join("technologies", ",").alias("technologies"))


@query("dedup_report", f"WITH RECURSIVE {_GROUPS}, z AS (SELECT group_id, count(*) n FROM g GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS removed FROM z", "linked_companies")
def _(t):
    return D.dedup_report(t.linked_companies, _groups(t))


@query("exact_duplicates", "SELECT id FROM contacts QUALIFY row_number() OVER (PARTITION BY company_id, department ORDER BY id) > 1", "contacts")
def _(t):
    return D.exact_duplicates(t.contacts, ["company_id", "department"]).select("id")
