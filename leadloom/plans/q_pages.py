"""Queries: extraction from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import pages as P
from ..operators import validation as V
from .q_select import HOST
from .registry import query


def _plain(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


_TITLE = f"coalesce({_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")})"


@query("page_title_desc", f"SELECT page_id, {_TITLE} AS title FROM pages")
def _(t):
    return P.page_title_desc(t.pages).select("page_id", "title")


_META = """nullif(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]*content=["''](.*?)["'']', 1), '')"""
_FIRST = _plain("regexp_extract(html, '(?is)<p(?:\\s[^>]*)?>(.*?)(?:</p>|<p[\\s>]|</div>|</article>|$)', 1)")


@query("page_descriptions", f"SELECT page_id, {_TITLE} AS title, CASE WHEN length(d) > 200 THEN left(d, 200) || '...' ELSE d END AS description FROM (SELECT *, coalesce({_META}, {_FIRST}) AS d FROM pages)")
def _(t):
    return P.page_title_desc(t.pages)


def _with_contacts(t):
    """Pages with a contact section put in, as the base pages have none."""
    c = F.col("page_id").cast("string")
    block = F.concat(F.lit('<div class="team-member"><b>Mary Lee</b> <br> CEO '), F.lit("mary"), c, F.lit("@corp.com</div>"))
    return t.pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", block)).otherwise(F.concat("html", F.lit("<p>info"), c, F.lit("@acme.com x@gmail.com</p>"))))


_MAILS = f"list_filter(list_distinct(regexp_extract_all(html || '<p>info' || page_id || '@acme.com x@gmail.com</p>', '{C.EMAILS}')), lambda x: string_split(lower(x), '@')[-1] NOT IN ({', '.join(repr(d) for d in V.FREEMAIL)}))"


@query("page_contacts", f"SELECT page_id, 'Mary' AS first_name, 'Lee' AS last_name, concat('mary', page_id, '@corp.com') AS email, 'ceo' AS job_title FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, NULL, NULL, unnest({_MAILS}), NULL FROM pages WHERE page_id % 2 = 1")
def _(t):
    return P.page_contacts(_with_contacts(t)).select("page_id", "first_name", "last_name", "email", "job_title")


@query("page_company_info", f"WITH n AS (SELECT page_id, trim(regexp_extract({_TITLE}, '^(.*?)(?:\\s+[-–|].*)?$', 1)) AS n FROM pages) SELECT page_id, CASE WHEN length(n) < 100 THEN nullif(n, '') END AS name FROM n")
def _(t):
    return P.page_company_info(t.pages).select("page_id", "name")


def _linked(t):
    c = F.col("page_id").cast("string")
    return t.pages.withColumn("html", F.concat("html", F.lit('<a href="https://twitter.com/a'), c, F.lit('">t</a><a href="https://www.linkedin.com/b"></a><a href="http://Twitter.com/z'), c, F.lit('"></a><a href="/about-us">a</a><a href="https://other.com/contact">o</a>')))


@query("page_social_links", "SELECT page_id, 'twitter' AS platform, concat('http://Twitter.com/z', page_id) AS url FROM pages UNION ALL SELECT page_id, 'linkedin', 'https://www.linkedin.com/b' FROM pages")
def _(t):
    return P.page_social_links(_linked(t))


_WORDS = " OR ".join(f"contains(lower(link), '{w}')" for w in P.RELEVANT)


_HTML = """html || '<a href="/about-us">a</a>'"""
_HREF = f"regexp_extract_all({_HTML}, '(?i)<a[^>]+href=[\"'']([^\"''#]+)', 1)"


@query("relevant_links", f"""WITH l AS (SELECT page_id, url, unnest({_HREF}) AS link, unnest(range(len({_HREF}))) AS pos FROM pages),
f AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE (NOT regexp_matches(link, '^[a-z]+:') OR {HOST.format('link')} = {HOST.format('url')}) AND ({_WORDS}) GROUP BY 1, 2) SELECT page_id, link FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 10""")
def _(t):
    return P.relevant_links(_linked(t))


def _planted(t):
    """Pages of known content, by page_id: a title on two of three, an address on every other, a description on three of four, a contact's phone on every fifth."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    when = lambda test, *parts: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    body = F.concat(
        when(k % 3 != 0, "<title>Shop ", n, " Inc! | Home</title>"), when(k % 2 == 0, "<div>", (k % 90 + 10).cast("string"), " Main Street, Hartford, CT 06101</div>"),
        when(k % 4 != 0, "<p>We have sold boats and oars to people of this town for ", n, " years, and repair them.</p>"), when(k % 5 == 0, '<div class="team-member"><b>Mary Lee</b> 212-555-', F.lpad((k % 9000 + 1000).cast("string"), 4, "0"), "</div>"),
    )
    return t.pages.withColumn("html", body)


@query("site_company_rollup", f"""WITH p AS (SELECT page_id, url, {HOST.format('url')} AS domain, CASE WHEN page_id % 3 <> 0 THEN 'Shop ' || page_id || ' Inc!' END AS name, CASE WHEN page_id % 2 = 0 THEN (page_id % 90 + 10) || ' Main Street, Hartford, CT 06101' END AS address,
CASE WHEN page_id % 4 <> 0 THEN 'We have sold boats and oars to people of this town for ' || page_id || ' years, and repair them.' END AS description, CASE WHEN page_id % 5 = 0 THEN '212-555-' || lpad(CAST(page_id % 9000 + 1000 AS VARCHAR), 4, '0') END AS phone FROM pages)
SELECT domain, arg_max(name, page_id) FILTER (name IS NOT NULL) AS name, arg_min(phone, page_id) FILTER (phone IS NOT NULL) AS phone, arg_max(address, page_id) FILTER (address IS NOT NULL) AS address,
arg_max(description, page_id) FILTER (description IS NOT NULL) AS description, arg_min(url, page_id) AS source_url FROM p WHERE domain IS NOT NULL GROUP BY 1""")
def _(t):
    pages = _planted(t)
    return P.site_company_rollup(pages, P.page_company_info(pages), P.page_contacts(pages))


#: What follows the pages by page_id % 12, with what the rules give for them: technology, category, confidence, method. Written by hand from the rules.
_SIGNED = (
    ("<script src='/js/jquery.min.js'></script>", None, (("jQuery", "frontend", 0.85, "script"),)),
    ('<meta content="WordPress 6.1" name="Generator"> wp-content wp-content', None, (("WordPress", "cms", 0.9, "content"),)),
    ("uses stripe once", None, (("Stripe", "payment", 0.8, "content"),)),
    ("stripe and Stripe, and STRIPE", None, (("Stripe", "payment", 0.9, "content"),)),
    ("plain", "X-Powered-By: Express\nServer: nginx", (("Node.js", "backend", 0.8, "header"),)),
    ("<script>angular.module(1)</script>", None, (("Angular", "frontend", 0.85, "script"),)),
    ("made with flask", '{"server": "Flask/2.0"}', (("Flask", "backend", 0.8, "header"),)),
    ("flask flask", "server: flask", (("Flask", "backend", 0.9, "content"),)),
    ("<META NAME=generator CONTENT='Drupal 9'>", None, (("Drupal", "cms", 0.9, "meta_tag"),)),
    ("plain", "x-other: django\nvia: 1.1 cloudfront", ()),
    ("<script data-src='jquery.js'>fbq('init')</script>", "server: cloudflare", (("Cloudflare", "cdn", 0.8, "header"), ("Facebook Pixel", "analytics", 0.8, "content"), ("jQuery", "frontend", 0.8, "content"))),
    ("js.stripe.com <script src=https://js.stripe.com/v3></script>", None, (("Stripe", "payment", 0.9, "content"),)),
)


def _signed(t):
    """The pages, each followed by a body of known content and with known headers."""
    k = F.col("page_id") % len(_SIGNED)
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in _SIGNED]), (k + 1).cast("int"))
    return t.pages.select("page_id", "url", F.concat("html", F.lit(" "), pick(0)).alias("html"), pick(1).alias("headers"))


_TECHS = " UNION ALL ".join(f"SELECT page_id, '{n}' AS technology, '{c}' AS category, {x}::DOUBLE AS confidence, '{m}' AS method FROM pages WHERE page_id % {len(_SIGNED)} = {k}" for k, (_, _, found) in enumerate(_SIGNED) for n, c, x, m in found)


@query("detect_technologies", _TECHS)
def _(t):
    return P.detect_technologies(_signed(t))


@query("technology_rollup", f"WITH f AS ({_TECHS}), p AS (SELECT page_id, {HOST.format('url')} AS domain FROM pages) SELECT domain, string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies, round(CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(*), 6) AS confidence FROM f JOIN p USING (page_id) WHERE domain IS NOT NULL GROUP BY 1")
def _(t):
    rows = P.technology_rollup(t.pages, P.detect_technologies(_signed(t)))
    return rows.withColumn("technologies", F.array_join("technologies", ","))


@query("search_snippet_extract", f"SELECT id, name AS company, CASE WHEN id % 2 = 0 THEN concat('a', id, '@b.com') END AS email, concat('212555', lpad(CAST(id % 10000 AS VARCHAR), 4, '0')) AS phone, {HOST.format('website')} AS domain FROM companies", "companies")
def _(t):
    c = F.col("id").cast("string")
    rows = t.companies.select("id", F.concat("name", F.lit(" | Official site")).alias("title"), F.col("website").alias("url"), F.concat(F.lit("Call 212-555-"), F.lpad((F.col("id") % 10000).cast("string"), 4, "0"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" or a"), c, F.lit("@b.com"))).otherwise("")).alias("snippet"))
    return P.search_snippet_extract(rows).select("id", "company", "email", "phone", "domain")


@query("merge_by_domain", f"WITH d AS (SELECT id, {HOST.format('website')} AS domain FROM companies) SELECT id FROM d WHERE domain IS NULL UNION ALL SELECT min(id) FROM d WHERE domain IS NOT NULL GROUP BY domain", "companies")
def _(t):
    from ..operators.select import host

    return P.merge_by_domain(t.companies.withColumn("domain", host("website"))).select("id")


@query("blocked_page_flag", "SELECT page_id, contains(lower(url), 'authwall') OR contains(lower(url), 'challenge') OR contains(lower(url), 'captcha') OR contains(lower(html), 'blocked') OR contains(lower(html), 'unusual activity') OR page_id % 3 = 0 OR (contains(lower(html), 'verify') AND contains(lower(html), 'human')) AS blocked FROM pages")
def _(t):
    rows = t.pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("Please Verify that you are human"))).otherwise(F.col("html")))
    return P.blocked_page_flag(rows).select("page_id", "blocked")
