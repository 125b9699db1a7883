"""Extraction from a table of fetched pages ``(page_id, url, html[, headers])``.

Tags are read by regular expressions; contact sections, which nest, go through the standard HTML parser in Arrow batches, and
technologies through one automaton of all signatures.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import Patterns
from .cleaning import EMAILS
from .select import host
from .validation import FREEMAIL

#: Fixed values.
PHONE = r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b"
SOCIAL = r"(?i)(?:https?://)?(?:www\.)?(facebook|twitter|linkedin|instagram|youtube)\.com/[A-Za-z0-9._-]+"
RELEVANT = ("contact", "about", "team", "staff", "people", "leadership", "management", "directory", "employees")
CONTACT_SECTION = re.compile(r"contact|team|staff|people|person|employee|member|bio", re.I)
TITLE_WORDS = ("ceo", "cto", "cfo", "president", "director", "manager", "founder", "engineer", "developer", "head of", "vp")
BLOCKED_URL = ("authwall", "challenge", "captcha")
#: Technology: category, body patterns, script patterns, header names.
SIGNATURES = {
    "React": ("frontend", (r"react", r"_react", r"React\."), (r"react\.", r"react-dom"), ("x-powered-by",)),
    "Vue.js": ("frontend", (r"vue\.js", r"vuejs", r"__vue__"), (r"vue\.", r"vue@"), ()),
    "Angular": ("frontend", (r"angular", r"ng-"), (r"angular\.", r"@angular"), ()),
    "jQuery": ("frontend", (r"jquery", r"\$\("), (r"jquery",), ()),
    "Node.js": ("backend", (r"node\.js", r"express"), (), ("x-powered-by",)),
    "Django": ("backend", (r"django", r"csrftoken"), (), ("x-powered-by", "server")),
    "Flask": ("backend", (r"flask",), (), ("x-powered-by", "server")),
    "Ruby on Rails": ("backend", (r"rails", r"ruby"), (), ("x-powered-by",)),
    "PHP": ("backend", (r"php", r"PHPSESSID"), (), ("x-powered-by", "server")),
    "ASP.NET": ("backend", (r"asp\.net", r"__VIEWSTATE"), (), ("x-powered-by", "x-aspnet-version")),
    "WordPress": ("cms", (r"wp-content", r"wordpress", r"wp-includes"), (), ()),
    "Drupal": ("cms", (r"drupal", r"sites/default"), (), ()),
    "Joomla": ("cms", (r"joomla", r"option=com_"), (), ()),
    "Shopify": ("ecommerce", (r"shopify", r"myshopify\.com"), (), ("x-shopify-stage",)),
    "Google Analytics": ("analytics", (r"google-analytics", r"gtag", r"ga\("), (r"googletagmanager", r"google-analytics"), ()),
    "Facebook Pixel": ("analytics", (r"facebook\.com/tr", r"fbq\("), (r"connect\.facebook\.net",), ()),
    "Hotjar": ("analytics", (r"hotjar",), (r"static\.hotjar\.com",), ()),
    "Cloudflare": ("cdn", (r"cloudflare",), (), ("cf-ray", "server")),
    "Amazon CloudFront": ("cdn", (), (), ("x-amz-cf-id", "via")),
    "Netlify": ("hosting", (r"netlify",), (), ("x-nf-request-id",)),
    "Vercel": ("hosting", (r"vercel",), (), ("x-vercel-id",)),
    "Stripe": ("payment", (r"stripe", r"js\.stripe\.com"), (r"js\.stripe\.com",), ()),
    "PayPal": ("payment", (r"paypal", r"paypalobjects"), (r"paypal",), ()),
    "Mailchimp": ("marketing", (r"mailchimp", r"mc\.us"), (), ()),
    "HubSpot": ("marketing", (r"hubspot", r"hs-analytics"), (r"js\.hs-analytics\.net",), ()),
}
META_GENERATOR = ("WordPress", "Drupal", "Joomla", "React")


def _plain(html: Column) -> Column:
    """Text of a fragment: tags out, white space collapsed; null if empty."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def _tag(name: str) -> Column:
    return _plain(F.regexp_extract("html", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1))


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def page_title_desc(pages: DataFrame) -> DataFrame:
    """``(page_id, title, description)``: title or h1; meta description or first paragraph, 200 characters."""
    meta = F.nullif(F.regexp_extract("html", r"""(?is)<meta[^>]+name=["']description["'][^>]*content=["'](.*?)["']""", 1), F.lit(""))
    return pages.select("page_id", F.coalesce(_tag("title"), _tag("h1")).alias("title"), _cut(F.coalesce(meta, _plain(F.regexp_extract("html", r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|</div>|</article>|$)", 1))), 200).alias("description"))


class _Sections(HTMLParser):
    """Texts of elements whose class or id names contacts; nested ones belong to the outermost."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.depth, self.found, self.text = 0, [], []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in self.VOID
        elif tag not in self.VOID and any(k in ("class", "id") and v and CONTACT_SECTION.search(v) for k, v in attrs):
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and tag not in self.VOID:
            self.depth -= 1
            if not self.depth:
                self.found.append(" ".join(" ".join(self.text).split()))
                self.text = []

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def contact_sections(pages: DataFrame, most: int = 20) -> DataFrame:
    """``(page_id, section)``, the first ``most`` of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Sections()
                parser.feed(html or "")
                rows += [(page, i, s) for i, s in enumerate(parser.found[:most]) if s]
            yield pd.DataFrame(rows, columns=["page_id", "nth", "section"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, nth int, section string")


def business(email: Column) -> Column:
    return ~F.lower(F.substring_index(email, "@", -1)).isin(*FREEMAIL)


def page_contacts(pages: DataFrame) -> DataFrame:
    """``(page_id, first_name, last_name, email, phone, job_title)`` from contact sections; a page without any: up to 5 business e-mails."""
    s = F.col("section")
    name = F.regexp_extract(s, r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\b", 1), F.regexp_extract(s, r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\b", 2)
    none = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(*[F.when(F.contains(F.lower(s), F.lit(w)), w) for w in TITLE_WORDS])
    made = contact_sections(pages).select("page_id", none(name[0]).alias("first_name"), none(name[1]).alias("last_name"), none(F.regexp_extract(s, EMAILS, 0)).alias("email"), none(F.regexp_extract(s, PHONE, 0)).alias("phone"), title.alias("job_title"))
    made = made.where(F.coalesce("email", "phone", "first_name").isNotNull())
    bare = pages.join(made.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.explode(F.slice(F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(EMAILS), F.lit(0))), business), 1, 5)).alias("email"))
    return made.unionByName(bare, allowMissingColumns=True)


def page_company_info(pages: DataFrame) -> DataFrame:
    """``(page_id, name, address, description)``: name from the title up to a dash or pipe, under 100 characters; description of 50 to 500."""
    name = F.trim(F.regexp_extract(F.coalesce(_tag("title"), _tag("h1")), r"^(.*?)(?:\s+[-–|].*)?$", 1))
    text = _plain(F.col("html"))
    address = F.nullif(F.regexp_extract(text, r"[0-9]+\s+[A-Za-z0-9 .-]{1,60}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct)\s*,?\s*[A-Za-z ]{1,40},?\s*[A-Z]{2}\s*[0-9]{5}", 0), F.lit(""))
    first = F.coalesce(*[F.get(F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|</article>|$)"), F.lit(1)), lambda p: _plain(p)), lambda p: F.length(p).between(50, 500)), F.lit(0))])
    return pages.select("page_id", F.when(F.length(name) < 100, F.nullif(name, F.lit(""))).alias("name"), address.alias("address"), first.alias("description"))


def page_social_links(pages: DataFrame) -> DataFrame:
    """``(page_id, platform, url)``, the last link of a platform."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SOCIAL), F.lit(0))).alias("at", "url"))
    return links.groupBy("page_id", F.lower(F.regexp_extract("url", SOCIAL, 1)).alias("platform")).agg(F.max_by("url", "at").alias("url"))


def relevant_links(pages: DataFrame, most: int = 10) -> DataFrame:
    """``(page_id, link)``: same-host or relative links with a contact or about word, distinct, the first ``most`` by page order."""
    own = host("url")
    href = pages.select("page_id", own.alias("own"), F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)"""), F.lit(1))).alias("at", "link"))
    same = ~F.col("link").rlike("^[a-z]+:") | (host("link") == F.col("own"))
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("link"), F.lit(w)) for w in RELEVANT])
    first = href.where(same & hit).groupBy("page_id", "link").agg(F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("n") <= most).select("page_id", "link")


def site_company_rollup(pages: DataFrame, infos: DataFrame, contacts: DataFrame) -> DataFrame:
    """One company per host: of each field the value of the latest page that has one, the phone of its first contact page."""
    rows = pages.select("page_id", "url", host("url").alias("domain")).where("domain is not null").join(infos, "page_id", "left")
    rows = rows.join(contacts.where("phone is not null").groupBy("page_id").agg(F.min("phone").alias("phone")), "page_id", "left")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_id"))).alias(c)
    return rows.groupBy("domain").agg(last("name"), F.min_by("phone", F.when(F.col("phone").isNotNull(), F.col("page_id"))).alias("phone"), last("address"), last("description"), F.min_by("url", "page_id").alias("source_url"))


#: Script tags (attributes, text), meta tags, and the value of an attribute.
SCRIPTS = re.compile(r"<script\b([^>]*)>(.*?)(?=</script|\Z)", re.I | re.S)
METAS = re.compile(r"<meta\b([^>]*)>", re.I)


def _attribute(tag: str, name: str) -> str | None:
    """Value of an attribute in the text of a tag; empty if it has none, null if the attribute is not there."""
    hit = re.search(rf"""(?<![\w-]){name}(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", tag, re.I)
    return hit and next((g for g in hit.groups() if g is not None), "")


def header_map(headers: str | None) -> dict[str, str]:
    """Headers by lower-case name, from a JSON object or from lines ``name: value``; of a name that comes again the last value."""
    if not headers:
        return {}
    if headers.lstrip().startswith("{"):
        try:
            return {k.lower(): str(v) for k, v in json.loads(headers).items() if v is not None}
        except ValueError:
            return {}
    lines = (line.partition(":") for line in headers.splitlines())
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


class Technologies:
    """The signatures as postings: which technologies a pattern speaks for, and with what rank among their patterns."""

    def __init__(self, signatures: dict, generators: tuple[str, ...]):
        self.category = {name: s[0] for name, s in signatures.items()}
        self.body = Patterns(p for s in signatures.values() for p in s[1])
        self.script = Patterns(p for s in signatures.values() for p in s[2])
        self.of_body, self.of_script, self.of_header = {}, {}, {}
        for name, (_, body, script, header) in signatures.items():
            for k, p in enumerate(body):
                self.of_body.setdefault(p, []).append((k, name))
            for p in script:
                self.of_script.setdefault(p, []).append(name)
            for h in header:
                self.of_header.setdefault(h.lower(), set()).add(name)
        self.generators = set(generators)

    def _named(self, text: str) -> set[str]:
        return {name for p in self.body.counts(text) for _, name in self.of_body[p]}

    def found(self, html: str, headers: dict[str, str]) -> dict[str, tuple[float, str]]:
        """Confidence and method per technology: the best method, the first of header, content, script and meta_tag on a tie."""
        out: dict[str, tuple[float, str]] = {}

        def put(name: str, confidence: float, method: str) -> None:
            if name not in out or confidence > out[name][0]:
                out[name] = (confidence, method)

        for header in headers.keys() & self.of_header.keys():
            for name in self._named(headers[header]) & self.of_header[header]:
                put(name, 0.8, "header")
        first: dict[str, tuple[int, int]] = {}
        for p, n in self.body.counts(html).items():
            for rank, name in self.of_body[p]:
                first[name] = min(first.get(name, (rank, n)), (rank, n))
        for name, (_, n) in first.items():
            put(name, round(min(0.7 + n * 0.1, 0.9), 4), "content")
        sources, inline = [], []
        for tag, text in SCRIPTS.findall(html):
            source = _attribute(tag, "src")
            (inline if source is None else sources).append(text if source is None else source)
        for p in self.script.counts(" ".join(sources) + " " + " ".join(inline)):
            for name in self.of_script[p]:
                put(name, 0.85, "script")
        for tag in METAS.findall(html):
            if (_attribute(tag, "name") or "").lower() == "generator":
                for name in self._named(_attribute(tag, "content") or "") & self.generators:
                    put(name, 0.9, "meta_tag")
        return out


def detect_technologies(pages: DataFrame, signatures: dict = SIGNATURES, generators: tuple[str, ...] = META_GENERATOR) -> DataFrame:
    """``(page_id, technology, category, confidence, method)`` of ``pages(page_id, html[, headers])``, the best method per technology.

    A technology's body patterns in the value of one of its headers give 0.8 (``headers``: a map, a JSON object or lines; names
    without regard to case), the first of them that occurs in the page min(.7 + .1 per match, .9), its script patterns in
    the sources or texts of scripts 0.85, and, for ``generators``, its body patterns in a generator tag 0.9. On a tie the first
    of these in this order stands. All patterns are looked for in one pass over a text, so the cost does not grow with their
    number. Null pages give nothing, repeated rows give theirs each, other columns do not matter.
    """
    index = Technologies(signatures, generators)
    kind = dict(pages.dtypes).get("headers")
    headers = F.lit(None).cast("string") if kind is None else F.to_json("headers") if kind.startswith("map") else F.col("headers").cast("string")
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"), headers.alias("headers"))
    key = rows.schema["page_id"].dataType.simpleString()
    names = ["technology", "category", "confidence", "method"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for k, (html, head) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for name, (confidence, method) in index.found(html or "", header_map(head)).items():
                    at.append(k)
                    cells.append((name, index.category[name], confidence, method))
            columns = list(zip(*cells, strict=True)) or [()] * 4
            made = [pa.array(c, pa.float64() if n == "confidence" else pa.string()) for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], ["page_id", *names])

    return rows.mapInArrow(run, f"page_id {key}, technology string, category string, confidence double, method string")


def technology_rollup(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``(domain, technologies, confidence)``: distinct technologies and mean confidence per host."""
    rows = found.join(pages.select("page_id", host("url").alias("domain")), "page_id").where("domain is not null")
    return rows.groupBy("domain").agg(F.array_sort(F.collect_set("technology")).alias("technologies"), F.round(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("confidence"))


def search_snippet_extract(results: DataFrame) -> DataFrame:
    """``results(id, title, url, snippet)`` with phone digits, e-mail, company (title up to a dash or pipe) and host."""
    s = F.coalesce("snippet", F.lit(""))
    part = lambda k: F.regexp_extract(s, PHONE, k)
    none = lambda c: F.nullif(c, F.lit(""))
    return results.withColumns({"phone": none(F.concat(part(1), part(2), part(3))), "email": none(F.regexp_extract(s, EMAILS, 0)), "company": none(F.trim(F.regexp_extract(F.coalesce("title", F.lit("")), r"^(.*?)(?:\s+[-–|].*)?$", 1))), "domain": host("url")})


def merge_by_domain(companies: DataFrame, domain: str = "domain", key: str = "id") -> DataFrame:
    """The first company per non-empty domain, and all without one."""
    d = F.nullif(F.lower(F.trim(domain)), F.lit(""))
    rows = companies.withColumn("__d", d)
    first = rows.where("__d is not null").withColumn("__n", F.row_number().over(Window.partitionBy("__d").orderBy(key))).where("__n = 1").drop("__n")
    return first.unionByName(rows.where("__d is null")).drop("__d")


def blocked_page_flag(pages: DataFrame) -> DataFrame:
    url, html = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("html", F.lit("")))
    has = lambda c, w: F.contains(c, F.lit(w))
    hit = reduce(lambda a, b: a | b, [has(url, w) for w in BLOCKED_URL]) | has(html, "blocked") | has(html, "unusual activity") | (has(html, "verify") & has(html, "human"))
    return pages.withColumn("blocked", hit)
