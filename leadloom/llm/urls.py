"""URL filters: host and path rules, and association rules mined from labelled URLs.

FP-growth finds token combinations that are frequent among bad URLs; those that are also sure enough among all labelled ones,
and have no part that is at least as sure, become rules. Rules are matched through an inverted index: each is posted under the
rarest of its tokens, and a URL that holds this token is tested for the others. Native: DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Verdict and rule: host, then path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: At most so many host and path rules are given as a list, as each is an expression of the plan; more are an error.
MAX_RULES = 1000
#: A rule holds for this many bad URLs at least, however many there are. With a quarter of all URLs bad, as in the test tables, a
#: combination that means nothing reaches 14 of 20 once in 100,000 times.
MIN_COUNT = 20
#: Besides, a share of the bad URLs.
MIN_SUPPORT = 0.0
MIN_CONFIDENCE = 0.7
#: Tokens of a rule at most; longer ones would tell single pages apart rather than kinds of pages.
MAX_TOKENS = 3
#: FP-growth lists every subset of what is frequent together, up to 2 ** WIDE of one URL; wider URLs are counted level by level.
WIDE = 12
#: An index of up to this many postings is broadcast; a larger one is joined by shuffle.
BROADCAST_POSTINGS = 50_000
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: str) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)([^?#]*)", 1), A_Z, a_z)


def path_of(url: str) -> Column:
    return F.regexp_extract(_after(url), r"^([^/?#]*)([^?#]*)", 2)


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null. Equally long rules: the last by text, block before allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules in a list")
    found = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = rule[len(h) :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size int, rule string, verdict string>")


def tokens(url: str) -> Column:
    """Distinct tokens: host labels with their place from the right, path words, query keys; digits collapsed, A-Z lower-cased."""
    rest = F.regexp_replace(F.translate(_after(url), A_Z, a_z), r"[0-9]+", "0")
    host = F.reverse(F.split(F.regexp_extract(rest, r"^[^/?#]*", 0), r"\."))
    labels = F.transform(host, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"[/._-]+"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.filter(F.concat(labels, words, keys), lambda x: ~x.endswith(":")))


def contained(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns of ``rows(tokens, ...)`` but the tokens, and ``rule_id``, for each rule of ``rules(rule_id, rule, post)`` whose tokens a row holds."""
    index = rules.select("rule_id", "rule", F.col("post").alias("token"))
    if index.count() <= BROADCAST_POSTINGS:
        index = F.broadcast(index)
    hits = rows.withColumn("token", F.explode("tokens")).join(index, "token")
    return hits.where(F.size(F.array_except("rule", "tokens")) == 0).drop("token", "tokens", "rule")


def posted(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``sets(rule_id, rule)`` with ``post``, the token of each that fewest of ``rows(tokens)`` hold."""
    used = sets.select(F.explode("rule").alias("token")).distinct()
    counts = saved(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(used, "token"), "url-tokens")
    rarest = sets.select("rule_id", F.explode("rule").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("post"))
    return saved(sets.join(rarest, "rule_id"), "url-posted")


def _frequent(rows: DataFrame, need: int) -> DataFrame:
    """``(token, support, n, class)`` of the tokens in ``need`` bad rows or more; tokens that stand in the same labelled rows are one class.

    A class is named by its smallest token. Rows are told apart by two sums of hashes and a count.
    """
    at = rows.select("rid", "bad", F.explode("tokens").alias("token"))
    mark = lambda seed: F.sum(F.xxhash64("rid", F.lit(seed)).cast("decimal(38,0)")).alias(f"m{seed}")
    known = at.groupBy("token").agg(F.count_if("bad").alias("support"), F.count("*").alias("n"), mark(1), mark(2)).where(F.col("support") >= need)
    known = saved(known, "url-frequent")
    first = known.groupBy("n", "m1", "m2").agg(F.min("token").alias("class"))
    return saved(known.join(first, ["n", "m1", "m2"]).select("token", "support", "n", "class"), "url-classes")


def combinations_by_fp_growth(bad: DataFrame, need: int, most: int) -> DataFrame:
    """``(items, freq)`` with 2 to ``most`` items in ``need`` rows of ``bad(items)`` or more."""
    n = bad.count()
    if n < need:
        return bad.select("items", F.lit(0).cast("long").alias("freq")).limit(0)
    found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n).fit(bad).freqItemsets
    return found.where((F.col("freq") >= need) & F.size("items").between(2, most)).select(F.array_sort("items").alias("items"), "freq")


def combinations_by_level(bad: DataFrame, need: int, most: int) -> DataFrame:
    """The same, counted level by level: a set is extended in the rows that hold it, if it is frequent itself."""
    rows = bad.select(F.array_sort("items").alias("items"))
    level, out = rows.select("items", F.explode(F.transform("items", lambda x: F.array(x))).alias("set")), []
    for _ in range(most - 1):
        longer = level.select("items", "set", F.explode(F.filter("items", lambda x: x > F.element_at("set", -1))).alias("x"))
        level = saved(longer.select("items", F.concat("set", F.array("x")).alias("set")), "url-level")
        counts = saved(level.groupBy("set").agg(F.count("*").alias("freq")).where(F.col("freq") >= need), "url-counts")
        out.append(counts.select(F.col("set").alias("items"), "freq"))
        level = level.join(counts.select("set"), "set").select("items", "set")
    return reduce(DataFrame.union, out)


def mined_rules(
    labelled: DataFrame, url: str = "url", bad: str = "bad", min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, wide: int = WIDE
) -> DataFrame:
    """``(rule_id, tokens, post, size, confidence, support)`` mined from ``labelled(url, bad)``; support counts bad URLs.

    A rule is dropped if some of its tokens alone make a rule at least as confident. So tokens that stand in bad URLs only are
    rules by themselves and in no other, and of tokens that always stand together (as all do of a URL that comes many times) a
    rule has one: combinations are mined among classes of such tokens, and then made for each of their members. FP-growth lists
    sets of any size; where a bad URL has more than ``wide`` classes left, sets of up to ``max_tokens`` are counted level by level
    in its place, which gives the same sets. Rows with a null label are left out; repeated rows count each. No bad rows: no rules.
    """
    rows = labelled.where(F.col(bad).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), tokens(url).alias("tokens"), F.col(bad).alias("bad"))
    rows = saved(rows.where(F.size("tokens") > 0), "url-items")
    need = max(min_count, -(-rows.where("bad").count() * min_support // 1), 1)
    known = _frequent(rows, int(need))
    unsure = known.where((F.col("support") < F.col("n")) & (F.col("token") == F.col("class"))).select("token")
    left = rows.select("rid", "bad", F.explode("tokens").alias("token")).join(unsure, "token").groupBy("rid", "bad").agg(F.array_sort(F.collect_list("token")).alias("items"))
    left = saved(left, "url-left")
    some = left.where("bad").select("items")
    widest = some.agg(F.max(F.size("items"))).first()[0] or 0
    mine = combinations_by_fp_growth if widest <= wide else combinations_by_level
    singles = known.where("token = class").select(F.array("token").alias("rule"), "support", "n")
    sets = saved(mine(some, int(need), max_tokens).select(F.col("items").alias("rule"), F.col("freq").alias("support")).withColumn("rule_id", F.xxhash64("rule")), "url-sets")
    total = contained(posted(sets, left.select(F.col("items").alias("tokens"))), left.select(F.col("items").alias("tokens"))).groupBy("rule_id").agg(F.count("*").alias("n"))
    every = singles.unionByName(sets.join(total, "rule_id").select("rule", "support", "n"))
    sure = every.withColumn("confidence", F.round(F.col("support") / F.col("n"), 9)).where(F.col("confidence") >= min_confidence)
    rules = saved(sure.select(F.xxhash64("rule").alias("rule_id"), "rule", F.size("rule").alias("size"), "confidence", "support"), "url-rules")
    # The proper parts of a rule, as many as its size allows, each found by its hash.
    masks = F.expr("sequence(1, cast(shiftleft(1, size) - 2 as int))")
    parts = rules.where("size > 1").select("rule_id", "confidence", "rule", F.explode(masks).alias("mask"))
    parts = parts.select("rule_id", "confidence", F.xxhash64(F.expr("filter(rule, (t, i) -> (shiftright(mask, i) & 1) = 1)")).alias("by"))
    less = rules.select(F.col("rule_id").alias("by"), F.col("confidence").alias("by_confidence"))
    kept = rules.join(parts.join(less, "by").where("by_confidence >= confidence").select("rule_id").distinct(), "rule_id", "left_anti")
    members = known.select(F.col("class"), F.col("token").alias("member"))
    for k in range(max_tokens):  # every member in place of its class
        at = kept.where(F.col("size") > k).join(members, F.col("class") == F.get("rule", F.lit(k)))
        at = at.withColumn("rule", F.transform("rule", lambda t, i: F.when(i == k, F.col("member")).otherwise(t))).drop("class", "member")
        kept = saved(at.unionByName(kept.where(F.col("size") <= k)), "url-members")
    out = kept.withColumn("rule", F.array_sort("rule")).withColumn("rule_id", F.xxhash64("rule"))
    out = out.join(posted(out.select("rule_id", "rule"), rows).select("rule_id", "post"), "rule_id")
    return out.select("rule_id", F.col("rule").alias("tokens"), "post", "size", "confidence", "support")


def matched(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``(url, n_rules, confidence)`` for each distinct url that some rule fits: all tokens of the rule are among the url's."""
    words = pages.select(url).where(F.col(url).isNotNull()).distinct().select(url, tokens(url).alias("tokens"))
    hits = contained(rules.select("rule_id", F.col("tokens").alias("rule"), "post"), words)
    sure = rules.select("rule_id", "confidence")
    return hits.join(sure, "rule_id").groupBy(url).agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, n_rules, confidence``.

    The verdict is the longest listed rule's; without one it is block where a mined rule fits, else allow. Null urls, and
    those without ``://``, have empty host and path and no tokens. Repeated urls get equal verdicts. Columns that clash with
    the new ones are replaced.
    """
    new = ("host", "path", "rule", "verdict", "n_rules", "confidence")
    pages = pages.select([c for c in pages.columns if c not in new])
    found = saved(matched(pages, saved(mined_rules(labelled), "url-kept")), "url-matched").withColumnRenamed(url, "__url")
    rows = pages.join(found, F.col(url) == F.col("__url"), "left").withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("__rule", listed(F.col("host"), F.col("path")))
    own = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), own)}).drop("__url", "__rule")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    return judged(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "n_rules", "confidence")


def _sql() -> str:
    """Every combination of up to three tokens is counted, which FP-growth need not do."""
    given = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
e AS (SELECT *, regexp_replace(translate(r, '{A_Z}', '{a_z}'), '[0-9]+', '0', 'g') AS x FROM d),
f AS (SELECT *, list_transform(list_reverse(string_split(regexp_extract(x, '^[^/?#]*'), '.')), lambda t, i: 'h' || (i - 1) || ':' || t) AS hs,
  list_transform(regexp_split_to_array(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '[/._-]+'), lambda t: 'p:' || t) AS ps, list_transform(string_split(regexp_extract(x, '\\?([^#]*)', 1), '&'), lambda t: 'q:' || split_part(t, '=', 1)) AS qs FROM e),
t AS (SELECT DISTINCT rid, token FROM (SELECT rid, unnest(list_concat(hs, ps, qs)) AS token FROM f) WHERE NOT ends_with(token, ':')),
l AS (SELECT rid, quality = 0 OR toxic = 1 AS bad FROM d JOIN labels ON doc_id = page_id),
one AS (SELECT rid, [token] AS s FROM t), two AS (SELECT a.rid, list_append(s, b.token) AS s FROM one a JOIN t b ON a.rid = b.rid AND s[1] < b.token), three AS (SELECT a.rid, list_append(s, b.token) AS s FROM two a JOIN t b ON a.rid = b.rid AND s[2] < b.token),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
c AS (SELECT s, round(CAST(count(*) FILTER (bad) AS DOUBLE) / count(*), 9) AS confidence FROM every JOIN l USING (rid) WHERE bad IS NOT NULL GROUP BY s HAVING count(*) FILTER (bad) >= {MIN_COUNT}),
k AS (SELECT * FROM c WHERE confidence >= {MIN_CONFIDENCE}),
rules AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE len(o.s) < len(k.s) AND list_has_all(k.s, o.s) AND o.confidence >= k.confidence)),
m AS (SELECT rid, count(*) AS n_rules, max(confidence) AS confidence FROM every JOIN rules USING (s) GROUP BY rid),
h AS (SELECT rid, page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), '{A_Z}', '{a_z}') AS host, regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM d),
g AS (SELECT rid, arg_max(row(rule, verdict), row(length(rule), rule, verdict)) AS hit FROM h, (VALUES {given}) v(verdict, rule, own, start) WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY rid)
SELECT page_id, host, path, hit[1] AS rule, coalesce(hit[2], CASE WHEN n_rules > 0 THEN 'block' ELSE 'allow' END) AS verdict, n_rules, confidence FROM h LEFT JOIN g USING (rid) LEFT JOIN m USING (rid)
"""


ORACLE_9 = _sql()
