"""Hand rows for single rules, with values worked out from the rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leadloom.operators import cleaning as C
from leadloom.operators import dedup as D
from leadloom.operators import estimation as E
from leadloom.operators import pages as P
from leadloom.operators import scoring as S
from leadloom.operators import validation as V


def frame(spark, column, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {column} {kind}")


def test_emails(spark):
    rows = V.validate_emails(frame(spark, "email", ["info@x.com", "a@mailinator.com", "Jo@Gmail.com ", "jo@corp.com", "a b@c.com", "a@@b.com", None, ""]), "email")
    got = [(r.email_check.status, r.email_check.confidence) for r in rows.orderBy("id").collect()]
    assert got == [("role_based", 0.6), ("disposable", 0.0), ("valid", 0.7), ("valid", 0.9)] + [("invalid", 0.0)] * 4


def test_phones(spark):
    rows = V.validate_phones(frame(spark, "phone", ["2125550123", "12125550123", "+442071838750", "++1212", "5550123", "212-CALL-NOW", "8005550123", None]), "phone")
    got = [(r.phone_check.status, r.phone_check.normalized) for r in rows.orderBy("id").collect()]
    assert got[:3] == [("valid", "+12125550123"), ("valid", "+12125550123"), ("uncertain", "+442071838750")]
    assert [g[0] for g in got[3:]] == ["invalid", "invalid", "invalid", "valid", "invalid"]


def test_urls_and_domains(spark):
    got = [r.url_check.is_valid for r in V.validate_urls(frame(spark, "u", ["a.com", "HTTP://x y", "http://1.2.3.4/p?q=1", "localhost", "", None]), "u").orderBy("id").collect()]
    assert got == [True, False, True, True, False, False]
    got = [r.domain_check.metadata.get("tld") for r in V.validate_domains(frame(spark, "d", ["https://www.A.com/x", "nodot", None]), "d").orderBy("id").collect()]
    assert got == ["com", None, None]


def test_clean_text(spark):
    got = [(r.t_clean.value, r.t_clean.confidence) for r in C.clean_text(frame(spark, "t", ["<b>HELLO  wORLD's</b>", "all lower it's", "Ünïcode  x", None, ""]), "t").orderBy("id").collect()]
    assert got[0][0] == "HELLO wORLD's"
    assert got[1] == ("All Lower It'S", 0.9)
    assert got[2][0] == unicodedata.normalize("NFKD", "Ünïcode x")
    assert got[3:] == [("", 0.0), ("", 0.0)]


def test_clean_company_names(spark):
    got = [r.name_clean.value for r in C.clean_company_names(frame(spark, "name", ["The Acme Acme Inc", "ACME LLC.", "a Bee"])).orderBy("id").collect()]
    assert got == ["Acme Inc.", "ACME LLC", "Bee"]


def test_addresses(spark):
    got = [r.a_clean.value for r in C.clean_addresses(frame(spark, "a", ["12 N Main St, West Virginia", "PO Box 5,,", "1 Oak Ave , Hartford, CT"]), "a").orderBy("id").collect()]
    assert got == ["12 North Main Street, West VA", "PO Box 5, ", "1 Oak Avenue, Hartford, Court"]


def test_seniority_order(spark):
    titles = ["Vice President", "Team Lead", "Sr. Engineer", "CEO & Founder", "Intern", None, "SVP Sales", "Senior Engineer"]
    got = [r.s for r in frame(spark, "job_title", titles).select("id", F.expr(S.SENIORITY_SQL).alias("s")).orderBy("id").collect()]
    assert got == ["c_level", "director", "unknown", "c_level", "intern", "unknown", "vp_level", "senior"]


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        S.check_weights({**S.WEIGHTS, "data_quality": 0.21})


def test_size_edges(spark):
    got = [r.size for r in E.size_from_employees(frame(spark, "employee_count", [10, 11, 50, 51, 200, 201, 250, 251, 1000, 1001, None], "int")).orderBy("id").collect()]
    assert got == ["startup", "small", "small", "medium", "medium", "medium", "medium", "large", "large", "enterprise", None]


def test_revenue_edge_goes_to_lower_band(spark):
    got = [r.c for r in frame(spark, "x", [1000000, 1000001, None], "long").select("id", F.expr(E.category_sql("x")).alias("c")).orderBy("id").collect()]
    assert got == ["under_1m", "1m_10m", None]


def test_ratio_is_matching_blocks(spark):
    pairs = spark.createDataFrame([("Globex Corp", "globex corporation"), ("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string")
    got = sorted(r.similarity for r in D.string_similarity(pairs, "a", "b").collect())
    assert got == [0.0, 0.0, 0.75, 1.0]


def test_groups_join_chains_and_leave_medium_alone(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    matches = spark.createDataFrame([(1, 2, "exact"), (2, 3, "high"), (4, 5, "medium")], "id_a long, id_b long, match_type string")
    assert {r.id: r.group_id for r in D.duplicate_groups(ids, matches).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_hot_block_gives_linear_pairs_and_one_group(spark):
    rows = spark.range(200).selectExpr("id", "'Same Name' as name", "cast(null as string) as email", "cast(null as string) as phone", "cast(null as string) as website")
    pairs = D.dup_candidate_pairs(D.norm_keys(rows), full=50)
    assert pairs.count() < 400
    groups = D.duplicate_groups(rows, D.company_matches(rows, pairs=pairs))
    assert groups.select("group_id").distinct().count() == 1


def test_blocked_pairs_are_some_of_all_pairs(spark):
    rows = spark.createDataFrame([(i, f"n{i // 2}") for i in range(20)], "id long, name string")
    every = {tuple(r) for r in D.dup_candidate_pairs(rows, exhaustive=True).collect()}
    some = {tuple(r) for r in D.dup_candidate_pairs(D.norm_keys(rows)).collect()}
    assert some <= every and len(some) == 10 and len(every) == 190


def test_contact_sections_nest(spark):
    html = '<div class="team"><p>Ann Lee <img src="x"> <b>CEO</b></p> ann@corp.com</div><p>broken <b>markup'
    rows = P.page_contacts(spark.createDataFrame([(1, "http://a.com", html), (2, "http://b.com", "<p>x@gmail.com y@corp.com</p>"), (3, None, None)], "page_id long, url string, html string"))
    got = sorted((r.page_id, r.first_name, r.email, r.job_title) for r in rows.collect())
    assert got == [(1, "Ann", "ann@corp.com", "ceo"), (2, None, "y@corp.com", None)]


# ---- candidate pairs


def people(spark, n, **kinds):
    rows = spark.range(n).withColumns({c: F.expr(e) for c, e in kinds.items()})
    return D.norm_keys(rows)


def test_a_block_gives_all_its_pairs(spark):
    assert D.dup_candidate_pairs(people(spark, 40, name="'Acme Corp'", phone="concat('212555', id + 1000)")).count() == 40 * 39 // 2


def test_large_blocks_keep_pairs_that_share_more(spark):
    """300 rows hold one phone; their e-mails come in pairs, every tenth is a copy of its predecessor, and names differ by a letter or much."""
    kinds = {"name": "concat('Initech ', md5(cast(id - id % 3 as string)), if(id % 3 = 1, 'x', ''))", "phone": "'2125550100'", "email": "concat('m', id div 2, '@corp.com')"}
    rows = people(spark, 300, **kinds)
    got = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, full=50).collect()}
    every = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, exhaustive=True).collect()}
    assert got < every and len(got) < 3000
    assert {(a, a + 1) for a in range(0, 300, 2)} <= got and {(0, b) for b in range(1, 300)} <= got
    near = {(a, b) for a in range(300) for b in range(a + 1, min(300, a - a % 3 + 3)) }
    assert len(near & got) >= 0.95 * len(near)


def test_rows_equal_in_all_keys_stand_for_each_other(spark):
    rows = people(spark, 500, name="if(id < 480, 'Acme', concat('Zeta ', id))", phone="'2125550100'")
    got = D.dup_candidate_pairs(rows, full=50)
    assert got.where("id_a = 0").count() == 499 and got.count() < 1000
    groups = D.components(got.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "t")
    assert groups.select("component").distinct().count() == 1


def three_grams(text):
    return {text[k : k + 3] for k in range(max(1, len(text) - 2))}


def near_by_hand(rows, near=0.6):
    """Pairs of ids whose e-mails have one domain and near first parts."""
    by_domain, out = {}, set()
    for i, mail in rows:
        user, domain = mail.split("@")
        by_domain.setdefault(domain, []).append((i, three_grams(user)))
    for some in by_domain.values():
        for k, (a, x) in enumerate(some):
            out |= {(min(a, b), max(a, b)) for b, y in some[:k] if len(x & y) >= near * len(x | y) - 1e-12}
    return out


@pytest.mark.parametrize("n", [900, 1100, 20000])
def test_one_name_held_by_many_rows_loses_no_near_email(spark, n):
    kinds = {"name": "'John Smith'", "email": "concat(substr(md5(cast(id div 3 as string)), 1, 12), id % 3, '@d', (id div 3) % 40, '.com')", "phone": "cast(null as string)"}
    rows = people(spark, n, **kinds)
    want = near_by_hand([(r.id, r.email_key) for r in rows.select("id", "email_key").collect()])
    assert len(want) > n / 2
    got = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows).collect()}
    assert want <= got
    if n <= D.FULL:
        assert len(got) == n * (n - 1) // 2
    else:  # nothing else but links to the first row: linear in rows and pairs
        assert got - want <= {(0, b) for b in range(1, n)}


def test_bounds_lose_no_match_and_leave_most_out(spark, capsys):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    pick = lambda some: rng.choice(some)
    rows = [(k, pick([word(8), "Acme Corp", "Acme Corps", "acme", "", None]), pick([None, "https://h%d.com/a" % (k % 9), "h1.com"]), pick([None, word(4).replace(" ", "") + "@a.com", "info@a.com"]), pick([None, "2125550%03d" % rng.randrange(1000), "12125550100", "5550100"])) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, website string, email string, phone string")
    every = D.dup_candidate_pairs(df, exhaustive=True)
    for metric in ("ratio", "levenshtein"):
        for matches in (D.company_matches, lambda d, **k: D.contact_matches(d.withColumnsRenamed({"name": "first_name"}).withColumn("last_name", F.lit(None).cast("string")), **k)):
            full = matches(df, metric=metric, pairs=every).collect()
            for least, kinds in (("high", {"exact", "high"}), ("low", {"exact", "high", "medium", "low"})):
                assert sorted(map(repr, matches(df, metric=metric, pairs=every, least=least).collect())) == sorted(repr(r) for r in full if r.match_type in kinds)
    met = every.join(df.toDF("id_a", "name_a", "site_a", "email_a", "phone_a"), "id_a").join(df.toDF("id_b", "name_b", "site_b", "email_b", "phone_b"), "id_b")
    fields = {"name": ("name", D.string_score), "domain": ("site", D.url_score), "email": ("email", D.email_score), "phone": ("phone", D.phone_score)}
    share = D._possible(met, fields, D.COMPANY_THRESHOLDS, "domain", "high").count() / met.count()
    print(f"pairs left to compare block by block: {share:.2f}")
    assert share < 0.5


def test_set_join_equals_brute_force(spark):
    rng = random.Random(2)
    sets = {(g, v): sorted(set(rng.choices("abcdefghijklmnop" if rng.random() < 0.7 else "xyz", k=rng.randrange(1, 12)))) for g in range(3) for v in range(120)}
    frame = spark.createDataFrame([(g, v, s) for (g, v), s in sets.items()] + [(None, 1, ["a"]), (0, None, ["a"]), (0, 900, []), (0, 901, None)], "group long, value long, grams array<string>")
    for t in (0.5, 0.6, 0.8, 1.0):
        want = sorted((g, a, b) for (g, a), x in sets.items() for (h, b), y in sets.items() if g == h and a < b and len(set(x) & set(y)) >= t * len(set(x) | set(y)) - 1e-12)
        assert sorted(map(tuple, D.near_sets(frame, t).collect())) == want
    assert D.near_sets(frame.limit(0)).count() == 0


def test_near_values_held_by_many_are_met_through_the_first(spark):
    """One phone; 60 rows of each of two near names, told apart by their hosts, and 40 other names."""
    rows = people(spark, 160, name="case when id < 60 then 'Acme Trading' when id < 120 then 'Acme Tradings' else md5(cast(id as string)) end", phone="'2125550100'", website="concat('https://h', id, '.com')")
    got = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, full=50).collect()}
    assert {(0, 60)} | {(0, b) for b in range(1, 160)} | {(60, b) for b in range(61, 120)} == got
    assert {(a, b) for a in range(60) for b in range(60, 120)} <= {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, full=100).collect()}


def test_groups_of_a_large_block_with_missing_fields_are_whole(spark):
    """One name; 200 rows have only an e-mail, only a phone, both or neither, all unlike each other. Nothing but the name speaks for or
    against two rows that share no other field, so brute force makes one group of them; 60 rows of another name have all fields."""
    far = "translate(md5(cast(id as string)), '0123456789', 'ghijklmnop')"
    kinds = {
        "name": "if(id < 200, 'John Smith', 'Ann Lee')", "email": f"if(id < 200 and id % 4 in (1, 3), null, concat({far}, '@d', id, '.com'))",
        "phone": "if(id < 200 and id % 4 in (0, 3), null, translate(cast(1000000000 + id * 7368787 as string), '0', cast(id % 9 + 1 as string)))",
    }
    rows = people(spark, 260, **kinds).withColumn("website", F.lit(None).cast("string"))
    some = D.dup_candidate_pairs(rows, full=50).cache()
    assert some.count() < 260 * 10
    groups = lambda pairs: {r.id: r.group_id for r in D.duplicate_groups(rows, D.company_matches(rows, pairs=pairs, metric="levenshtein", least="high")).collect()}
    got, want = groups(some), groups(D.dup_candidate_pairs(rows, exhaustive=True))
    assert got == want and sum(g == 0 for g in want.values()) == 200


def test_large_blocks_meet_equal_users_and_near_phones(spark):
    rows = people(spark, 200, name="'John Smith'", email="if(id < 100, concat(md5(cast(id div 2 as string)), '@d', id, '.com'), null)", phone="if(id < 100, null, concat(substr(translate(md5(cast(id div 2 as string)), 'abcdef', '123456'), 1, 9), id % 2))")
    got = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, full=50).collect()}
    assert {(a, a + 1) for a in range(0, 200, 2)} <= got
    assert {(a, b) for a, b in got if a not in (0, 100) and b != 100} == {(a, a + 1) for a in range(2, 200, 2)} - {(100, 101)}


def test_exact_duplicates_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, None), (4, None, None), (5, "x", None), (6, None, "a")], "id long, p string, q string")
    assert sorted(r.id for r in D.exact_duplicates(rows, ["p", "q"]).collect()) == [2, 4, 6]
    assert D.exact_duplicates(rows, ["p", "q"]).columns == ["id", "p", "q"] and D.exact_duplicates(rows.limit(0), ["p"]).count() == 0


def test_near_names_are_candidates_with_high_recall(spark):
    kinds = {"name": "concat(md5(cast(id div 2 as string)), if(id % 2 = 1, 'q', ''), ' trading house')"}
    rows = people(spark, 400, **kinds)
    got = {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(rows, fuzzy=True).collect()}
    assert not D.dup_candidate_pairs(rows).collect()
    assert len(got & {(a, a + 1) for a in range(0, 400, 2)}) >= 0.95 * 200
    odd = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "Al", None), (4, "al", None), (None, "al", None)], "id long, name string, phone string")
    assert {(r.id_a, r.id_b) for r in D.dup_candidate_pairs(D.norm_keys(odd), fuzzy=True).collect()} == {(3, 4)}
    assert D.dup_candidate_pairs(D.norm_keys(odd.limit(0))).count() == 0


# ---- request logs


def test_request_windows_reach_over_hours(spark):
    from leadloom.operators import windows as W

    base = 1704067200 + 3590
    rows = spark.createDataFrame([(i, base + t, "d") for i, t in enumerate([0, 30, 60, 61, 3600, 3661])], "event_id long, e long, domain string").selectExpr("event_id", "timestamp_seconds(e) as ts", "domain")
    got = [(r.in_minute, r.in_hour) for r in W.request_limit_audit(rows, 1, 2).orderBy("event_id").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (3, 4), (1, 5), (1, 3)]  # exactly 60 and 3600 seconds old ones count


def test_runs_and_rates_reach_over_chunks(spark, monkeypatch):
    import random

    from leadloom.operators import windows as W

    monkeypatch.setattr(W, "CHUNK", 100)
    rng = random.Random(4)
    ok = [rng.random() < 0.1 if 150 < i < 420 else rng.random() < 0.6 for i in range(700)]
    ok[200:420] = [False] * 220
    rows = spark.createDataFrame([(i, 1704067200 + 40 * i, "d", ok[i], float(i % 37)) for i in range(700)], "event_id long, e long, domain string, success boolean, response_ms double").selectExpr("event_id", "timestamp_seconds(e) as ts", "domain", "success", "response_ms")
    run, want = 0, []
    for x in ok:
        run = 0 if x else run + 1
        want.append(run)
    assert [r.failures for r in W.failure_backoff(rows).orderBy("event_id").collect()] == want
    got = W.recent_error_rate(rows).orderBy("event_id").collect()
    assert [r.error_rate_10 for r in got] == [round(sum(not x for x in ok[max(0, i - 9) : i + 1]) / min(10, i + 1), 6) for i in range(700)]
    mean = [sum(j % 37 for j in range(max(0, i - 99), i + 1)) / min(100, i + 1) for i in range(700)]
    assert all(abs(r.mean_response_100 - m) < 1e-3 for r, m in zip(got, mean))


def test_body_confidence_counts_occurrences(spark):
    pages = spark.createDataFrame([(1, "x", "js.stripe.com"), (2, "x", "js.stripe.com js.stripe.com"), (3, "x", "none"), (4, "x", None)], "page_id long, url string, html string")
    assert {r.page_id: r.confidence for r in P.detect_technologies(pages).where("technology = 'Stripe'").collect()} == {1: 0.8, 2: 0.9}


def technologies_by_hand(html, headers):
    """Every pattern by a regular expression of its own, methods in order, the better one wins."""
    out, fields = [], {k.lower(): v for k, v in headers.items()}
    tags = re.findall(r"(?is)<script([^>]*)>(.*?)</script", html)
    said = " ".join(re.search("src=.([^'\"]*)", t)[1] if "src=" in t else body for t, body in tags)
    generators = [m for m in re.findall("(?i)<meta name=.generator. content=.([^'\"]*)", html)]
    for name, (_, body, script, header) in P.SIGNATURES.items():
        if any(re.search(p, fields.get(h, ""), re.I) for h in header for p in body):
            out.append((name, 0.8, "header"))
        n = next((n for n in (len(re.findall(p, html, re.I)) for p in body) if n), 0)
        out += [(name, round(min(0.7 + 0.1 * n, 0.9), 4), "content")] if n else []
        out += [(name, 0.85, "script")] if any(re.search(p, said, re.I) for p in script) else []
        out += [(name, 0.9, "meta_tag")] if name in P.META_GENERATOR and any(re.search(p, g, re.I) for p in body for g in generators) else []
    best = {}
    for name, c, m in out:
        if name not in best or c > best[name][0]:
            best[name] = (c, m)
    return best


def test_technologies_equal_one_search_per_pattern(spark):
    from leadloom.functions.literals import Patterns, folded

    rng = random.Random(8)
    bits = [re.sub(r"\\(.)", r"\1", p) for s in P.SIGNATURES.values() for k in (1, 2) for p in s[k]] + ["\u212Aunst \u017Ftripe react\u0130", "<b>", " ", "x", "İ", "é", "\n", "reactreact"]
    word = lambda: "".join(rng.choice([str.upper, str.lower, str])(rng.choice(bits)) for _ in range(rng.randrange(4)))
    pages = []
    for k in range(300):
        html = word() + rng.choice(["", f"<script src='{word()}'>{word()}</script>", f"<SCRIPT type='x'>{word()}</script>", f"<meta name='generator' content='{word()}'>"]) + word()
        heads = {rng.choice(["X-Powered-By", "server", "via", "CF-RAY", "other"]): word().replace("\n", " ") for _ in range(rng.randrange(3))}
        pages.append((k, html.replace("<b>", ""), heads))
    frame = spark.createDataFrame(pages, "page_id long, html string, headers map<string,string>")
    got = {}
    for r in P.detect_technologies(frame).collect():
        got.setdefault(r.page_id, {})[r.technology] = (r.confidence, r.method)
    assert got == {k: t for k, html, heads in pages if (t := technologies_by_hand(html, heads))}
    lines = frame.withColumn("headers", F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))
    assert sorted(map(repr, P.detect_technologies(lines).collect())) == sorted(map(repr, P.detect_technologies(frame).collect()))
    assert Patterns(["a.c", "ab", "aa"]).counts("ABC aaa axc aab") == {"a.c": 2, "ab": 2, "aa": 2} and len(folded("İıſK")) == 4
    odd = spark.createDataFrame([(None, None, None, 1), (1, "stripe", "no header", 2), (1, "stripe", "{bad json", 3)], "page_id long, html string, headers string, category int")
    assert [(r.page_id, r.technology, r.category) for r in P.detect_technologies(odd).collect()] == [(1, "Stripe", "payment")] * 2
    assert P.detect_technologies(odd.limit(0)).count() == 0


def test_texts_of_signals(spark):
    from leadloom.operators import intel as I

    c = spark.createDataFrame([(1, "a", "We are hiring 3 people", ["PHP", "MySQL"], 112, 100)], "id long, name string, description string, technologies array<string>, employee_count int, previous_employee_count int")
    got = {r.signal_type: (r.description, r.evidence) for r in I.growth_signals(c).collect()}
    assert got["hiring"] == ("Hiring activity detected: hiring 3", ["hiring 3"])
    assert got["team_growth"] == ("Employee growth: 100 to 112 (12.0%)", ["Employee count increased by 12.0%"])
    pains = {r.source: (r.description, r.keywords, r.potential_solutions[0]) for r in I.pain_points(c).collect()}
    assert pains["technology_analysis"] == ("Legacy technology stack detected (2 legacy technologies)", ["2 legacy technologies"], "Technology modernization roadmap")
    assert pains["size_analysis"] == ("Mid-size company scaling challenges", ["scaling", "growth"], "Process standardization")


# ---- streams


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    from leadloom.streaming import streams as T

    day = 1704067200
    slices = [[(1, day, "c"), (2, day + 30, "c"), (3, day + 7200, "c")], [(5, day + 7100, "c"), (6, day + 7300, "c")], [(4, day + 60, "c"), (7, day + 90000, "c")]]
    rows = [spark.createDataFrame(x, "event_id long, e long, client_id string").selectExpr("event_id", "timestamp_seconds(e) as ts", "client_id") for x in slices]
    for r in rows:
        r.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, query = T.run_files(str(tmp_path), rows[0].schema, spark, lambda df: T.stream_request_windows(df, 1, "5 minutes", "5 minutes"))
    assert {r.window_start[11:]: r.requests for r in got.collect()} == {"00:00:00": 2, "01:55:00": 1, "02:00:00": 2}  # row 4 came two hours late, row 5 in time
    assert T.late_rows(query) == 1


EVENTS = "event_id long, e double, job_id long, job_status string, current_items int"


def job_files(spark, folder, slices, first=0):
    """One file of events per slice, in order."""
    for x in slices[first:]:
        rows = spark.createDataFrame([(k, float(e), *rest) for k, e, *rest in x], EVENTS).selectExpr("event_id", "timestamp_seconds(e) as ts", "job_id", "job_status", "current_items", "100 as total_items")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows.schema


def test_running_job_shows_progress_and_an_idle_one_is_dropped(spark, tmp_path):
    from leadloom.streaming import streams as T

    day = 1704067200
    slices = [[(1, day, 7, "started", 0), (2, day + 600, 7, "progress", 40)], [(3, day + 1200, 7, "progress", 50), (9, day + 1100, 8, "started", 1), (10, day + 900, 7, "progress", 45)], [(4, day + 3 * 86400, 7, "success", 100), (5, day + 3 * 86400, 8, "failure", 10)], [(6, day + 9 * 86400, 9, "started", 1)], [(7, day + 9 * 86400 + 1, None, "started", 1)]]
    schema = job_files(spark, tmp_path, slices)
    got, query = T.run_files(str(tmp_path), schema, spark, T.stream_job_progress, mode="update")
    rows = sorted((r.batch, r.job_id, r.run, r.job_status, r.percentage, r.elapsed, r.remaining, r.ended) for r in got.collect())
    assert [r for r in rows if r[0] == 0] == [(0, 7, 1, "progress", 40.0, 600, 900.0, False)]  # the job still runs
    assert [r for r in rows if r[0] == 1] == [(1, 7, 1, "progress", 50.0, 1200, 1200.0, False), (1, 8, 9, "started", 1.0, 0, 0.0, False)]
    assert {r[1:5] + r[7:] for r in rows if r[0] > 1} == {(7, 1, "progress", 50.0, True), (8, 9, "started", 1.0, True), (7, 4, "success", 100.0, False), (8, 5, "failure", 10.0, False), (7, 4, "success", 100.0, True), (8, 5, "failure", 10.0, True), (9, 6, "started", 1.0, False)}
    assert len({r[1:3] + r[7:] for r in rows if r[7]}) == len([r for r in rows if r[7]]) == 4  # each run ends once
    assert [r.eta for r in got.where("batch = 0").collect()] == ["2024-01-01 00:25:00"]


def test_restarted_job_stream_repeats_nothing_and_equals_the_batch(spark, tmp_path):
    from leadloom.streaming import streams as T

    rng, day = random.Random(4), 1704067200
    rows = sorted((day + rng.randrange(0, 12 * 86400), rng.randrange(6)) for _ in range(160))
    events = [(k, e, j, rng.choice(["started", "progress", "success", "failure", None]), rng.choice([None, rng.randrange(101)])) for k, (e, j) in enumerate(rows)]
    slices = [events[k : k + 40] for k in range(0, 160, 40)]
    schema = job_files(spark, tmp_path, slices[:2])
    first, _ = T.run_files(str(tmp_path), schema, spark, T.stream_job_progress, mode="update")
    before = sorted(map(repr, first.collect()))
    job_files(spark, tmp_path, slices, 2)
    got, _ = T.run_files(str(tmp_path), schema, spark, T.stream_job_progress, mode="update")
    assert set(before) < set(map(repr, got.collect())) and got.distinct().count() == got.count()
    batch = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    names = ["job_id", "run", "started", "job_status", "percentage", "elapsed", "remaining", "eta"]
    want = sorted(map(repr, T.stream_job_progress(batch).select(names).collect()))
    assert sorted(map(repr, T.last_updates(got).select(names).collect())) == want
    for make, some in ((T.stream_batch_progress, ["job_id", "run", "percentage"]), (T.stream_job_completion, ["job_id", "run", "succeeded", "failed", "items"])):
        folder = tmp_path / make.__name__
        job_files(spark, folder, slices)
        made, _ = T.run_files(str(folder), schema, spark, make, mode="update")
        assert sorted(map(repr, T.last_updates(made).select(some).collect())) == sorted(map(repr, make(batch).select(some).collect()))