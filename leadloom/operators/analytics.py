"""Aggregates that a lead team reads. Each is one or few grouped aggregates with partial aggregation; results are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_avg, filled, pct
from ..functions.graph import saved
from .integrity import stamp
from .select import all_of, filter_dict, top_k_counts


def in_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None, filters: dict | None = None) -> DataFrame:
    out = df.where(all_of(F.col(column) >= stamp(start) if start else None, F.col(column) < stamp(end) if end else None))
    return filter_dict(out, filters) if filters else out


def distribution(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """``(name, count)``; null as Unknown."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(F.coalesce(c.cast("string"), F.lit("Unknown")).alias(name)).agg(F.count("*").alias("count"))


def dashboard(companies: DataFrame, contacts: DataFrame, as_of: str, qualified: float = 70) -> DataFrame:
    """``(metric, value)``: totals, new in the last day, qualified and their rate, and the top industries."""
    new = F.col("created_at") >= stamp(as_of) - F.expr("INTERVAL 1 DAY")
    a = companies.agg(F.count("*").alias("total_leads"), F.count_if(new).alias("new_today"), F.count_if(F.col("lead_score") >= qualified).alias("qualified"))
    a = a.withColumn("qualified_pct", pct(F.col("qualified"), F.col("total_leads")))
    one = a.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("total_leads", "new_today", "qualified", "qualified_pct")])).alias("x")).select("x.*")
    top = top_k_counts(companies, "industry", 10).select(F.concat(F.lit("industry:"), "value").alias("metric"), F.col("count").cast("double").alias("value"))
    return one.unionByName(contacts.agg(F.count("*").cast("double").alias("value")).select(F.lit("total_contacts").alias("metric"), "value")).unionByName(top)


def trend_daily(companies: DataFrame, days: int, as_of: str) -> DataFrame:
    """Leads per day over the last ``days`` days: ``(day, leads)``, days without leads left out."""
    recent = in_range(companies, "created_at").where(F.col("created_at") >= stamp(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("leads"))


def trend_growth(daily: DataFrame) -> DataFrame:
    """Total, mean per day and second half against first half in %. At most one row per day enters, so one partition is enough."""
    rows = daily.withColumns({"n": F.row_number().over(Window.orderBy("day")), "days": F.count("*").over(Window.partitionBy())})
    first = F.col("n") <= F.floor(F.col("days") / 2)
    out = rows.agg(F.sum("leads").alias("total"), F.count("*").alias("days"), F.avg(F.when(first, F.col("leads"))).alias("a"), F.avg(F.when(~first, F.col("leads"))).alias("b"))
    return out.select(F.coalesce("total", F.lit(0)).alias("total"), F.round(F.col("total") / F.col("days"), 4).alias("mean_per_day"), F.round(F.when(F.col("a") > 0, 100.0 * (F.col("b") - F.col("a")) / F.col("a")).otherwise(0.0), 4).alias("growth_pct"))


def trend_score(companies: DataFrame) -> DataFrame:
    return companies.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.round(exact_avg("lead_score"), 4).alias("average_score"), F.count("lead_score").alias("scored"))


def trend_signals(companies: DataFrame) -> DataFrame:
    """Growth signals that are set, per day."""
    n = F.size(F.map_filter("growth_signals", lambda k, v: v))
    return companies.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum(n).alias("signals"))


def _seconds(a: str, b: str) -> Column:
    return F.unix_timestamp(F.col(b).cast("timestamp")) - F.unix_timestamp(F.col(a).cast("timestamp"))


def job_performance(jobs: DataFrame, as_of: str) -> DataFrame:
    """One row: jobs by state, success %, mean duration in hours, started in the last day, targets done %, companies per finished job."""
    done = F.col("status") == "completed"
    a = jobs.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "running").alias("running"),
        F.avg(F.when(done, _seconds("start_time", "end_time") / 3600.0)).alias("h"), F.count_if(F.col("start_time") >= stamp(as_of) - F.expr("INTERVAL 1 DAY")).alias("last_day"),
        F.sum("processed_targets").alias("p"), F.sum("total_targets").alias("t"), F.sum(F.when(done, F.col("companies_found"))).alias("found"),
    )
    return a.select("total", "completed", "failed", "running", pct(F.col("completed"), F.col("total")).alias("success_pct"), F.round("h", 4).alias("mean_hours"), "last_day", pct(F.col("p"), F.col("t")).alias("targets_pct"), F.round(F.when(F.col("completed") > 0, F.col("found") / F.col("completed")).otherwise(0.0), 4).alias("leads_per_job"))


def export_stats(exports: DataFrame, as_of: str) -> DataFrame:
    a = exports.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")], F.count_if(F.col("created_at") >= stamp(as_of) - F.expr("INTERVAL 1 DAY")).alias("today"), F.sum("total_records").alias("records"))
    return a.withColumn("success_pct", pct(F.col("completed"), F.col("total")))


def job_summary(jobs: DataFrame) -> DataFrame:
    """``(status, jobs, companies, contacts, mean_hours)`` per status."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.sum("companies_found").alias("companies"), F.sum("contacts_found").alias("contacts"), F.round(F.avg(_seconds("start_time", "end_time") / 3600.0), 4).alias("mean_hours"))


def lead_summary_by_job(jobs: DataFrame, scraped: DataFrame) -> DataFrame:
    """Per job: scraped rows, valid rows, success %, hours. Rows are counted before the join."""
    n = scraped.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("leads"), F.count_if(F.col("validation_status") == "valid").alias("valid"))
    rows = jobs.join(n, "id", "left").withColumns({"leads": F.coalesce("leads", F.lit(0)), "valid": F.coalesce("valid", F.lit(0))})
    return rows.select("id", "leads", "valid", pct(F.col("valid"), F.col("leads")).alias("success_pct"), F.round(_seconds("start_time", "end_time") / 3600.0, 4).alias("hours"))


def lead_quality_3(companies: DataFrame) -> DataFrame:
    """High from 80, medium from 50, low, unscored, and the mean."""
    s = F.col("lead_score")
    return companies.agg(F.count("*").alias("total"), F.count_if(s >= 80).alias("high"), F.count_if((s >= 50) & (s < 80)).alias("medium"), F.count_if(s < 50).alias("low"), F.count_if(s.isNull()).alias("unscored"), F.round(exact_avg("lead_score"), 4).alias("average"))


def lead_quality_hot(companies: DataFrame) -> DataFrame:
    s = F.col("lead_score")
    return companies.agg(F.count("lead_score").alias("scored"), F.count_if(s >= 80).alias("hot"), F.count_if((s >= 60) & (s < 80)).alias("warm"), F.count_if(s < 60).alias("cold"), F.round(exact_avg("lead_score"), 4).alias("average"))


def score_distribution(companies: DataFrame) -> DataFrame:
    """Hot from 80, Warm from 60, Cold from 40, Poor; best first."""
    s = F.col("lead_score")
    band = F.when(s >= 80, "Hot").when(s >= 60, "Warm").when(s >= 40, "Cold").otherwise("Poor")
    return companies.where(s.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("count"), F.min("lead_score").alias("low")).orderBy(F.desc("low")).select("band", "count")


def score_histogram(companies: DataFrame) -> DataFrame:
    s = F.col("lead_score")
    band = F.when(s <= 25, "0-25").when(s <= 50, "26-50").when(s <= 75, "51-75").otherwise("76-100")
    return companies.where(s.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("count"))


def contact_insights(contacts: DataFrame) -> DataFrame:
    return contacts.agg(
        F.count("*").alias("total"), F.count_if("is_verified").alias("verified"), F.count_if("is_decision_maker").alias("decision_makers"), F.count_if(filled("email")).alias("with_email"),
        F.count_if(filled("phone")).alias("with_phone"), F.count_if(filled("linkedin_url")).alias("with_linkedin"), F.count_distinct("job_title").alias("titles"), F.round(F.avg("experience_years"), 4).alias("mean_experience"),
    )


def contact_rates(contacts: DataFrame) -> DataFrame:
    n = F.count("*")
    return contacts.agg(n.alias("total"), pct(F.count_if(filled("email")), n).alias("email_pct"), pct(F.count_if(filled("phone")), n).alias("phone_pct"))


def industry_breakdown(companies: DataFrame) -> DataFrame:
    """``(dimension, value, count)`` for industry, size and revenue in one pass by grouping sets."""
    names = ("industry", "company_size", "revenue_range")
    long = companies.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(n, F.lit("Unknown")).alias("value")) for n in names])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("count"))


def technology_counts(companies: DataFrame) -> DataFrame:
    """``(technology, count, adoption_pct)`` over companies that list any."""
    using = companies.where(F.size("technologies") > 0)
    total = using.agg(F.count("*").alias("total"))
    counts = using.select(F.explode(F.array_distinct("technologies")).alias("technology")).groupBy("technology").agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(total), F.lit(True)).select("technology", "count", pct(F.col("count"), F.col("total")).alias("adoption_pct"))


def technology_emerging(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.where(F.col("adoption_pct").between(5, 20)).orderBy(F.desc("count"), "technology").limit(k)


def technology_combos(companies: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent sorted triples of a company's first three technologies."""
    combo = F.array_join(F.array_sort(F.slice("technologies", 1, 3)), " + ")
    return companies.where(F.size("technologies") >= 2).groupBy(combo.alias("combo")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "combo").limit(k)




def period(column: str, by: str) -> Column:
    """Start of the day, Monday week or month as text."""
    return F.date_format(F.date_trunc(by, F.col(column).cast("timestamp")), "yyyy-MM-dd")


def conversion_rates(companies: DataFrame, by: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """Per period: leads, qualified from 50, high from 80, and rates."""
    s, n = F.col("lead_score"), F.count("*")
    rows = in_range(companies, "created_at", start, end).groupBy(period("created_at", by).alias("period")).agg(n.alias("leads"), F.count_if(s >= 50).alias("qualified"), F.count_if(s >= 80).alias("high"))
    return rows.withColumns({"qualified_pct": pct(F.col("qualified"), F.col("leads")), "high_pct": pct(F.col("high"), F.col("leads"))})


def conversion_funnel(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(stage, position, companies, pct_of_previous)``: all, scored, qualified, with a contact, with a verified decision maker."""
    has = contacts.groupBy(F.col("company_id").alias("id")).agg(F.max(F.lit(1)).alias("c"), F.max((F.col("is_verified") & F.col("is_decision_maker")).cast("int")).alias("d"))
    rows = companies.join(has, "id", "left")
    scored = F.col("lead_score").isNotNull()
    qualified = scored & (F.col("lead_score") >= 50)
    reached = qualified & F.col("c").isNotNull()
    stages = [("all", F.lit(True)), ("scored", scored), ("qualified", qualified), ("contacted", reached), ("decision", reached & (F.col("d") == 1))]
    one = rows.agg(*[F.count_if(test).alias(name) for name, test in stages])
    previous = [None, *[n for n, _ in stages]]
    made = [F.struct(F.lit(n).alias("stage"), F.lit(i + 1).alias("position"), F.col(n).alias("companies"), (pct(F.col(n), F.col(previous[i])) if i else F.lit(100.0)).alias("pct_of_previous")) for i, (n, _) in enumerate(stages)]
    return one.select(F.explode(F.array(*made)).alias("x")).select("x.*")


COMPANY_FIELDS = ("name", "website", "industry", "company_size", "description", "employee_count", "technologies_csv")
CONTACT_FIELDS = ("email", "phone", "job_title", "linkedin_url", "department")


def completeness(fields: tuple[str, ...]) -> Column:
    """Share of filled fields of a row in %."""
    return 100.0 * reduce(lambda a, b: a + b, [filled(f).cast("int") for f in fields]) / len(fields)


def data_quality(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: total, filled rows per field, mean completeness and the same cut to an integer."""
    mean = exact_avg(completeness(fields), 8)
    return df.agg(F.count("*").alias("total"), *[F.count_if(filled(f)).alias(f"with_{f}") for f in fields], F.round(mean, 4).alias("completeness"), F.floor(F.round(mean, 8)).cast("long").alias("completeness_int"))


def data_quality_overall(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    both = data_quality(companies, COMPANY_FIELDS).select(F.lit("c").alias("k"), "completeness").union(data_quality(contacts, CONTACT_FIELDS).select(F.lit("p"), "completeness"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("completeness")))
    return both.agg(pick("c").alias("companies"), pick("p").alias("contacts"), F.round((pick("c") + pick("p")) / 2, 4).alias("overall"))


def lead_insights(companies: DataFrame, contacts: DataFrame, detail: bool = False) -> DataFrame:
    """Per company: contacts, decision makers, verified, technologies, set growth signals; with detail mean quality and engagement."""
    per = contacts.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n_contacts"), F.count_if("is_decision_maker").alias("decision_makers"), F.count_if("is_verified").alias("verified"), F.round(exact_avg("contact_quality_score"), 9).alias("mean_quality"), F.round(exact_avg("engagement_potential"), 9).alias("mean_engagement"))
    rows = companies.join(per, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_contacts", "decision_makers", "verified")]
    techs = F.coalesce(F.size(F.when(F.col("technologies").isNotNull(), F.col("technologies"))), F.lit(0)).cast("long").alias("n_technologies")
    signals = F.size(F.map_filter("growth_signals", lambda k, v: v)).cast("long").alias("n_signals")
    return rows.select("id", *zero, techs, signals, *(("mean_quality", "mean_engagement") if detail else ()))


def lead_recommendations(insights: DataFrame) -> DataFrame:
    """``insights`` (with lead_score) with ``recommendations``, in rule order."""
    tips = F.array_compact(F.array(
        F.when(F.col("lead_score") >= 80, "High-priority lead: contact at once"),
        F.when((F.col("lead_score") >= 60) & (F.col("lead_score") < 80), "Good lead: schedule a follow-up"),
        F.when(F.coalesce("lead_score", F.lit(0.0)) < 60, "Nurture with content"),
        F.when(F.col("decision_makers") > 0, "Reach out to the decision makers"),
        F.when(F.col("n_contacts") == 0, "Find contacts"),
        F.when(F.col("n_signals") > 0, "Mention recent growth"),
    ))
    return insights.withColumn("recommendations", tips)


def seniority_by_company(contacts: DataFrame) -> DataFrame:
    """Per company a map of seniority to contacts; null as Unknown. The map holds few keys, after a grouped count."""
    n = contacts.groupBy("company_id", F.coalesce("seniority_level", F.lit("Unknown")).alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("company_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("seniority"))


def department_share(contacts: DataFrame) -> DataFrame:
    n = contacts.groupBy("company_id", F.coalesce("department", F.lit("Unknown")).alias("department")).agg(F.count("*").alias("contacts"))
    return n.withColumn("share_pct", F.round(100.0 * F.col("contacts") / F.sum("contacts").over(Window.partitionBy("company_id")), 4))


def lead_completeness(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per company: completeness of 6 company fields, mean of 5 contact fields over its contacts, and the mean of both."""
    own = completeness(("name", "website", "industry", "company_size", "description", "phone"))
    per = contacts.groupBy(F.col("company_id").alias("id")).agg(exact_avg(completeness(CONTACT_FIELDS), 8).alias("p"))
    rows = companies.select("id", own.alias("c")).join(per, "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return rows.select("id", F.round("c", 4).alias("company_pct"), F.round("p", 4).alias("contact_pct"), F.round((F.col("c") + F.col("p")) / 2, 4).alias("overall_pct"))


def lead_list_summary(companies: DataFrame) -> DataFrame:
    return companies.agg(F.count("*").alias("leads"), F.round(exact_avg("lead_score"), 4).alias("average_score"), F.array_join(F.array_sort(F.collect_set("industry")), ",").alias("industries"), F.array_join(F.array_sort(F.collect_set("company_size")), ",").alias("sizes"))


def job_type_stats(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy("job_type").agg(F.count("*").alias("submitted"), *[F.count_if(s == x).alias(x) for x in ("completed", "failed", "cancelled")], F.round(F.avg(F.when(s == "completed", _seconds("start_time", "end_time") / 3600.0)), 4).alias("mean_hours"))


STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def job_status_counts(jobs: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Jobs per status, zero where there are none."""
    one = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("jobs")) for s in statuses])).alias("x")).select("x.*")


def query_results(scraped: DataFrame, by: str = "source_type") -> DataFrame:
    s = F.col("validation_status")
    return scraped.groupBy(by).agg(F.count("*").alias("found"), F.count_if(s == "valid").alias("scraped"), F.count_if(s == "invalid").alias("failed"))


#: Accuracy of the sketch that cuts a group's values, and the shares beside a percentile's where it does: few stand between the inner two.
RANK_ACCURACY = 10_000
BESIDE = (-0.1, -0.01, -0.001, 0.001, 0.01, 0.1)


def cuts(column: str, share: float, accuracy: int = RANK_ACCURACY) -> Column:
    """Values around the percentile, from a mergeable sketch."""
    return F.percentile_approx(F.col(column).cast("double"), [min(1.0, max(0.0, share + d)) for d in BESIDE], accuracy)


def percentiles(rows: DataFrame, totals: DataFrame, by: str, column: str, share: float) -> DataFrame:
    """``(key, lo, hi, part)`` per group: the values of the ranks around ``share * (n - 1)``, and how far the percentile lies between them.

    ``totals(by, cuts, valued)`` holds each group's cuts and its number of values. The rows between two cuts are counted; only the
    values of the stretches that hold the two ranks are sorted. Exact, however good the cuts are: they bound what is sorted together.
    """
    rank = F.lit(share) * (F.col("valued") - 1)
    known = totals.where("valued > 0").select(F.col(by).alias("key"), "cuts", F.floor(rank).alias("first"), F.ceil(rank).alias("last"), (rank - F.floor(rank)).alias("part"))
    values = rows.select(F.col(by).alias("k"), F.col(column).cast("double").alias("v")).where("v is not null")
    values = values.join(known, F.col("k").eqNullSafe(F.col("key"))).withColumn("stretch", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("k", "cuts")
    group = ["key", "first", "last", "part", "stretch"]
    sizes = values.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("stretch")) - F.col("n"))
    held = saved(sizes.where("before <= last and before + n > first").select(F.col("key").alias("k"), F.col("stretch").alias("s"), "before"), "request-stretches")
    near = values.join(held, F.col("key").eqNullSafe(F.col("k")) & (F.col("stretch") == F.col("s"))).groupBy(*group, "before", "v").agg(F.count("*").alias("n"))
    near = near.withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy("key", "stretch").orderBy("v")) - F.col("n"))
    on = lambda r: F.max(F.when((F.col("at") <= F.col(r)) & (F.col(r) < F.col("at") + F.col("n")), F.col("v")))
    return near.groupBy("key", "part").agg(on("first").alias("lo"), on("last").alias("hi"))


def request_metrics(requests: DataFrame, by: str = "domain", accuracy: int = RANK_ACCURACY) -> DataFrame:
    """Totals, error %, mean and 95th percentile of the response, requests per hour.

    The percentile is exact, between the two values around rank ``0.95 (n - 1)``; ``accuracy`` is that of the sketch by which values are cut.
    """
    n = F.count("*")
    span = (F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))) / 3600.0
    totals = requests.groupBy(by).agg(n.alias("requests"), pct(F.count_if(~F.col("success")), n).alias("error_pct"), F.round(exact_avg("response_ms"), 4).alias("mean_response"), F.round(F.when(span > 0, n / span).otherwise(n.cast("double")), 4).alias("per_hour"), F.count("response_ms").alias("valued"), cuts("response_ms", 0.95, accuracy).alias("cuts"))
    totals = saved(totals, "request-totals")
    p95 = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part"))
    out = totals.join(percentiles(requests, totals, by, "response_ms", 0.95), F.col(by).eqNullSafe(F.col("key")), "left")
    return out.select(by, "requests", "error_pct", "mean_response", F.round(p95, 4).alias("p95_response"), "per_hour")


def metric_trends(metrics: DataFrame, hours: int, as_of: str) -> DataFrame:
    """Per metric: mean, peak and latest value of the last hours."""
    recent = metrics.where((F.col("ts") > stamp(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("ts") <= stamp(as_of)))
    return recent.groupBy("metric_name").agg(F.round(exact_avg("metric_value"), 4).alias("mean"), F.max("metric_value").alias("peak"), F.max_by("metric_value", F.struct("ts", "event_id")).alias("latest"))


def health_score(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """100 minus 10 per metric whose mean is over its limit and 20 if over twice; one row with score and band."""
    means = metrics.groupBy("metric_name").agg(exact_avg("metric_value").alias("mean"))
    loss = F.lit(0)
    for name, limit in limits.items():
        loss = loss + F.when((F.col("metric_name") == name) & (F.col("mean") > 2 * limit), 20).when((F.col("metric_name") == name) & (F.col("mean") > limit), 10).otherwise(0)
    total = means.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(loss), F.lit(0))).cast("long").alias("score"))
    return total.withColumn("band", F.when(F.col("score") >= 90, "healthy").when(F.col("score") >= 70, "degraded").otherwise("unhealthy"))


def daily_report(requests: DataFrame, limit_ms: float) -> DataFrame:
    """Per day: requests, mean and peak response, error %, rows over the limit, and a score of 100 less half the error %."""
    n = F.count("*")
    rows = requests.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n.alias("requests"), F.round(exact_avg("response_ms"), 4).alias("mean_response"), F.max("response_ms").alias("peak_response"), pct(F.count_if(~F.col("success")), n).alias("error_pct"), F.count_if(F.col("response_ms") > limit_ms).alias("alerts"))
    return rows.withColumn("score", F.round(100 - F.col("error_pct") / 2, 4))


def engagement_opportunities(signals: DataFrame, pains: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies by priority: high if they have a growth signal, else medium if a pain point, else low if technologies are listed."""
    s, p = signals.select(F.col("company_id").alias("id")).distinct().withColumn("s", F.lit(1)), pains.select(F.col("company_id").alias("id")).distinct().withColumn("p", F.lit(1))
    rows = companies.select("id", F.coalesce(F.size("technologies") > 0, F.lit(False)).alias("t")).join(s, "id", "left").join(p, "id", "left")
    priority = F.when(F.col("s").isNotNull(), "high").when(F.col("p").isNotNull(), "medium").when(F.col("t"), "low")
    return rows.withColumn("priority", priority).where("priority is not null").groupBy("priority").agg(F.count("*").alias("leads"))


def job_quality_metrics(jobs: DataFrame, scraped: DataFrame, companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per job: mean score of its companies, high and medium leads, and % of its contacts with e-mail and phone."""
    c = scraped.select(F.col("job_id"), F.col("company_id").alias("cid")).distinct().join(companies.select(F.col("id").alias("cid"), "lead_score"), "cid")
    k = scraped.select(F.col("job_id"), F.col("contact_id").alias("kid")).distinct().join(contacts.select(F.col("id").alias("kid"), "email", "phone"), "kid")
    a = c.groupBy("job_id").agg(F.round(exact_avg("lead_score"), 4).alias("average_score"), F.count_if(F.col("lead_score") >= 80).alias("high"), F.count_if((F.col("lead_score") >= 50) & (F.col("lead_score") < 80)).alias("medium"))
    b = k.groupBy("job_id").agg(F.count("*").alias("n_contacts"), pct(F.count_if(filled("email")), F.count("*")).alias("email_pct"), pct(F.count_if(filled("phone")), F.count("*")).alias("phone_pct"))
    return jobs.select(F.col("id").alias("job_id")).join(a, "job_id", "left").join(b, "job_id", "left")


def lead_sources(scraped: DataFrame) -> DataFrame:
    """Per company its sources, each with rows, jobs and first and last time; grouped per source first, so the list is short."""
    per = scraped.groupBy("company_id", "source_type").agg(F.count("*").alias("rows"), F.count_distinct("job_id").alias("jobs"), F.date_format(F.min("scraped_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("scraped_at"), "yyyy-MM-dd").alias("last"))
    return per.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("source_type", "rows", "jobs", "first", "last"))).alias("sources"))


def business_metrics(companies: DataFrame, scraped: DataFrame) -> DataFrame:
    """``(kind, group, leads, average_score, success_pct)``: leads per hour of day bucket, and per source."""
    hour = companies.groupBy(F.date_format(F.date_trunc("hour", F.col("created_at").cast("timestamp")), "yyyy-MM-dd HH:00").alias("group")).agg(F.count("*").alias("leads"), F.round(exact_avg("lead_score"), 4).alias("average_score"))
    source = scraped.groupBy(F.col("source_type").alias("group")).agg(F.count("*").alias("leads"), pct(F.count_if(F.col("validation_status") == "valid"), F.count("*")).alias("success_pct"))
    return hour.select(F.lit("hour").alias("kind"), "*").unionByName(source.select(F.lit("source").alias("kind"), "*"), allowMissingColumns=True)


def comprehensive(companies: DataFrame, contacts: DataFrame, jobs: DataFrame, metrics: tuple[str, ...], group_by: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``(metric, group, value)`` for leads, qualified, average_score, contacts and jobs, grouped by day, week, month, industry, size or job_type."""
    def key(df: DataFrame, at: str) -> Column | None:
        if group_by in ("day", "week", "month"):
            return period(at, group_by)
        name = {"industry": "industry", "size": "company_size", "job_type": "job_type"}[group_by]
        return F.coalesce(name, F.lit("Unknown")) if name in df.columns else None

    made = {
        "leads": (companies, "created_at", F.count("*")), "qualified": (companies, "created_at", F.count_if(F.col("lead_score") >= 50)), "average_score": (companies, "created_at", F.round(exact_avg("lead_score"), 4)),
        "contacts": (contacts, "created_at", F.count("*")), "jobs": (jobs, "start_time", F.count("*")),
    }
    out = []
    for m in metrics:
        df, at, value = made[m]
        k = key(df, at)
        if k is not None:
            out.append(in_range(df, at, start, end).groupBy(k.alias("group")).agg(value.cast("double").alias("value")).select(F.lit(m).alias("metric"), "group", "value"))
    if not out:
        raise ValueError(f"no metric of {metrics} can be grouped by {group_by}")
    return reduce(lambda a, b: a.unionByName(b), out)


def competitive_summary(competitors: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company the number of named competitors and a label: none open, up to 2 moderate, more crowded."""
    n = competitors.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("competitors"))
    rows = companies.select("id").join(n, "id", "left").withColumn("competitors", F.coalesce("competitors", F.lit(0)))
    return rows.withColumn("position", F.when(F.col("competitors") == 0, "open").when(F.col("competitors") <= 2, "moderate").otherwise("crowded"))
