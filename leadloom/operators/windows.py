"""Order-dependent audits of a request log, as window functions partitioned by key and stretch of time or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..functions.graph import saved


def _epoch(column: str = "ts"):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def exact_mean(column: str, window):
    """Mean over a window, free of rounding by order."""
    return F.sum(F.col(column).cast("decimal(24,6)")).over(window).cast("double") / F.count(column).over(window)


def request_limit_audit(requests: DataFrame, per_minute: int = 60, per_hour: int = 1000, key: str = "domain") -> DataFrame:
    """Requests with those of the last 60 and 3600 seconds up to them, which limit they break and the wait needed (seconds).

    A request that is exactly as old as the limit's span still counts. Requests are counted by key and second first, and windows
    over these counts are cut by key and hour; each hour takes the one before it along, which is as far back as a window reaches.
    So a window holds 7,200 rows at most, however busy a key is, and its requests meet their second's counts in a join. Null keys
    are one key; requests without a time are counted together by key and break limits as if they were of one second.
    """
    epoch = _epoch()
    seconds = requests.groupBy(F.col(key).alias("__key"), epoch.alias("__at")).agg(F.count("*").alias("__n"))
    taken = F.when(F.col("__at").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    seconds = seconds.withColumn("__in", F.explode(taken)).withColumn("__hour", F.floor(F.col("__at") / 3600) + F.col("__in"))
    w = Window.partitionBy("__key", "__hour").orderBy("__at")
    minute, hour = w.rangeBetween(-60, 0), w.rangeBetween(-3600, 0)
    counts = {"in_minute": F.sum("__n").over(minute), "in_hour": F.sum("__n").over(hour)}
    firsts = {"__first_minute": F.min("__at").over(minute), "__first_hour": F.min("__at").over(hour)}
    seconds = seconds.withColumns(counts | firsts).where("__in = 0")
    over_minute, over_hour = F.col("in_minute") > per_minute, F.col("in_hour") > per_hour
    wait = F.greatest(
        F.when(over_minute, F.col("__first_minute") + 60 - F.col("__at")).otherwise(F.lit(0)),
        F.when(over_hour, F.col("__first_hour") + 3600 - F.col("__at")).otherwise(F.lit(0)),
    )
    found = seconds.withColumns({"over_minute": over_minute, "over_hour": over_hour, "wait_seconds": wait.cast("long")})
    found = saved(found.drop("__n", "__in", "__hour", "__first_minute", "__first_hour"), "request-seconds")
    own = requests.drop("in_minute", "in_hour", "over_minute", "over_hour", "wait_seconds").withColumn("__epoch", epoch)
    rows = own.join(found, F.col(key).eqNullSafe(F.col("__key")) & F.col("__epoch").eqNullSafe(F.col("__at")))
    return rows.drop("__epoch", "__key", "__at")


def numbered(requests: DataFrame, key: str, order: str) -> DataFrame:
    """``requests`` with ``__n``, the place of a row in its key by time and ``order`` (from 1), no key sorted as a whole.

    Rows are numbered within an hour; the hours of a key, one row each, give what to add.
    """
    rows = saved(requests.withColumn("__hour", F.floor(_epoch() / 3600)), "requests-hours")
    hours = rows.groupBy(key, "__hour").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = saved(hours.select(F.col(key).alias("__key"), F.col("__hour").alias("__at"), before.alias("__before")), "requests-before")
    at = F.row_number().over(Window.partitionBy(key, "__hour").orderBy("ts", order))
    rows = rows.withColumn("__n", at).join(hours, F.col(key).eqNullSafe(F.col("__key")) & F.col("__hour").eqNullSafe(F.col("__at")))
    return rows.withColumn("__n", (F.col("__n") + F.col("__before")).cast("long")).drop("__hour", "__key", "__at", "__before")


#: Rows of a key that are put through a window function together.
CHUNK = 10_000


def failure_backoff(requests: DataFrame, factor: int = 2, cap: int = 300, key: str = "domain", order: str = "event_id") -> DataFrame:
    """Requests with the number of failures in a row up to them, and the backoff min(factor ** n, cap) seconds (0 after success).

    Counted within chunks of a key; what a chunk ends with is carried to the next by its one-row summary.
    """
    rows = numbered(requests, key, order).withColumn("__chunk", F.floor((F.col("__n") - 1) / CHUNK))
    rows = rows.withColumn("__run", F.sum(F.col("success").cast("int")).over(Window.partitionBy(key, "__chunk").orderBy("__n")))
    inside = F.sum((~F.col("success")).cast("int")).over(Window.partitionBy(key, "__chunk", "__run").orderBy("__n"))
    rows = saved(rows.withColumn("__inside", inside.cast("long")), "requests-runs")
    ends = rows.groupBy(key, "__chunk").agg(F.max_by("__inside", "__n").alias("tail"), F.max(F.col("success").cast("int")).alias("any"))
    in_order = Window.partitionBy(key).orderBy("__chunk")
    ends = ends.withColumn("since", F.sum("any").over(in_order))
    ends = ends.withColumn("upto", F.sum("tail").over(Window.partitionBy(key, "since").orderBy("__chunk")))
    carried = F.coalesce(F.lag("upto").over(in_order), F.lit(0))
    ends = saved(ends.select(F.col(key).alias("__key"), F.col("__chunk").alias("__at"), carried.alias("__carried")), "requests-carried")
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__at")))
    rows = rows.withColumn("failures", (F.col("__inside") + F.when(F.col("__run") == 0, F.col("__carried")).otherwise(0)).cast("long"))
    backoff = F.when(F.col("failures") == 0, 0).otherwise(F.least(F.pow(F.lit(float(factor)), F.least("failures", F.lit(30))), F.lit(float(cap))))
    return rows.withColumn("backoff_seconds", backoff.cast("long")).select(*requests.columns, "failures", "backoff_seconds")


def recent_error_rate(requests: DataFrame, key: str = "domain", order: str = "event_id") -> DataFrame:
    """Requests with the error share of the last 10 and the mean response of the last 100 of their key.

    Windows are cut by key and chunk; a chunk takes the last 99 rows of the one before it along.
    """
    rows = numbered(requests, key, order).withColumn("__chunk", F.floor((F.col("__n") - 1) / CHUNK))
    last = F.pmod(F.col("__n") - 1, F.lit(CHUNK)) >= CHUNK - 99
    rows = rows.withColumn("__in", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("__chunk", F.col("__chunk") + F.col("__in"))
    w = Window.partitionBy(key, "__chunk").orderBy("__n")
    errors = F.avg((~F.col("success")).cast("double")).over(w.rowsBetween(-9, 0))
    rows = rows.withColumns({"error_rate_10": F.round(errors, 6), "mean_response_100": F.round(exact_mean("response_ms", w.rowsBetween(-99, 0)), 4)})
    return rows.where("__in = 0").select(*requests.columns, "error_rate_10", "mean_response_100")


def endpoint_stats(requests: DataFrame) -> DataFrame:
    """Per domain and endpoint: requests, success %, mean response of successes, state by severity."""
    rows = requests.groupBy("domain", "endpoint").agg(
        F.count("*").alias("requests"), F.count_if("success").alias("successes"), exact_avg(F.when(F.col("success"), F.col("response_ms"))).alias("mean")
    )
    failed = F.col("requests") - F.col("successes")
    state = F.when(failed >= 5, "blocked").when(failed >= 3, "failing").otherwise("active")
    return rows.select("domain", "endpoint", "requests", F.round(100.0 * F.col("successes") / F.col("requests"), 4).alias("success_pct"), F.round("mean", 4).alias("mean_response"), state.alias("state"))


def best_endpoint(stats: DataFrame) -> DataFrame:
    """Per domain the endpoint with the highest success %, then the shortest response, then the first name."""
    w = Window.partitionBy("domain").orderBy(F.col("success_pct").desc(), F.col("mean_response").asc_nulls_last(), "endpoint")
    return stats.withColumn("n", F.row_number().over(w)).where("n = 1").select("domain", "endpoint")
