"""Streams over event tables. Every ``stream_x`` is a transform that works on streaming and batch frames alike.

All state can be dropped: windows once the watermark (default 10 minutes behind the latest event) passes their end, a job's
state once the job has been idle for a while, ids once they are older than the watermark. Windows run in append mode: a result
is given out when it is final, and rows later than the watermark are left out and counted by Spark (``late_rows``). The three job
streams run in update mode: ``JobRuns`` holds one small state per job, gives out the job's progress with every trigger that has
events of it, and is dropped by a timer. Times are event times in ``ts``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from operator import attrgetter, itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.exact import exact_avg, rounded
from ..functions.graph import shared_dir
from ..operators import cleaning, scoring, validation

LATE = "10 minutes"
IDLE = "1 day"
TERMINAL = ("success", "failure")


def _timed(df: DataFrame, late: str = LATE) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


RUN = "run long, job_status string, done long, total long, top double, succeeded long, failed long, items long, start double, last double, ended boolean"
STATE = "run long, job_status string, done long, total long, top double, succeeded long, failed long, items long, start double, last double, latest long"
NAMES = [x.split()[0] for x in STATE.split(", ")]
EVENT = attrgetter("at", "event_id", "job_status", "current_items", "total_items")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobRuns(StatefulProcessor):
    """The current run of each job. A run ends where the job's next event is ``idle`` seconds or more away.

    Events of a trigger come sorted by time and id; events that come late, but before the watermark, count for the run that they
    fall into, and the state of a job that is as old as they may be. ``run`` is the id of the first event seen of a run, so updates
    of one run have one name. A timer set ``idle`` seconds after the last event drops the state and gives the run out as ended.
    """

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)

    def _row(self, key: tuple, s: dict, ended: bool) -> Row:
        return Row(job_id=key[0], **{n: v for n, v in s.items() if n != "latest"}, ended=ended)

    def _end(self, last: float) -> int:
        """When the timer of a run goes off whose last event was at ``last``."""
        return int((last + self.idle) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802,N803  names that Spark calls
        held = self.state.get()
        s = dict(zip(NAMES, held, strict=True)) if held else None
        before, out = s and s["last"], []
        # One sort and one pass over a job's events of a trigger; all its runs go out together.
        for at, event, status, done, total in sorted(map(EVENT, rows), key=itemgetter(0, 1)):
            if s and at - s["last"] >= self.idle:
                out.append(self._row(key, s, True))
                s = None
            alone = s is not None and s["start"] - at >= self.idle  # an older run, whose state is gone
            run = s if s and not alone else {"run": event, "job_status": None, "done": None, "total": None, "top": None, "succeeded": 0, "failed": 0, "items": 0, "start": at, "last": at, "latest": None}
            if run["latest"] is None or (at, event) >= (run["last"], run["latest"]):
                run |= {"job_status": status, "done": done, "total": total, "last": at, "latest": event}
            share = 100.0 * done / total if done is not None and total else None
            if share is not None and (run["top"] is None or share > run["top"]):
                run["top"] = share
            run["start"] = min(run["start"], at)
            run["succeeded"] += status == "success"
            run["failed"] += status == "failure"
            run["items"] += done or 0
            if alone:
                out.append(self._row(key, run, True))
            else:
                s = run
        self.state.update(tuple(s[n] for n in NAMES))
        if before != s["last"]:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(s["last"]))
        out.append(self._row(key, s, False))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802,N803
        held = self.state.get()
        if held:
            self.state.clear()
            yield self._row(key, dict(zip(NAMES, held, strict=True)), True)

    def close(self) -> None:
        pass


def seconds(idle: str) -> float:
    """Seconds of an interval such as ``1 day``."""
    number, unit = idle.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def job_runs(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """Runs of jobs: of a stream every change, in update mode (the session must keep state in RocksDB); of a batch the last state.

    ``job_id, run, job_status, done, total`` (of the latest event), ``top`` (highest percentage), ``succeeded, failed, items``,
    ``start, last`` (epoch seconds) and ``ended``. Events without a job or a time are left out.
    """
    at = events.where("job_id is not null and ts is not null")
    at = at.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.col("ts").cast("double"))
    kind = at.schema["job_id"].dataType.simpleString()
    if events.isStreaming:
        rows = at.withWatermark("ts", late).select("job_id", "event_id", "at", "ts", "job_status", "current_items", "total_items")
        return rows.groupBy("job_id").transformWithState(JobRuns(seconds(idle)), f"job_id {kind}, {RUN}", "Update", "EventTime")
    latest = F.struct("ts", "event_id")
    a = at.groupBy("job_id", F.session_window("ts", idle).alias("w")).agg(
        F.min_by("event_id", latest).cast("long").alias("run"), F.max_by("job_status", latest).alias("job_status"), F.max_by("current_items", latest).cast("long").alias("done"), F.max_by("total_items", latest).cast("long").alias("total"),
        F.max(F.when(F.col("total_items") != 0, 100.0 * F.col("current_items") / F.col("total_items"))).alias("top"), F.count_if(F.col("job_status") == "success").alias("succeeded"), F.count_if(F.col("job_status") == "failure").alias("failed"),
        F.coalesce(F.sum("current_items"), F.lit(0)).cast("long").alias("items"), F.min("at").alias("start"), F.max("at").alias("last"), F.max("at").alias("__last"),
    )
    return a.withColumn("ended", F.lit(False)).drop("w", "__last")


def last_updates(updates: DataFrame) -> DataFrame:
    """The last of the updates of each run, from a sink that keeps all of them with their ``batch``."""
    rest = [c for c in updates.columns if c not in ("job_id", "run", "batch")]
    order = F.struct("batch", "at") if "at" in rest else F.col("batch")
    return updates.groupBy("job_id", "run").agg(F.max_by(F.struct(*rest), order).alias("r")).select("job_id", "run", "r.*")


def _begun():
    return F.date_format(F.timestamp_seconds(F.floor("start")), "yyyy-MM-dd HH:mm:ss").alias("started")


def stream_job_progress(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """State of each run of a job as it goes on: ``job_id, run, started, job_status, percentage, elapsed, remaining, eta, at, ended``.

    ``elapsed`` and ``remaining`` are seconds, from the run's first event to its last (``at``), and in proportion to the items left.
    """
    elapsed = (F.floor("last") - F.floor("start")).cast("long")
    pct = F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(0.0)
    remaining = F.when(F.col("done") > 0, F.round(elapsed * (F.col("total") - F.col("done")) / F.col("done"), 3))
    rows = job_runs(events, idle, late).select("job_id", "run", _begun(), "job_status", F.round(pct, 4).alias("percentage"), elapsed.alias("elapsed"), remaining.alias("remaining"), F.col("last").alias("at"), "ended")
    return rows.withColumn("eta", F.date_format(F.timestamp_seconds(F.floor(F.floor("at") + F.col("remaining"))), "yyyy-MM-dd HH:mm:ss"))


def stream_lead_discovery(contacts: DataFrame, companies: DataFrame, as_of: str, least: float) -> DataFrame:
    """Contacts scored as they come, joined to the companies as they are, those from ``least`` % up, with an insight text."""
    s = F.col("score_percentage")
    note = F.when(s >= 80, "hot lead").when(s >= 60, "warm lead").otherwise("lead")
    scores = scoring.score_leads(contacts, companies, as_of).where(s >= least)
    return scores.select("contact_id", "company_id", s.alias("score"), "grade", F.concat_ws(": ", note, "factors.industry").alias("insight"))


def stream_job_completion(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """Per run of a job its terminal events so far: how many succeeded and failed, and items done."""
    rows = job_runs(events.where(F.col("job_status").isin(*TERMINAL)), idle, late)
    return rows.select("job_id", "run", _begun(), "succeeded", "failed", "items", F.col("last").alias("at"), "ended")


def stream_batch_progress(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """Highest percentage reached so far per run of a job."""
    return job_runs(events, idle, late).select("job_id", "run", _begun(), F.round("top", 4).alias("percentage"), F.col("last").alias("at"), "ended")


def stream_quality_alerts(records: DataFrame, window: str = "1 hour", limit: int = 5, late: str = LATE) -> DataFrame:
    """Windows with more than ``limit`` affected records (success is false)."""
    a = _timed(records, late).groupBy(F.window("ts", window).alias("w")).agg(F.count_if(~F.col("success")).alias("affected"))
    return a.where(F.col("affected") > limit).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "affected")


def stream_metric_windows(metrics: DataFrame, window: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Mean, peak and last value per metric and window."""
    a = _timed(metrics, late).groupBy("metric_name", F.window("ts", window).alias("w")).agg(rounded(exact_avg("metric_value"), 4).alias("mean"), F.max("metric_value").alias("peak"), F.max_by("metric_value", F.struct("ts", "event_id")).alias("last"))
    return a.select("metric_name", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "mean", "peak", "last")


def stream_threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose metric meets a rule of ``rules(metric_name, op, threshold)``; the rule table is the caller's and small, Spark sizes the join."""
    v, t = F.col("metric_value"), F.col("threshold")
    met = F.when(F.col("op") == "gt", v > t).when(F.col("op") == "gte", v >= t).when(F.col("op") == "lt", v < t).when(F.col("op") == "lte", v <= t).when(F.col("op") == "eq", v == t)
    return metrics.join(rules, "metric_name").where(met).select("event_id", "metric_name", "op", "threshold", "metric_value")


def stream_request_windows(requests: DataFrame, limit: int, window: str = "1 minute", slide: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Requests per client in sliding windows, and if they are over the limit."""
    a = _timed(requests, late).groupBy("client_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("requests"))
    return a.select("client_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit"))


def stream_unprocessed(scraped: DataFrame, late: str = LATE) -> DataFrame:
    """New scraped rows, each id once, put through validation, cleaning and scoring.

    Name and phone are read from the raw JSON; the phone is checked, the name cleaned, and the score is the share of contact
    completeness that they give. A repeated id is left out if it comes within ``late`` of the first.
    """
    rows = scraped.where(~F.col("is_processed")).withColumn("ts", F.col("scraped_at").cast("timestamp")).withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["id"]) if scraped.isStreaming else rows.dropDuplicates(["id"])
    rows = rows.select("id", F.get_json_object("raw_data", "$.name").alias("name"), F.get_json_object("raw_data", "$.phone").alias("phone"))
    rows = cleaning.clean_company_names(validation.validate_phones(rows, "phone"))
    rows = rows.withColumns({"full_name": F.col("name_clean.value"), "phone_digits": F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""))})
    rows = scoring.with_columns(rows, **dict.fromkeys(("email", "job_title", "linkedin_url", "department", "contact_location", "bio"), "string"))
    score = F.round(F.expr(scoring.category_sql("contact_completeness")), 6)
    return rows.select("id", F.col("full_name").alias("name"), F.col("phone_check.normalized").alias("phone"), F.col("phone_check.status").alias("phone_status"), score.alias("score"))


def late_rows(query) -> int:
    """Rows that a stream left out because they came after the watermark (for grouped state, after Spark's partial grouping)."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def run_files(folder: str, schema, spark: SparkSession, make: Callable[[DataFrame], DataFrame], mode: str = "append", each: int | None = 1):
    """Run ``make`` over the Parquet files of ``folder/in``, ``each`` a trigger (all, if None) in order of arrival, until all are read.

    Gives the sink's rows and the finished query. The sink and the checkpoint are in the same shared folder, so a run that is
    started again goes on where it stopped. In update mode the sink keeps every update, with the number of its ``batch``; a
    batch that is run again replaces its own rows.
    """
    if mode == "update":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reader = spark.readStream.schema(schema)
    made = make((reader if each is None else reader.option("maxFilesPerTrigger", each)).parquet(f"{folder}/in"))
    writer = made.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out" + (f"/batch={k}" if mode == "update" else ""))).start()
    query.awaitTermination()
    schema = made.schema if mode != "update" else made.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/out"), query


def run_to_end(source: DataFrame, make: Callable[[DataFrame], DataFrame], time: str = "ts", parts: int = 2, mode: str = "append") -> DataFrame:
    """Put ``source`` through a stream: its rows in ``parts`` parts in order of ``time``, one a trigger; the sink's rows.

    A part is as many files as Spark writes. They all come in one trigger, as each of them holds rows of all the part's time: were
    they read one by one, the first would set the watermark past the rows of the others.
    """
    spark = source.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    at = F.col(time).cast("timestamp").cast("double")
    lo, hi = source.agg(F.min(at), F.max(at)).first()
    share = F.lit(0) if lo is None else F.least(F.floor((at - F.lit(lo)) * parts / F.lit(max(hi - lo, 1e-6))), F.lit(parts - 1))
    dealt = source.withColumn("__part", F.coalesce(share, F.lit(0)))
    for k in range(parts):  # one after the other; the stream goes on where it stopped
        dealt.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(f"{folder}/in")
        rows = run_files(folder, source.schema, spark, make, mode, each=None)[0]
    return rows
