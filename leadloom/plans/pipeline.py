"""The record pipeline: validate, clean, enrich, deduplicate, estimate, finalise, as chained transforms."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exact import filled
from ..functions.graph import saved
from ..operators import cleaning, dedup, enrichment, estimation, validation
from ..operators.select import contact_company_by_name


@dataclass(frozen=True)
class Config:
    """Stages to run, and their options."""

    validate: bool = True
    strict: bool = False
    clean: bool = True
    enrich: bool = True
    deduplicate: bool = True
    estimate: bool = True
    metric: str = "ratio"
    as_of: str | None = None
    version: str = "1.0"


PRESETS = {"default": Config(), "fast": Config(enrich=False, estimate=False, metric="levenshtein"), "comprehensive": Config(strict=True)}


def finalize_records(df: DataFrame, version: str, config: dict, as_of: str | None) -> DataFrame:
    """``df`` with ``processing`` struct(version, config, processed_at)."""
    return df.withColumn("processing", F.struct(F.lit(version).alias("version"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.lit(as_of).cast("timestamp_ntz").alias("processed_at")))


ERRORS = "array<struct<field:string,error:string>>"
REPORT = "stage string, rows_in long, rows_out long, dropped long, errors long"


def _validated(df: DataFrame, strict: bool) -> DataFrame:
    """All rows with ``validation``, the errors of their given fields, and if they stay; strict keeps rows without errors."""
    made = validation.validate_records(df)
    fields = validation.checked_fields(df)
    given = {k: F.col(k).isNotNull() if k in df.columns else F.lit(True) for k in fields}
    found = [F.when(~F.col("validation")[k]["is_valid"] & given[k], F.struct(F.lit(k).alias("field"), F.coalesce(F.element_at(F.col("validation")[k]["errors"], 1), F.col("validation")[k]["status"]).alias("error"))) for k in fields]
    made = made.withColumn("__errors", F.array_compact(F.array(*found)).cast(ERRORS))
    return made.withColumn("__stays", F.lit(True) if not strict else F.size("__errors") == 0)


def _cleaned(df: DataFrame, job) -> DataFrame:
    """The job's rows, and as errors the fields whose value it could not keep."""
    fields = [c for c in df.columns if c in ("name", "email", "phone", "website", "address", "description", "first_name", "last_name", "linkedin_url", "job_title")]
    made = job(df.withColumns({f"__was_{c}": filled(c) for c in fields}))
    lost = [F.when(F.col(f"__was_{c}") & ~filled(c), F.struct(F.lit(c).alias("field"), F.coalesce(F.array_join(F.col("cleaning")[c]["changes"], "; "), F.lit("no value left")).alias("error"))) for c in fields]
    return made.withColumn("__errors", F.array_compact(F.array(*lost)).cast(ERRORS)).drop(*[f"__was_{c}" for c in fields])


def run_pipeline(companies: DataFrame, contacts: DataFrame, config: Config | str = "default") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``companies, contacts, report``; see ``run_with_errors``."""
    return run_with_errors(companies, contacts, config)[:3]


def run_with_errors(companies: DataFrame, contacts: DataFrame, config: Config | str = "default") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``companies, contacts, report, errors``; each stage is saved.

    ``report(stage, rows_in, rows_out, dropped, errors)`` is counted by the writes of the stages themselves, which are observed, so no
    row is read again for it; rows in are those that the stage before gave out. ``errors(stage, id, field, error)`` lists
    what validation found wrong in given fields, in strict mode of dropped rows too, and values that cleaning could not keep.
    """
    config = PRESETS[config] if isinstance(config, str) else config
    spark = companies.sparkSession
    now, known, rows, errors = {"companies": companies, "contacts": contacts}, {}, [], []

    def step(name: str, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        first = None
        source = now[table]
        if table not in known:
            first = Observation(f"in-{uuid.uuid4().hex}")
            source = source.observe(first, F.count("*").alias("n"))
        made = make(source)
        given = {"__errors": F.array().cast(ERRORS), "__stays": F.lit(True)}
        made = made.withColumns({c: v for c, v in given.items() if c not in made.columns})
        seen = Observation(f"out-{uuid.uuid4().hex}")
        made = saved(made.observe(seen, F.count_if(F.col("__stays")).alias("n"), F.sum(F.size("__errors")).alias("errors")), f"{name}-{table}")
        before = known.get(table) if first is None else first.get["n"]
        known[table] = seen.get["n"]
        rows.append((f"{name}:{table}", before, known[table], before - known[table], seen.get["errors"] or 0))
        errors.append(made.select(F.lit(f"{name}:{table}").alias("stage"), F.col("id").cast("string").alias("id"), F.inline("__errors")))
        now[table] = made.where("__stays").drop("__errors", "__stays")

    if config.validate:
        step("validate", "companies", lambda df: _validated(df, config.strict))
        step("validate", "contacts", lambda df: _validated(df, config.strict))
    if config.clean:
        step("clean", "companies", lambda df: _cleaned(df, cleaning.clean_companies))
        step("clean", "contacts", lambda df: _cleaned(df, cleaning.clean_contacts))
    if config.enrich:
        step("enrich", "companies", enrichment.enrich_companies)
        step("enrich", "contacts", enrichment.enrich_contacts)
    if config.deduplicate:
        c, k = now["companies"], now["contacts"]
        groups = saved(dedup.duplicate_groups(c, dedup.company_matches(c, metric=config.metric, least="high")), "groups")
        people = saved(dedup.duplicate_groups(k, dedup.contact_matches(k, metric=config.metric, least="high")), "people")
        # Contacts of a merged company follow it to the one that stays.
        kept = dedup.merge_most_complete(c, groups).select("group_id", F.col("id").alias("__kept"))
        moved = saved(groups.join(kept, "group_id").select(F.col("id").alias("__company"), "__kept"), "moved")

        def merged(df: DataFrame) -> DataFrame:
            one = dedup.merge_most_complete(df, people, dedup.CONTACT_FIELDS).drop("group_id").join(moved, F.col("company_id") == F.col("__company"), "left")
            return one.withColumn("company_id", F.coalesce("__kept", "company_id")).drop("__company", "__kept")

        step("dedup", "companies", lambda df: dedup.merge_most_complete(df, groups).drop("group_id"))
        step("dedup", "contacts", merged)
    if config.estimate:
        step("estimate", "companies", estimation.estimate_companies)
        step("estimate", "contacts", lambda df: estimation.estimate_contact_value(df, now["companies"]))
    options = asdict(replace(config, as_of=None))
    done = {t: finalize_records(df, config.version, options, config.as_of) for t, df in now.items()}
    none = spark.createDataFrame([], "stage string, id string, field string, error string")
    return done["companies"], done["contacts"], spark.createDataFrame(rows, REPORT), reduce(DataFrame.union, errors, none)


def link_by_name(contacts: DataFrame, companies: DataFrame, name: str = "company_name") -> DataFrame:
    """Contacts with company_id from the company of equal name where they have none."""
    rows = contact_company_by_name(contacts, companies, name)
    return rows.withColumn("company_id", F.coalesce("company_id", "company.id")).drop("company")
