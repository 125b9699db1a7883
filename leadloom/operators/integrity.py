"""Integrity checks and table maintenance: every operator returns the rows that remain or offend; ``sources.rewrite`` applies them to stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def constraint_violations(df: DataFrame, rules: dict[str, str], key: str = "id") -> DataFrame:
    """``(id, rule)`` for each rule (a SQL condition that must not be false) that a row breaks; null passes, as for CHECK."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(test), F.lit(name)) for name, test in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def orphan_rows(child: DataFrame, parent: DataFrame, on: str, key: str = "id") -> DataFrame:
    """Rows whose reference is set but has no parent."""
    ids = parent.select(F.col(key).alias("__parent"))
    return child.where(F.col(on).isNotNull()).join(ids, F.col(on) == F.col("__parent"), "left_anti")


def cascade_delete(parent_ids: DataFrame, child: DataFrame, on: str, mode: str = "cascade") -> DataFrame:
    """Child rows after the parents in ``parent_ids(id)`` are gone: dropped, or with the reference nulled (mode 'set_null')."""
    gone = parent_ids.select(F.col("id").alias("__gone")).distinct()
    if mode == "cascade":
        return child.join(gone, F.col(on) == F.col("__gone"), "left_anti")
    out = child.join(gone, F.col(on) == F.col("__gone"), "left")
    return out.withColumn(on, F.when(F.col("__gone").isNull(), F.col(on))).drop("__gone")


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the columns, none null, that occur more than once, with their count."""
    set_ = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(set_).groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def append_stamped(df: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Rows of both; new ones get created_at and updated_at where they have none."""
    fill = {c: F.coalesce(F.col(c), stamp(as_of)) if c in new.columns else stamp(as_of) for c in ("created_at", "updated_at")}
    return df.unionByName(new.withColumns(fill), allowMissingColumns=True)


def last_updates(updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: of each column the last value that is not null.

    The last is that with the greatest ``order``; without a column for it, by the order in which Spark reads the rows (files and
    rows in files). Updates without a key are left out.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = updates.withColumn("__at", at).where(F.col(key).isNotNull())
    values = [c for c in updates.columns if c not in (key, order)]
    if not values:
        return rows.select(key).distinct()
    return rows.groupBy(key).agg(*[F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("__at")))[c].alias(c) for c in values])


def upsert_rows(df: DataFrame, updates: DataFrame, key: str, as_of: str, order: str | None = None) -> DataFrame:
    """Partial updates by key: non-null values replace, matched rows get updated_at; updates without a row are ignored.

    Of several updates of one key the last value of each column counts (``last_updates``), so no row is repeated.
    """
    updates = last_updates(updates, key, order)
    values = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__hit"))
    rows = df.join(new, F.col(key) == F.col("__key"), "left")
    out = {c: F.coalesce(f"__{c}", c) for c in values}
    old = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    out["updated_at"] = F.when(F.col("__hit"), stamp(as_of)).otherwise(old)
    return rows.withColumns(out).drop("__key", "__hit", *[f"__{c}" for c in values])


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def retention(df: DataFrame, days: float, column: str, as_of: str, terminal: Column | None = None) -> DataFrame:
    """Rows no older than ``days``; with ``terminal`` only rows that it marks can go. Rows without a time stay."""
    old = F.col(column) < stamp(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0).cast("decimal(18,6)"))
    return df.where(~F.coalesce(old & (terminal if terminal is not None else F.lit(True)), F.lit(False)))


def archive_split(df: DataFrame, ids: DataFrame, as_of: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Archived rows with ``archived_at``, and the remaining rows."""
    at = ids.select(F.col("id").alias("__gone")).distinct()
    on = F.col(key) == F.col("__gone")
    return df.join(at, on, "left_semi").withColumn("archived_at", stamp(as_of)), df.join(at, on, "left_anti")


def batch_status_update(df: DataFrame, targets: DataFrame, values: dict[str, str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``df`` with the values set on target rows, and ``(id, outcome)`` per target: updated or not_found."""
    ids = targets.select(F.col("id").alias("__target")).distinct()
    rows = df.join(ids, F.col(key) == F.col("__target"), "left")
    hit = F.col("__target").isNotNull()
    out = rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("__target")
    known = df.select(F.col(key).alias("__known")).distinct()
    outcome = ids.join(known, F.col("__target") == F.col("__known"), "left").select(F.col("__target").alias("id"), F.when(F.col("__known").isNull(), "not_found").otherwise("updated").alias("outcome"))
    return out, outcome


def table_stats(tables: dict[str, DataFrame], as_of: str, column: str = "created_at") -> DataFrame:
    """Per table: rows, rows of the last 7 days, and growth % of these over the rows before."""
    week = F.col(column) >= stamp(as_of) - F.expr("INTERVAL 7 DAYS")

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(F.count("*").alias("total"), F.count_if(week).alias("recent"))
        before = F.col("total") - F.col("recent")
        return counts.select(F.lit(name).alias("table"), "total", "recent", F.round(F.when(before > 0, 100.0 * F.col("recent") / before).otherwise(0.0), 4).alias("growth_pct"))

    return reduce(lambda a, b: a.unionByName(b), [one(n, d) for n, d in tables.items()])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in tables.items()])


def table_advice(stats: DataFrame, large: int = 10_000, fast: float = 50.0) -> DataFrame:
    """Suggestions per table from its size and growth."""
    tips = F.array_compact(F.array(
        F.when(F.col("total") > large, "partition by month"),
        F.when(F.col("growth_pct") > fast, "plan for growth"),
        F.when((F.col("total") > 0) & (F.col("recent") == 0), "archive old rows"),
    ))
    return stats.select("table", F.explode(tips).alias("advice"))


