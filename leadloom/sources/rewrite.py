"""Tables of Parquet files that are changed in place, part by part.

A stored table is a folder with one sub-folder per part; a row's part is a hash of its key, so the rows of a key are in one part.
A change finds the parts that it touches by reading keys only, works out their new rows in a stage of its own, and then replaces
these parts through Spark's dynamic partition overwrite, which writes aside first and swaps folders when all tasks are done. Other
parts keep their files. A change that fails before the swap leaves the table as it was; one that is run again after it gives the
same table. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import saved
from ..operators import integrity

PART = "part"
PARTS = 64


def store(df: DataFrame, path: str, key: str = "id", parts: int = PARTS) -> None:
    """Write ``df`` as a table of ``parts`` parts by hash of ``key``; rows without a key are in part 0.

    A table has ``updated_at`` from the beginning, so that files written later have the same columns.
    """
    df = df if "updated_at" in df.columns else df.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    part = F.coalesce(F.pmod(F.xxhash64(key), F.lit(parts)), F.lit(0)).cast("int")
    df.withColumn(PART, F.when(F.col(key).isNull(), 0).otherwise(part)).repartition(PART).write.partitionBy(PART).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table."""
    return _with_parts(spark, path).drop(PART)


def _with_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _remove(spark: SparkSession, path: str, parts: set[int]) -> None:
    """Drop the folders of parts that have no rows left."""
    for part in sorted(parts):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rewrite(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Put ``change`` through the parts in ``touched(part)`` and swap them; ``parts, rows_before, rows_after`` of these.

    ``change`` gets the rows of the touched parts and returns them with the same columns, which may be more or fewer; rows stay
    in their part. If no row of the table is left, an empty file keeps its columns.
    """
    parts = sorted(r[0] for r in touched.select(PART).distinct().collect())  # at most as many as the table has parts
    if not parts:
        return {"parts": 0, "rows_before": 0, "rows_after": 0}
    table = _with_parts(spark, path)
    old = table.where(F.col(PART).isin(parts))
    new = saved(change(old), "rewritten")
    counts = {r[0]: r[1] for r in new.groupBy(PART).count().collect()}
    before = old.count()
    emptied = set(parts) - counts.keys()
    if counts:
        new.repartition(PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif table.where(~F.col(PART).isin(parts)).isEmpty():
        emptied.remove(parts[0])
        spark.createDataFrame([], new.drop(PART).schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{PART}={parts[0]}")
    _remove(spark, path, emptied)
    return {"parts": len(parts), "rows_before": before, "rows_after": sum(counts.values())}


def _touched(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Parts that hold one of ``keys(__key)``; reads keys only."""
    return _with_parts(spark, path).select(PART, key).join(keys, F.col(key) == F.col("__key"), "left_semi").select(PART)


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, as_of: str, order: str | None = None) -> dict[str, int]:
    """Update rows of a stored table (see ``integrity.upsert_rows``); ``updated`` and ``ignored`` keys besides the counts.

    Columns of the table that no update names stay.
    """
    last = saved(integrity.last_updates(updates, key, order), "last-updates")
    keys = last.select(F.col(key).alias("__key"))
    hit = saved(_with_parts(spark, path).select(PART, key).join(keys, F.col(key) == F.col("__key"), "left_semi"), "hit")
    n_hit, n_all = hit.select(key).distinct().count(), last.count()

    def change(rows: DataFrame) -> DataFrame:
        out = integrity.upsert_rows(rows, last, key, as_of)
        return out.select(*[c for c in out.columns if c != PART], PART)

    return rewrite(spark, path, hit, change) | {"updated": n_hit, "ignored": n_all - n_hit}


def delete(spark: SparkSession, path: str, ids: DataFrame, key: str = "id") -> dict[str, int]:
    """Delete rows by ``ids(id)``; ``deleted`` rows besides the counts."""
    gone = saved(ids.select(F.col("id").alias("__key")).where("__key is not null").distinct(), "gone")
    out = rewrite(spark, path, _touched(spark, path, gone, key), lambda rows: integrity.delete_by_ids(rows, gone.select(F.col("__key").alias("id")), key))
    return out | {"deleted": out["rows_before"] - out["rows_after"]}


def retain(spark: SparkSession, path: str, days: float, column: str, as_of: str, terminal: str | None = None) -> dict[str, int]:
    """Delete rows older than ``days`` (see ``integrity.retention``); ``terminal`` is a condition in SQL."""
    rule = lambda rows: integrity.retention(rows, days, column, as_of, None if terminal is None else F.expr(terminal))
    table = _with_parts(spark, path)
    old = table.groupBy(PART).count().join(rule(table).groupBy(PART).agg(F.count("*").alias("kept")), PART, "left").where(F.col("count") > F.coalesce("kept", F.lit(0)))
    out = rewrite(spark, path, saved(old.select(PART), "old"), rule)
    return out | {"deleted": out["rows_before"] - out["rows_after"]}


def archive(spark: SparkSession, path: str, archive_path: str, ids: DataFrame, as_of: str, key: str = "id") -> dict[str, int]:
    """Move rows to a second table, which gets ``archived_at``: they are appended there first and then deleted here.

    A run that stopped between the two is mended by running it again: rows whose key the archive holds are not appended twice.
    """
    gone = saved(ids.select("id").where("id is not null").distinct(), "gone")
    moved, _ = integrity.archive_split(load(spark, path), gone, as_of, key)
    moved = saved(moved, "moved")
    n = moved.count()
    if n:
        try:
            held = load(spark, archive_path).select(F.col(key).alias("__held"))
            moved = moved.join(held, F.col(key) == F.col("__held"), "left_anti")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        moved.withColumn(PART, part).repartition(PART).write.mode("append").partitionBy(PART).parquet(archive_path)
    return delete(spark, path, gone, key) | {"archived": n}
