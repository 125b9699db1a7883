"""Stored tables: what a change touches, what it leaves, and what a failed one does."""

import glob

import pytest
from pyspark.sql import functions as F

from leadloom.operators import integrity as I
from leadloom.sources import rewrite as R

AS_OF = "2024-04-01 00:00:00"


def made(spark, path, n=200, parts=8):
    rows = spark.range(n).selectExpr("id", "concat('n', id) as name", "cast(null as timestamp_ntz) as updated_at", "timestamp_ntz'2024-03-31' - make_dt_interval(cast(id as int)) as at")
    R.store(rows, path, parts=parts)
    return path


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/part=*/*.parquet")}


def rows(spark, path):
    return {r.id: r.name for r in R.load(spark, path).collect()}


def test_untouched_parts_keep_their_files(spark, tmp_path):
    path = made(spark, f"{tmp_path}/t")
    before = files(path)
    out = R.upsert(spark, path, spark.createDataFrame([(3, "new"), (3, None), (900, "none"), (None, "x")], "id long, name string"), "id", AS_OF)
    after = files(path)
    assert (out["parts"], out["updated"], out["ignored"]) == (1, 1, 1) and out["rows_before"] == out["rows_after"]
    assert len(before) == len(after) == 8 and len(before.items() & after.items()) == 7
    assert rows(spark, path) == {k: "new" if k == 3 else f"n{k}" for k in range(200)}
    assert R.load(spark, path).where("updated_at is not null").count() == 1
    assert R.upsert(spark, path, spark.createDataFrame([(900, "none")], "id long, name string"), "id", AS_OF)["parts"] == 0 and files(path) == after


def test_last_update_of_a_key_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id long, p string, q int")
    updates = spark.createDataFrame([(1, "x", 7, 1), (1, "y", None, 3), (1, "z", 8, 2), (2, None, None, 1), (None, "no", 0, 1), (5, "no", 0, 1)], "id long, p string, q int, turn int")
    got = {r.id: (r.p, r.q, r.updated_at is not None) for r in I.upsert_rows(df, updates, "id", AS_OF, order="turn").collect()}
    assert got == {1: ("y", 8, True), 2: ("b", 2, True), None: ("c", 3, False)}
    plain = spark.createDataFrame([(1, "x"), (1, "y")], "id long, p string").coalesce(1)
    assert I.upsert_rows(df, plain, "id", AS_OF).where("id = 1").collect()[0].p == "y"


def test_deletes_count_rows_and_emptied_parts_go(spark, tmp_path):
    path = made(spark, f"{tmp_path}/t", n=10)
    twice = spark.createDataFrame([(4,), (4,), (77,), (None,)], "id long")
    assert R.delete(spark, path, twice)["deleted"] == 1 and set(rows(spark, path)) == set(range(10)) - {4}
    assert R.delete(spark, path, twice)["deleted"] == 0
    assert R.delete(spark, path, spark.range(1, 10))["deleted"] == 8 and set(rows(spark, path)) == {0}
    assert len(files(path)) == 1
    assert R.delete(spark, path, spark.range(10))["deleted"] == 1
    assert R.load(spark, path).count() == 0 and R.load(spark, path).columns == ["id", "name", "updated_at", "at"]
    assert R.delete(spark, path, spark.range(10))["parts"] == 0


def test_retention_and_archive(spark, tmp_path):
    path = made(spark, f"{tmp_path}/t", n=50)
    assert R.retain(spark, path, 10, "at", AS_OF)["deleted"] == 50 - 10 and R.retain(spark, path, 10, "at", AS_OF)["parts"] == 0
    assert R.retain(spark, path, 1, "at", AS_OF, "id = 5")["deleted"] == 1
    ids = spark.createDataFrame([(2,), (2,), (3,), (99,)], "id long")
    old = f"{tmp_path}/old"
    assert (out := R.archive(spark, path, old, ids, AS_OF))["archived"] == out["deleted"] == 2
    R.store(spark.range(2, 3).selectExpr("id", "'back' as name", "cast(null as timestamp_ntz) as updated_at", "cast(null as timestamp_ntz) as at"), f"{tmp_path}/u")
    assert R.archive(spark, f"{tmp_path}/u", old, ids, AS_OF)["deleted"] == 1  # the archive holds it already
    assert rows(spark, old) == {2: "n2", 3: "n3"} and set(rows(spark, path)) == {0, 1, 4, 6, 7, 8, 9}
    assert R.archive(spark, path, f"{tmp_path}/none", ids, AS_OF)["archived"] == 0


def test_failed_change_leaves_the_table(spark, tmp_path):
    path = made(spark, f"{tmp_path}/t")
    before = files(path)
    broken = lambda df: df.withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        R.rewrite(spark, path, spark.read.parquet(path).select("part"), broken)
    assert files(path) == before and rows(spark, path)[3] == "n3"
