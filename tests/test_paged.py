"""Pages from an order index against sorting everything, and typed CSV."""

from pyspark.sql import functions as F

from leadloom.operators import select as S
from leadloom.sources import paged as P
from leadloom.sources import tables as T


def test_pages_equal_a_sort_of_the_table(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(9))).alias("v"), F.lit("hot").alias("w"))
    for column, descending in (("v", False), ("v", True), ("w", False)):
        index = P.ordered(df, column, descending, parts=6)
        assert sum(index.counts) == 500 and len(index.counts) > 3
        every = df.orderBy(*index.order()).collect()
        for number, size in ((1, 10), (3, 70), (8, 70), (9, 70), (1, 1000), (50, 10), (51, 10)):
            rows, info = P.page(spark, index, df.schema, number, size)
            assert rows.collect() == every[(number - 1) * size : number * size]
            assert info.collect() == S.page(df, number, size)[1].collect()
    small = P.page(spark, index, df.schema, 2, 20)[0]
    assert len({f.split("__part=")[1][0] for f in small.inputFiles()}) <= 6 and "__part" in small._jdf.queryExecution().executedPlan().toString()
    assert len(index.parts_of(20, 20)) <= 2


def test_index_of_an_empty_table(spark):
    df = spark.range(0)
    rows, info = P.page(spark, P.ordered(df, "id"), df.schema, 1, 10)
    assert rows.count() == 0 and info.collect()[0].total == 0


def test_csv_comes_in_its_types(spark, tmp_path):
    spark.createDataFrame([("7", 'a "quoted", name', "12", "x", '{"city":"Rome"}', '["a","b"]', "more")], "id string, name string, employee_count string, lead_score string, location string, technology_stack string, extra string").write.option("header", True).option("escape", '"').csv(f"{tmp_path}/companies.csv")
    row = T.read_tables(spark, str(tmp_path), "csv", ("companies",))["companies"].first()
    assert (row.name, row.employee_count, row.lead_score, row.location.city, row.technology_stack, row.extra, row.website) == ('a "quoted", name', 12, None, "Rome", ["a", "b"], "more", None)
    spark.range(2).selectExpr("id", "'x' as y").write.option("header", True).csv(f"{tmp_path}/other.csv")
    assert sorted(r.id for r in T.read_tables(spark, str(tmp_path), "csv", ("other",))["other"].collect()) == ["0", "1"]
