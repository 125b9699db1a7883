"""Searches from a stored index against scans, and what they read."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import select as S
from leadloom.sources import grams as G

TERMS = {"": (1,), "ab": (1, 3), "ABC": (3,), ".com": (1, 99), "acme 10 é": (1, 2), "zzz": (1,), "100%": (1,), "\\": (3,), "Acme 499": (1, 3, 6), "e 4": (1, 3)}


@pytest.fixture(scope="module")
def companies(spark):
    """Names of which all share grams, some null or short, a tenant with a third of all rows, and rows without tenant or key."""
    name = F.expr("case id % 11 when 0 then null when 1 then 'ab' when 2 then '' when 3 then concat('ABC \\\\ 100% ', id) else concat('Acme ', id, if(id % 5 = 0, ' É', '')) end")
    site = F.expr("if(id % 4 = 0, null, concat('https://www.Site', id, '.com/x'))")
    tenant = F.expr("case when id % 3 = 0 then 1 when id % 50 = 1 then null else 2 + id % 5 end").cast("long")
    rows = spark.range(600).select(F.when(F.col("id") % 97 != 5, F.col("id")).alias("id"), name.alias("name"), site.alias("website"), tenant.alias("created_by"), F.lit("own").alias("gram"))
    return rows.union(rows.where("id < 20"))


def test_hits_are_those_of_a_scan(spark, companies):
    index = G.index_companies(companies, parts=5)
    for term, users in TERMS.items():
        for user in users:
            want = sorted(map(tuple, S.search_companies(companies, user, term).collect()), key=repr)
            got = G.search_companies(spark, index, user, term)
            assert got.columns == companies.columns and sorted(map(tuple, got.collect()), key=repr) == want, (term, user)
    again = G.opened(spark, index.path, companies.schema)
    assert again == index


@pytest.mark.parametrize("limit", [0, 1000])
def test_many_hits_are_found_without_pushed_keys(spark, companies, monkeypatch, limit):
    monkeypatch.setattr(G, "PUSHED_KEYS", limit)
    index = G.index_companies(companies, parts=3)
    assert sorted(map(tuple, G.search_companies(spark, index, 1, "acme").collect()), key=repr) == sorted(map(tuple, S.search_companies(companies, 1, "acme").collect()), key=repr)


def test_contacts_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "Ann", "Lee", "ann@x.org", 1), (2, None, "Lee", None, 1), (3, "Leeann", None, "q@lee.org", 2), (4, "Bo", "Ek", "bo@leeward.com", 1)], "id long, first_name string, last_name string, email string, created_by long")
    index = G.index_contacts(rows, parts=2)
    for term in ("lee", "LEE", "ann@", "bo", "o@l", "nn@x.o"):
        for user in (1, 2):
            assert sorted(r.id for r in G.search_contacts(spark, index, user, term).collect()) == sorted(r.id for r in S.search_contacts(rows, user, term).collect())
    empty = G.index_contacts(rows.limit(0))
    assert G.search_contacts(spark, empty, 1, "lee").count() == 0 and G.search_contacts(spark, empty, 1, "l").count() == 0


def read_by(df):
    """Files and bytes that a query's scan opens."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    scan = plan.executedPlan().collectLeaves().apply(0).metrics()
    return [scan.get(m).get().value() for m in ("numFiles", "filesSize")]


def test_a_rare_term_reads_a_small_part(spark, capsys):
    """Of 20 ranges of one tenant's rows one is opened; the places of a gram that all rows hold are spread over ranges."""
    rows = spark.range(40_000).select("id", F.concat(F.lit("company "), F.sha2(F.col("id").cast("string"), 256)).alias("name"), F.concat(F.lit("https://www.s"), "id", F.lit(".com")).alias("website"), F.lit(1).cast("long").alias("created_by"))
    index = G.index_companies(rows, parts=20)
    needle = rows.where("id = 31234").first().name[20:40]
    found, scan = G.search_companies(spark, index, 1, needle), S.search_companies(spark.read.parquet(f"{index.path}/rows"), 1, needle)
    assert [r.id for r in found.collect()] == [r.id for r in scan.collect()] == [31234]
    (files, size), (all_files, all_size) = read_by(found), read_by(scan)
    with capsys.disabled():
        print(f"\nsearch from the index: {size} of {all_size} bytes")
    assert all_files >= 15 and files == 1 and size * 10 < all_size
    assert len(index.ranges(G.POSTINGS, [needle[:3]])) == 1
    hot = G.build(rows.withColumn("name", F.lit("Hot")), [F.lower("name")], parts=4)
    assert len(hot.ranges(G.POSTINGS, ["hot"])) == 4 and len(hot.ranges(G.COUNTS, ["hot"])) == 1
