"""Every registered query of the lead engine against its SQL, on the smallest tables."""

import compare
import pytest

from leadloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, small, con):
    got, want = compare.rows_of(QUERIES[name](spark, small)), compare.oracle_rows(con, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0


def test_pipeline_merges_what_is_one(spark, small):
    """Of ten companies 3, 4, 5 and 6 are one, and 8 and 9; their contacts follow the one that stays, and the report counts the rest."""
    from leadloom.plans import pipeline as P
    from leadloom.plans.views import AS_OF, Tables

    t = Tables(spark, small)
    companies, contacts = t.linked_companies.where("id < 60"), t.contacts.where("company_id < 60")
    config = P.Config(enrich=False, estimate=False, metric="levenshtein", as_of=AS_OF)
    kept, people, report = P.run_pipeline(companies, contacts, config)
    ids = sorted(r.id for r in kept.collect())
    assert len(ids) == len(set(ids)) == 60 - 4 * 6
    assert all(sum(i in ids for i in range(10 * k + 3, 10 * k + 7)) == sum(i in ids for i in (10 * k + 8, 10 * k + 9)) == 1 for k in range(6))
    assert {10 * k + j for k in range(6) for j in (0, 1, 2, 7)} < set(ids)
    assert {r.company_id for r in people.collect()} <= set(ids)
    rows = {r.stage: (r.rows_in, r.rows_out, r.dropped) for r in report.collect()}
    assert rows["dedup:companies"] == (60, 36, 24) and rows["clean:companies"] == (60, 60, 0)
    assert rows["dedup:contacts"][1] == people.count()
