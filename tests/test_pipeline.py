"""Report and error table of the record pipeline."""

from pyspark.sql import functions as F

from leadloom.plans import pipeline as P

COMPANIES = "id long, name string, website string, email string, phone string, description string, technologies array<string>"
CONTACTS = "id long, company_id long, first_name string, last_name string, email string, phone string, job_title string, linkedin_url string"


def frames(spark):
    companies = [(1, "Acme Inc", "https://acme.com", "info@acme.com", "+12125550100", "we sell", None), (2, "x", "no url", "bad", None, "", None), (3, "Zeta", None, None, "12", None, None), (4, "Acme Inc", "https://acme.com", "info@acme.com", "+12125550100", None, None)]
    contacts = [(1, 1, "Ann", "Lee", "ann@acme.com", None, "CEO", None), (2, 4, "Ann", "Lee", "ann@acme.com", None, None, None), (3, 3, "R2", "D2", "droid", None, None, "bad link")]
    return spark.createDataFrame(companies, COMPANIES), spark.createDataFrame(contacts, CONTACTS)


def test_report_counts_what_the_stages_wrote(spark):
    companies, contacts = frames(spark)
    kept, people, report, errors = P.run_with_errors(companies, contacts, P.Config(enrich=False, estimate=False, metric="levenshtein"))
    got = {r.stage: tuple(r)[1:] for r in report.collect()}
    assert got["validate:companies"] == (4, 4, 0, 4) and got["validate:contacts"] == (3, 3, 0, 3)
    assert got["dedup:companies"] == (4, 3, 1, 0) and got["dedup:contacts"] == (3, 2, 1, 0)
    assert kept.count() == 3 and {r.company_id for r in people.collect()} <= {r.id for r in kept.collect()}
    found = {(r.stage, r.id, r.field) for r in errors.collect()}
    want = {("companies", "2", "name"), ("companies", "2", "website"), ("companies", "2", "email"), ("companies", "3", "phone"), ("contacts", "3", "email"), ("contacts", "3", "contact_name"), ("contacts", "3", "linkedin_url")}
    assert {(f"validate:{t}", i, f) for t, i, f in want} == {x for x in found if x[0].startswith("validate")}
    assert errors.where("error is null or error = ''").count() == 0
    lost = {(i, f) for s, i, f in found if s.startswith("clean")}
    assert sum(v[3] for k, v in got.items() if k.startswith("clean")) == len(lost)


def test_strict_drops_and_still_lists_the_errors(spark):
    companies, contacts = frames(spark)
    kept, people, report, errors = P.run_with_errors(companies, contacts, P.Config(strict=True, clean=False, enrich=False, estimate=False, deduplicate=False))
    assert {r.id for r in kept.collect()} == {1, 4} and {r.id for r in people.collect()} == {1, 2}
    assert {r.stage: tuple(r)[1:] for r in report.collect()} == {"validate:companies": (4, 2, 2, 4), "validate:contacts": (3, 2, 1, 3)}
    assert {r.id for r in errors.collect()} == {"2", "3"} and not any(c.startswith("__") for c in kept.columns)


def test_no_rows_and_no_stages(spark):
    companies, contacts = (df.limit(0) for df in frames(spark))
    assert [tuple(r)[1:] for r in P.run_pipeline(companies, contacts, P.Config(enrich=False, estimate=False, deduplicate=False))[2].collect()] == [(0, 0, 0, 0)] * 4
    out = P.run_with_errors(*frames(spark), P.Config(validate=False, clean=False, enrich=False, estimate=False, deduplicate=False))
    assert out[2].count() == out[3].count() == 0 and out[0].count() == 4


def test_first_stage_counts_its_input_even_where_it_drops(spark):
    companies, contacts = frames(spark)
    report = P.run_pipeline(companies, contacts, P.Config(validate=False, clean=False, enrich=False, estimate=False, metric="levenshtein"))[2]
    assert {r.stage: (r.rows_in, r.rows_out) for r in report.collect()} == {"dedup:companies": (4, 3), "dedup:contacts": (3, 2)}
    assert report.where(F.col("dropped") != 1).count() == 0
