"""Lead tables derived from the base tables, by formulas that Spark and DuckDB read alike.

Every view is one select over a base table; the same text makes the Spark DataFrame and the SQL of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of all time-relative queries.
AS_OF = "2024-04-01 00:00:00"

SOURCES = {
    "companies": "customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "contacts": "orders",
    "scraping_jobs": "part",
    "scraped_data": "lineitem",
    "data_exports": "supplier",
    "event_log": "events",
}

FORMULAS = {
    "companies": {
        "id": 'c_custkey',
        "created_by": 'c_custkey % 7',
        "name": "CASE c_custkey % 5 WHEN 4 THEN concat('globex ', c_custkey-1, ' corporation') WHEN 3 THEN concat('Globex ', c_custkey, ' Corp') WHEN 2 THEN concat('the ACME ', c_custkey, ' acme llc') ELSE concat('Initech ', c_custkey, ' Inc.') END",
        "website": "CASE c_custkey % 5 WHEN 4 THEN concat('http://www.globex', c_custkey-1, '.com/') WHEN 3 THEN concat('globex', c_custkey, '.com') WHEN 0 THEN NULL ELSE concat('https://site', c_custkey, '.example.org/about/?q=1') END",
        "email": "CASE c_custkey % 6 WHEN 0 THEN concat('info@site', c_custkey, '.example.org') WHEN 1 THEN concat(' Sales.', c_custkey, '@Gmail.com ') WHEN 2 THEN concat('x', c_custkey, '@mailinator.com') WHEN 3 THEN 'not-an-email' WHEN 4 THEN NULL ELSE concat('jo', c_custkey, '@corp', c_custkey % 20, '.com') END",
        "phone": "CASE c_custkey % 4 WHEN 0 THEN concat('(212) ', 2000000 + c_custkey) WHEN 1 THEN concat('+1-212-', 2000000 + c_custkey) WHEN 2 THEN concat('1212', 2000000 + c_custkey) ELSE NULL END",
        "industry": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automotive' WHEN 'BUILDING' THEN 'Software Development' WHEN 'FURNITURE' THEN 'Retail' WHEN 'HOUSEHOLD' THEN NULL ELSE 'Finance' END",
        "employee_count": 'CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 1500 + 1 AS INT) END',
        "previous_employee_count": 'CAST((c_custkey * 29) % 1400 + 1 AS INT)',
        "company_size": "CASE c_custkey % 6 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' WHEN 3 THEN '201-500' WHEN 4 THEN '500+' ELSE NULL END",
        "revenue_range": "CASE c_custkey % 5 WHEN 0 THEN '$1M-$10M' WHEN 1 THEN '$10M-$50M' WHEN 2 THEN '50 million' WHEN 3 THEN '2 billion' ELSE NULL END",
        "founded_year": 'CAST(1980 + c_custkey % 44 AS INT)',
        "technologies_csv": "CASE c_custkey % 6 WHEN 0 THEN 'Python,React,AWS,Docker,Kubernetes' WHEN 1 THEN 'PHP,MySQL,jQuery' WHEN 2 THEN 'Rust,Svelte' WHEN 3 THEN 'WordPress' WHEN 4 THEN 'Flash,Oracle,Salesforce' ELSE NULL END",
        "description": "CASE c_custkey % 8 WHEN 0 THEN 'We are hiring 20 engineers and opening in Berlin. Series B funding closed.' WHEN 1 THEN 'Scaling challenges and legacy systems slow our growth.' WHEN 2 THEN 'Competitor Initrode is the market leader in global software.' WHEN 3 THEN 'A small family store. See https://twitter.com/acme_1' WHEN 4 THEN 'New product launch, partnership with Hooli.' WHEN 5 THEN 'Security concerns, data silos and downtime.' WHEN 6 THEN '' ELSE NULL END",
        "city": 'n_name',
        "state": "concat('R', n_regionkey)",
        "country": "'USA'",
        "lead_score": 'CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 53) % 1001 AS DOUBLE) / 10 END',
        "data_quality_score": 'CAST((c_custkey * 17) % 101 AS DOUBLE) / 100',
        "created_at": "CAST(DATE '2024-01-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP)",
    },
    "contacts": {
        "id": 'o_orderkey',
        "company_id": 'o_custkey',
        "created_by": 'o_custkey % 7',
        "first_name": "CASE o_orderkey % 5 WHEN 0 THEN 'Mary' WHEN 1 THEN 'john' WHEN 2 THEN 'ALEX' WHEN 3 THEN 'Sam' ELSE 'Dr. Kim' END",
        "last_name": "concat('Lee', o_orderkey - CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END)",
        "email": "CASE o_orderkey % 6 WHEN 5 THEN concat('Lee', o_orderkey-1, '@corp', o_custkey % 20, '.com') WHEN 0 THEN NULL ELSE concat('lee', o_orderkey, '@corp', o_custkey % 20, '.com') END",
        "phone": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE concat('+1212', 2000000 + o_orderkey) END",
        "job_title": "CASE o_orderkey % 10 WHEN 0 THEN 'Chief Technology Officer' WHEN 1 THEN 'VP of Sales' WHEN 2 THEN 'Vice President, Finance' WHEN 3 THEN 'Director of Marketing' WHEN 4 THEN 'Team Lead' WHEN 5 THEN 'Senior Engineer' WHEN 6 THEN 'Junior Designer' WHEN 7 THEN 'HR Manager' WHEN 8 THEN 'Intern' ELSE NULL END",
        "department": "CASE o_orderkey % 4 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' WHEN 2 THEN 'Finance' ELSE NULL END",
        "seniority_level": "CASE o_orderkey % 5 WHEN 0 THEN 'C-Level' WHEN 1 THEN 'VP' WHEN 2 THEN 'Director' WHEN 3 THEN 'Senior' ELSE NULL END",
        "linkedin_url": "CASE WHEN o_orderkey % 3 = 1 THEN concat('https://www.linkedin.com/in/lee-', o_orderkey) ELSE NULL END",
        "experience_years": 'CAST(o_orderkey % 40 AS INT)',
        "is_decision_maker": 'o_orderkey % 4 = 0',
        "is_verified": "o_orderstatus = 'F'",
        "contact_quality_score": 'CAST((o_orderkey * 7) % 101 AS DOUBLE)/100',
        "engagement_potential": 'CAST((o_orderkey * 3) % 101 AS DOUBLE)/100',
        "source": "CASE o_orderkey % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'company_website' ELSE 'other' END",
        "last_activity_date": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(DATE '2024-03-31' - CAST(o_orderkey % 400 AS INT) AS TIMESTAMP) END",
        "created_at": "CAST(DATE '2024-01-01' + CAST(o_orderkey % 90 AS INT) AS TIMESTAMP)",
    },
    "scraping_jobs": {
        "id": 'p_partkey',
        "created_by": 'p_partkey % 7',
        "job_name": "concat('job ', p_partkey)",
        "job_type": "CASE p_partkey % 4 WHEN 0 THEN 'google_my_business' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'website' ELSE 'directory' END",
        "status": "CASE p_partkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' WHEN 3 THEN 'cancelled' ELSE 'completed' END",
        "total_targets": 'CAST(p_size AS INT)',
        "processed_targets": 'CAST(FLOOR(p_size * (p_partkey % 5) / 4.0) AS INT)',
        "companies_found": 'CAST(p_partkey % 11 AS INT)',
        "contacts_found": 'CAST(p_partkey % 17 AS INT)',
        "start_time": "CAST(DATE '2024-01-01' + CAST(p_partkey % 30 AS INT) AS TIMESTAMP)",
        "end_time": "CAST(DATE '2024-01-01' + CAST(p_partkey % 30 + p_partkey % 3 AS INT) AS TIMESTAMP)",
    },
    "scraped_data": {
        "id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
        "job_id": 'l_partkey',
        "company_id": 'l_suppkey',
        "contact_id": 'l_orderkey',
        "source_type": "CASE l_linenumber % 3 WHEN 0 THEN 'google_my_business' WHEN 1 THEN 'linkedin' ELSE 'website' END",
        "raw_data": 'concat(\'{"name":"Acme \', l_suppkey, \'","phone":"+1-212-\', 2000000 + l_orderkey, \'","rating":\', l_linenumber, \'}\')',
        "validation_status": "CASE l_returnflag WHEN 'A' THEN 'valid' WHEN 'R' THEN 'invalid' ELSE 'pending' END",
        "is_processed": "l_linestatus = 'F'",
        "scraped_at": 'l_shipdate',
    },
    "data_exports": {
        "id": 's_suppkey',
        "created_by": 's_suppkey % 7',
        "export_type": "CASE s_suppkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'excel' ELSE 'json' END",
        "status": "CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END",
        "total_records": 'CAST(s_suppkey * 10 AS INT)',
        "created_at": "CAST(DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT) AS TIMESTAMP)",
    },
    "event_log": {
        "event_id": 'event_id',
        "ts": 'ts',
        "client_id": 'user_id',
        "domain": "concat('host', user_id % 5)",
        "endpoint": "concat('proxy', event_id % 3)",
        "success": "event_type <> 'error'",
        "response_ms": 'value',
        "metric_name": 'event_type',
        "metric_value": 'value',
        "job_id": 'user_id',
        "job_status": "CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'progress' END",
        "current_items": 'CAST(event_id % 101 AS INT)',
        "total_items": '100',
    },
}


#: Companies of which some come again under another id: 3, 4, 5 and 6 of every ten are one group, of which 6 is linked through 5 only.
SOURCES["linked_companies"] = SOURCES["companies"]
FORMULAS["linked_companies"] = FORMULAS["companies"] | {
    "name": "CASE WHEN c_custkey % 10 = 6 THEN concat('initech ', c_custkey-1) ELSE " + FORMULAS["companies"]["name"] + " END",
    "website": "CASE c_custkey % 10 WHEN 5 THEN concat('http://globex', c_custkey-2, '.com') WHEN 6 THEN NULL ELSE " + FORMULAS["companies"]["website"] + " END",
    "email": "CASE WHEN c_custkey % 10 = 6 THEN concat('own', c_custkey-1, '@Initech.com') WHEN c_custkey % 10 = 5 THEN concat('OWN', c_custkey, '@initech.com') ELSE " + FORMULAS["companies"]["email"] + " END",
    "phone": "CASE WHEN c_custkey % 10 IN (5, 6) THEN NULL ELSE " + FORMULAS["companies"]["phone"] + " END",
}

#: Contacts of which four in five have one name; their e-mails are alike in part.
SOURCES["crowded_contacts"] = SOURCES["contacts"]
FORMULAS["crowded_contacts"] = FORMULAS["contacts"] | {
    "first_name": "CASE WHEN o_orderkey % 10 < 8 THEN 'John' ELSE concat('Ann', o_orderkey) END",
    "last_name": "CASE WHEN o_orderkey % 10 < 8 THEN 'Smith' ELSE concat('Lee', o_orderkey - o_orderkey % 2) END",
    "email": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('john.smith', o_orderkey, '@Corp', o_custkey % 20, '.com') END",
}


def view_sql(name: str, spark: bool = False) -> str:
    columns = ", ".join(f"{formula} AS {column}" for column, formula in FORMULAS[name].items())
    text = f"SELECT {columns} FROM {SOURCES[name]}"
    return text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)") if spark else text


def with_views(*names: str) -> str:
    """The head of an oracle: ``WITH companies AS (...), ...``."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)


class Tables:
    """Base tables and derived lead tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def plain(self, name: str) -> DataFrame:
        """A derived table with exactly the columns of its formulas."""
        if "nation" in SOURCES[name]:
            df = self.base("customer").join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        else:
            df = self.base(SOURCES[name])
        formulas = [f"{f.replace('AS TIMESTAMP)', 'AS TIMESTAMP_NTZ)')} AS {c}" for c, f in FORMULAS[name].items()]
        return df.selectExpr(*formulas)

    @property
    def companies(self) -> DataFrame:
        return self.nested("companies")

    @property
    def linked_companies(self) -> DataFrame:
        return self.nested("linked_companies")

    def nested(self, name: str) -> DataFrame:
        """Companies with technologies as an array, location as a struct and the two maps."""
        df = self.plain(name).withColumn("technologies", F.split("technologies_csv", ","))
        flag = lambda n: F.col("id") % n == 0
        return df.withColumns({
            "location": F.struct("city", "state", "country"),
            "growth_signals": F.create_map(F.lit("hiring"), flag(2), F.lit("funding"), flag(3), F.lit("expansion"), flag(5)),
            "social_media": F.when(flag(3), F.create_map(F.lit("linkedin"), F.concat(F.lit("https://linkedin.com/company/c"), F.col("id").cast("string")))),
        })

    def __getattr__(self, name: str) -> DataFrame:
        if name in FORMULAS:
            return self.plain(name)
        if name in ("documents", "pages", "events", "customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
            return self.base(name)
        raise AttributeError(name)
