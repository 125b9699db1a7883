"""Reading lead tables, conforming their dialects, and writing exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scoring import with_columns

#: Canonical columns of the lead tables.
SCHEMAS = {
    "companies": "id string, created_by string, name string, domain string, website string, industry string, company_size string, location struct<city:string,state:string,country:string>, description string, founded_year int, employee_count int, revenue_range string, technology_stack array<string>, social_media map<string,string>, growth_signals map<string,boolean>, pain_points array<string>, data_quality_score double, lead_score double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "contacts": "id string, company_id string, first_name string, last_name string, full_name string, email string, phone string, job_title string, department string, seniority_level string, linkedin_url string, twitter_handle string, bio string, skills array<string>, experience_years int, education array<struct<degree:string,institution:string>>, contact_quality_score double, engagement_potential double, is_decision_maker boolean, is_verified boolean, last_activity_date timestamp_ntz, created_at timestamp_ntz",
    "scraping_jobs": "id string, created_by string, job_name string, job_type string, status string, total_targets int, processed_targets int, companies_found int, contacts_found int, start_time timestamp_ntz, end_time timestamp_ntz",
    "scraped_data": "id string, job_id string, company_id string, contact_id string, source_type string, source_url string, raw_data string, validation_status string, is_processed boolean, scraped_at timestamp_ntz",
    "data_exports": "id string, created_by string, export_type string, status string, total_records int, created_at timestamp_ntz",
}


def typed(df: DataFrame, schema: str | None) -> DataFrame:
    """Columns of text as the types of ``schema``: lists, structs and maps from JSON, values that are no such type null.

    Columns that ``schema`` has and ``df`` lacks are null; columns that it does not name stay text, behind the others.
    """
    fields, has = T.StructType.fromDDL(schema).fields if schema else [], set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in has:
            return F.lit(None).cast(f.dataType).alias(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.from_json(f.name, f.dataType) if nested else F.col(f.name).try_cast(f.dataType)).alias(f.name)

    return df.select(*map(one, fields), *[c for c in df.columns if c not in {f.name for f in fields}])


def read_tables(spark: SparkSession, folder: str, kind: str = "parquet", names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The lead tables of a folder, lazily: JSON and CSV (with a header) in their canonical schema, Parquet in its own.

    CSV may have its columns in any order, lists and structs as JSON; a table without a canonical schema is read as text.
    """
    read = {
        "parquet": lambda n: spark.read.parquet(f"{folder}/{n}.parquet"),
        "json": lambda n: spark.read.schema(SCHEMAS[n]).json(f"{folder}/{n}.json"),
        "csv": lambda n: typed(spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{n}.csv"), SCHEMAS.get(n)),
    }[kind]
    return {n: read(n) for n in names}


def conform_companies(df: DataFrame) -> DataFrame:
    """Either column dialect to the canonical one: size_range, website_url, technologies (array or text), text or JSON location."""
    has = set(df.columns)

    def first(kind: str, *names: str) -> Column:
        given = [F.col(n) for n in names if n in has]
        return F.coalesce(*given).cast(kind) if given else F.lit(None).cast(kind)

    techs = next((n for n in ("technology_stack", "technologies") if n in has), None)
    if techs and dict(df.dtypes)[techs] == "string":
        text = F.col(techs)
        stack = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x)))
    else:
        stack = F.col(techs) if techs else F.lit(None).cast("array<string>")
    location = "struct<city:string,state:string,country:string>"
    if "location" in has and dict(df.dtypes)["location"] == "string":
        text = F.col("location")
        parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
        place = F.when(text.startswith("{"), F.from_json(text, location)).when(text.isNotNull(), F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("city", "state", "country"))]))
    else:
        place = F.col("location") if "location" in has else F.lit(None).cast(location)
    out = {"company_size": first("string", "company_size", "size_range"), "website": first("string", "website", "website_url"), "technology_stack": stack, "location": place}
    return df.withColumns(out).drop(*({"size_range", "website_url", "technologies"} & has))


RAW = "name string, company_name string, address string, phone string, website string, rating double, industry string, size string, location string, description string, full_name string, email string, title string"


def load_scraped_records(scraped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies and contacts from the raw JSON of mixed sources; unreadable JSON gives null fields, rows stay."""
    raw = F.from_json("raw_data", RAW)
    rows = scraped.withColumn("r", raw)
    companies = rows.select("id", "job_id", "source_type", F.coalesce("r.company_name", "r.name").alias("name"), F.coalesce("r.address", "r.location").alias("address"), F.col("r.phone").alias("phone"), F.col("r.website").alias("website"), F.col("r.industry").alias("industry"), F.col("r.size").alias("company_size"), F.col("r.description").alias("description"), F.col("r.rating").alias("rating"))
    contacts = rows.where(F.coalesce("r.full_name", "r.email").isNotNull()).select("id", "job_id", "source_type", F.col("r.full_name").alias("full_name"), F.col("r.email").alias("email"), F.col("r.title").alias("job_title"), F.coalesce("r.company_name", "r.name").alias("company_name"))
    return companies, contacts


# ---- exports -----------------------------------------------------------------------------------------------------------

COMPANY_FIELDS = {
    "basic": ("id", "name", "domain", "website", "industry", "company_size", "employee_count"), "contact_info": ("phone", "address", "location"),
    "business_data": ("founded_year", "revenue_range", "description", "technology_stack", "social_media"), "analytics": ("lead_score", "data_quality_score", "growth_signals", "pain_points", "competitive_landscape"),
    "metadata": ("created_at", "updated_at", "contacts_count", "scraped_data_count"),
}
CONTACT_FIELDS = {
    "basic": ("id", "first_name", "last_name", "full_name", "email", "phone"), "professional": ("job_title", "department", "seniority_level", "experience_years", "skills"),
    "social": ("linkedin_url", "twitter_handle", "bio"), "analytics": ("contact_quality_score", "engagement_potential", "is_decision_maker", "is_verified"), "metadata": ("created_at", "updated_at", "last_activity_date"),
}
LEAD_SHEET = (
    ("Company ID", "id"), ("Company Name", "name"), ("Domain", "domain"), ("Website", "website"), ("Industry", "industry"), ("Company Size", "company_size"), ("Location", "location"), ("Lead Score", "lead_score"),
    ("Data Quality Score", "data_quality_score"), ("Employee Count", "employee_count"), ("Founded Year", "founded_year"), ("Revenue Range", "revenue_range"), ("Created At", "created_at"),
)


def shown(df: DataFrame, name: str) -> Column:
    """A field as text: location parts by comma, arrays by "; ", maps as k: v, education as degree at institution, nulls empty."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StructType):
        out = F.concat_ws(", ", *[c[f.name].cast("string") for f in kind.fields if f.name in ("city", "state", "country")])
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        out = F.array_join(F.transform(c, lambda e: F.concat_ws(" at ", e["degree"], e["institution"])), "; ")
    elif isinstance(kind, T.ArrayType):
        out = F.array_join(c.cast("array<string>"), "; ")
    elif isinstance(kind, T.MapType):
        out = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string"))), "; ")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def title(name: str) -> str:
    return name.replace("_", " ").title()


def export_cap(df: DataFrame, max_records: int = 1000, key: str = "id") -> DataFrame:
    """The newest ``max_records`` by created_at, ties by key."""
    return df.orderBy(F.col("created_at").desc_nulls_last(), key).limit(max_records)


def export_csv(df: DataFrame, path: str, fields: tuple[str, ...] | None = None, header: bool = True, max_records: int = 1000) -> DataFrame:
    """Write the chosen fields as CSV with Title Case headers; gives back the written frame."""
    use = [f for f in (fields or df.columns) if f in df.columns]
    out = export_cap(df, max_records).select(*[shown(df, f).alias(title(f)) for f in use])
    out.write.option("header", header).option("emptyValue", "").mode("overwrite").csv(path)
    return out


def export_csv_companies(df: DataFrame, path: str, fields: tuple[str, ...] | None = None, header: bool = True, max_records: int = 1000) -> DataFrame:
    return export_csv(df, path, fields or tuple(x for g in COMPANY_FIELDS.values() for x in g), header, max_records)


def export_csv_contacts(df: DataFrame, path: str, fields: tuple[str, ...] | None = None, header: bool = True, max_records: int = 1000) -> DataFrame:
    return export_csv(df, path, fields or (*[x for g in CONTACT_FIELDS.values() for x in g], "education"), header, max_records)


def export_leads_csv(df: DataFrame, path: str) -> DataFrame:
    """The fixed 13-column lead sheet, all rows."""
    c = with_columns(df, domain="string")
    out = c.select(*[shown(c, f).alias(h) for h, f in LEAD_SHEET])
    out.write.option("header", True).mode("overwrite").csv(path)
    return out


def export_json(df: DataFrame, path: str, fields: tuple[str, ...] | None = None, max_records: int = 1000) -> DataFrame:
    out = export_cap(df, max_records).select(*[f for f in (fields or df.columns) if f in df.columns])
    out.write.mode("overwrite").json(path)
    return out


def export_leads_with_contact(companies: DataFrame, contacts: DataFrame, path: str, min_score: float | None = None, ids: tuple | None = None) -> DataFrame:
    """Companies with their first contact (lowest id), filtered by score and ids."""
    c = companies.where(F.col("lead_score") >= min_score) if min_score is not None else companies
    c = c.where(F.col("id").isin(*ids)) if ids else c
    first = contacts.groupBy(F.col("company_id").alias("id")).agg(F.min_by(F.struct("first_name", "last_name", "email", "job_title"), "id").alias("k"))
    out = c.join(first, "id", "left").select("id", "name", "industry", "lead_score", F.concat_ws(" ", "k.first_name", "k.last_name").alias("contact_name"), F.col("k.email").alias("contact_email"), F.col("k.job_title").alias("contact_title"))
    out.write.option("header", True).mode("overwrite").csv(path)
    return out


def export_field_catalog(spark: SparkSession) -> DataFrame:
    rows = [(t, g, f) for t, groups in (("companies", COMPANY_FIELDS), ("contacts", CONTACT_FIELDS)) for g, fields in groups.items() for f in fields]
    return spark.createDataFrame(rows, "data_type string, field_group string, field string")


def field_use(df: DataFrame, catalog: DataFrame, data_type: str) -> DataFrame:
    """The catalogue's rows of a data type with ``n_filled``, the rows of ``df`` that have the field; 0 where ``df`` lacks it."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*")
    rows = catalog.where(F.col("data_type") == data_type).join(long, F.col("field") == F.col("name"), "left")
    return rows.select("data_type", "field_group", "field", F.coalesce("n", F.lit(0)).alias("n_filled"))


def crm_field_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their names in the CRM; a mapped column that is absent is an error."""
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])
