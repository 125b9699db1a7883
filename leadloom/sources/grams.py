"""Stored search indexes: postings of 3-grams, so that a search reads the parts that its hits are in and not the table.

The rows are stored in ranges of tenant and key, the postings ``(gram, tenant, part, key)`` in ranges of gram, tenant and key, and
their counts by gram and tenant. So a tenant's rows lie together, the places of a gram that very many rows hold are spread over
several ranges, and a look-up reads the few ranges that cover its grams. Postings only say where to look: what is read there is put
through the same test as a scan, so hits are equal to a scan's. An index is of the table as it was when it was built.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.graph import shared_dir
from ..operators.select import company_texts, contact_texts, holds, pieces

PARTS = 64
#: Characters of a gram, grams that a term is looked up by, and how many times as frequent as its rarest the others may be.
GRAM, PROBES, AS_RARE = 3, 3, 4
#: Up to so many keys are pushed into the scan of the rows.
PUSHED_KEYS = 1000
ROWS, POSTINGS, COUNTS, BOUNDS = "rows", "postings", "counts", "bounds"


@dataclass(frozen=True)
class GramIndex:
    """A stored search index: its folder, the columns of the table, of the tenant and of the key, and each range's first and last gram."""

    path: str
    schema: StructType
    tenant: str
    key: str
    bounds: tuple[tuple[str, int, str, str], ...]

    def ranges(self, table: str, grams: list[str]) -> list[int]:
        """The ranges of postings or counts that may hold one of the grams."""
        # Spark orders strings by bytes of UTF-8, which is the order of code points, as Python's.
        return sorted({part for t, part, low, high in self.bounds if t == table and any(low <= g <= high for g in grams)})


def _write(df: DataFrame, path: str, parts: int, *order: str) -> None:
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(path)


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    return spark.read.schema(StructType([*fields, StructField("__part", IntegerType())])).parquet(path)


def build(df: DataFrame, texts: list[Column], tenant: str = "created_by", key: str = "id", parts: int = PARTS, path: str | None = None) -> GramIndex:
    """Store ``df`` with postings of the 3-grams of ``texts`` (lower-cased columns that are searched in), and open the index.

    Rows of no tenant are stored but not posted, as no tenant's search may find them. Null and short texts have no grams.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    _write(df, f"{path}/{ROWS}", parts, tenant, key)
    stored = _read(spark, f"{path}/{ROWS}", df.schema)
    grams = F.array_distinct(F.concat(*[F.coalesce(pieces(t, (GRAM,)), F.array().cast("array<string>")) for t in texts]))
    posted = stored.where(F.col(tenant).isNotNull()).select(F.explode(grams).alias("gram"), F.col(tenant).alias("tenant"), F.col("__part").alias("at"), F.col(key).alias("key"))
    _write(posted, f"{path}/{POSTINGS}", parts, "gram", "tenant", "key")
    postings = spark.read.schema(posted.schema).parquet(f"{path}/{POSTINGS}")
    _write(postings.groupBy("gram", "tenant").agg(F.count("*").alias("n")), f"{path}/{COUNTS}", max(parts // 8, 1), "gram", "tenant")
    lows = [_read(spark, f"{path}/{t}", "gram string").groupBy("__part").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).select(F.lit(t).alias("of"), "__part", "low", "high") for t in (POSTINGS, COUNTS)]
    lows[0].union(lows[1]).write.parquet(f"{path}/{BOUNDS}")
    return opened(spark, path, df.schema, tenant, key)


def opened(spark: SparkSession, path: str, schema: StructType, tenant: str = "created_by", key: str = "id") -> GramIndex:
    """The index that was stored under ``path``; ``schema`` is its table's. Bounds are a row per range."""
    bounds = spark.read.schema("of string, __part int, low string, high string").parquet(f"{path}/{BOUNDS}").where("low is not null").collect()
    return GramIndex(path, schema, tenant, key, tuple(sorted(tuple(r) for r in bounds)))


def _probes(spark: SparkSession, index: GramIndex, user_id: int, grams: list[str]) -> list[str]:
    """The rarest of a term's grams among the tenant's rows; none if some gram is nowhere in them."""
    counts = _read(spark, f"{index.path}/{COUNTS}", "gram string, tenant long, n long").where(F.col("__part").isin(index.ranges(COUNTS, grams)))
    found = sorted((r.n, r.gram) for r in counts.where(F.col("gram").isin(grams) & (F.col("tenant") == user_id)).select("n", "gram").collect())  # at most a row per gram
    return [g for n, g in found if n <= AS_RARE * found[0][0]][:PROBES] if len(found) == len(grams) else []


def search(spark: SparkSession, index: GramIndex, texts: list[Column], user_id: int, term: str) -> DataFrame:
    """The tenant's rows one of whose ``texts`` contains the term, any case; equal to a scan of the table.

    A term under three characters is in too many rows for postings to help: the tenant's own rows are scanned, as they lie
    together. Otherwise the term's rarest grams are looked up, and only the ranges of rows that hold all of them are read.
    """
    rows = _read(spark, f"{index.path}/{ROWS}", index.schema)
    hits = rows.where((F.col(index.tenant) == user_id) & holds(texts, term))
    text = term.lower()
    if len(text) < GRAM:
        return hits.drop("__part")
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    probes = _probes(spark, index, user_id, grams)
    if not probes:
        return spark.createDataFrame([], index.schema)
    key = index.schema[index.key].dataType.simpleString()
    postings = _read(spark, f"{index.path}/{POSTINGS}", f"gram string, tenant long, at int, key {key}").where(F.col("__part").isin(index.ranges(POSTINGS, probes)))
    places = postings.where(F.col("gram").isin(probes) & (F.col("tenant") == user_id)).groupBy("at", "key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(probes))
    at = places.groupBy("at").agg(F.count("*").alias("rows"), F.count("key").alias("keys")).collect()  # a row per range of the table
    hits = hits.where(F.col("__part").isin([r["at"] for r in at]))
    if at and sum(r["rows"] for r in at) <= PUSHED_KEYS and all(r["rows"] == r["keys"] for r in at):
        hits = hits.where(F.col(index.key).isin([r[0] for r in places.select("key").distinct().collect()]))
    return hits.drop("__part")


def index_companies(df: DataFrame, parts: int = PARTS, path: str | None = None) -> GramIndex:
    """A search index over the names and hosts of companies."""
    return build(df, company_texts(), parts=parts, path=path)


def index_contacts(df: DataFrame, parts: int = PARTS, path: str | None = None) -> GramIndex:
    """A search index over the first and last names and e-mails of contacts."""
    return build(df, contact_texts(), parts=parts, path=path)


def search_companies(spark: SparkSession, index: GramIndex, user_id: int, term: str) -> DataFrame:
    """As ``select.search_companies``, from the index."""
    return search(spark, index, company_texts(), user_id, term)


def search_contacts(spark: SparkSession, index: GramIndex, user_id: int, term: str) -> DataFrame:
    """As ``select.search_contacts``, from the index."""
    return search(spark, index, contact_texts(), user_id, term)
