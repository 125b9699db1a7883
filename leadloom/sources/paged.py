"""Tables kept in order, so that a page reads the parts it falls into and nothing is sorted again for it."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.graph import shared_dir

PARTS = 64
INFO = "total long, pages long, page long, has_next boolean, has_prev boolean, next_page long, prev_page long"


@dataclass(frozen=True)
class OrderIndex:
    """A stored table in ranges of its order, and how many rows are in and before each range."""

    path: str
    column: str
    descending: bool
    key: str
    counts: tuple[int, ...]

    def order(self) -> list[Column]:
        return [F.desc(self.column) if self.descending else F.asc(self.column), F.asc(self.key)]

    def parts_of(self, offset: int, size: int) -> range:
        """The ranges that rows ``offset`` to ``offset + size`` are in."""
        ends = list(accumulate(self.counts))
        first = bisect_right(ends, offset)
        return range(first, min(bisect_right(ends, offset + size - 1) + 1, len(ends))) if size > 0 and first < len(ends) else range(0)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("__part", IntegerType())])).parquet(path)


def ordered(df: DataFrame, column: str, descending: bool = False, key: str = "id", parts: int = PARTS, path: str | None = None) -> OrderIndex:
    """Write ``df`` in ranges of ``column``, then ``key``, and count the rows of each; one sort for all pages to come.

    Rows with equal values may be in several ranges, told apart by the key. Nulls are where Spark sorts them.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/ordered-{uuid.uuid4().hex}"
    order = OrderIndex(path, column, descending, key, ()).order()
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(path)
    found = dict(_read(spark, path, df.schema).groupBy("__part").count().collect())  # a row per range
    return OrderIndex(path, column, descending, key, tuple(found.get(k, 0) for k in range(max(found, default=-1) + 1)))


def page(spark: SparkSession, index: OrderIndex, schema: StructType, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows in the index's order, and one row of ``total, pages, page, has_next, has_prev, next_page, prev_page``.

    Only the ranges of the page are read and sorted. A page past the end, or of an empty table, has no rows.
    """
    offset, total = (number - 1) * size, sum(index.counts)
    parts = index.parts_of(offset, size)
    rows = _read(spark, index.path, schema).where(F.col("__part").isin(list(parts)))
    rows = rows.orderBy(*index.order()).offset(offset - sum(index.counts[: parts.start])).limit(size).drop("__part") if parts else rows.where(F.lit(False)).drop("__part")
    pages = -(-total // size)
    info = (total, pages, number, number < pages, number > 1, number + 1 if number < pages else None, number - 1 if number > 1 else None)
    return rows, spark.createDataFrame([info], INFO)
