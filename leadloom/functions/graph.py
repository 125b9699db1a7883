"""Connected components, and stages saved in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (as in tests) gets a temporary one; on a cluster executors could not see it, so
    that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once to the shared folder and read it back, so lost executors cost no recomputation of it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node reached.

    Alternating large-star and small-star steps: every step is a grouped minimum plus a join, both keyed by node, so no
    component is ever gathered anywhere. The minima are saved before they are joined: with both sides of the join read from
    files, Spark can split the rows of a node with very many links. Each round is saved; the loop ends when the set of edges
    stops changing, after about log(n) rounds. Nodes are longs; loops (a = b) and null ends are dropped, since a node
    without a link is its own component.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = saved(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, after = None, mark(now)
    while after != before and after[0]:
        before = after
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = saved(large.distinct(), name)  # m is at most a, and so less than b
        small = saved(down.groupBy("a").agg(F.min("b").alias("m")), name)
        other = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        now = saved(down.join(small, "a").select(other.alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        after = mark(now)
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.toDF("node", "component").union(roots)
