"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate; a document's count is the Poisson quantile of a hash of its identity, so the draw
is the same on every run and executor, and needs no coordination. Documents are exploded by their counts and dealt out
globally in hash order. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, text_of

#: Target weight of a source = its characters to this power (1 leaves the mix as it is, 0 makes all sources equal).
POWER = 0.5
SEED = 42
#: The Poisson table of a rate up to ``MAX_RATE`` has ``COUNTS`` steps, that of a larger one as many as can be drawn. A rate over
#: ``PART`` is the sum of draws of equal parts, as exp(-rate) would be zero. Rates have no limit.
MAX_RATE = 16.0
COUNTS = 80
PART = 400.0
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle on salted keys.
BROADCAST_ROWS = 20_000
SALTS = 64


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts and the seed."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", power: float = POWER) -> DataFrame:
    """``(source, n_docs, n_chars, rate)``: mean repetitions that bring each source to its target weight at equal total size.

    rate = (weight share) * (all characters) / (the source's characters); weight = characters ** power.
    A null source is a source of its own; one without characters has rate 1.
    """
    size = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(F.length(text_of(text)).cast("long")).alias("n_chars"))
    size = saved(size.withColumn("weight", F.round(F.pow(F.col("n_chars").cast("double"), F.lit(power)), 6).cast("decimal(28,6)")), "mixing-sizes")
    chars, weight = size.agg(F.sum("n_chars").cast("double"), F.sum("weight").cast("double")).first()
    rate = F.when(F.col("n_chars") > 0, F.col("weight").cast("double") * F.lit(chars) / (F.lit(weight) * F.col("n_chars"))).otherwise(F.lit(1.0))
    return size.select("source", "n_docs", "n_chars", F.round(rate, 6).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of counts 0, 1, 2, ... as an array."""
    last = F.when(rate <= MAX_RATE, F.lit(COUNTS)).otherwise(F.ceil(rate + 12 * F.sqrt(rate)).cast("int") + COUNTS)
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + acc["p"] * rate / k).alias("c")),
    )
    return step["c"]


def with_rates(docs: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """Join the sources' Poisson tables to the documents: by broadcast up to ``BROADCAST_ROWS`` sources, else by salted keys."""
    parts = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    steps = rates.select(F.col("source").alias("__source"), "rate", parts.alias("__parts"), poisson_steps(F.col("rate") / parts).alias("__steps"))
    if rates.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(steps), F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = steps.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = docs.withColumn("__at", salt)
    return keyed.join(spread, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__salt")), "left").drop("__source", "__salt", "__at")


def mixed(docs: DataFrame, rates: DataFrame | None = None, source: str = "source", text: str = "text", seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """``docs`` exploded by their Poisson counts and shuffled, with ``copy`` (from 0), ``n_copies``, ``rate`` and ``mix_key``.

    Repeated rows of one doc_id draw the same count. Null doc_id and null source are values like any other; empty texts
    count as documents. ``columns`` picks the columns of ``docs`` to keep (all by default); those that clash with the new
    ones are replaced. A source that ``rates`` lacks has rate 0: its documents are not drawn.
    """
    names = [c for c in (columns or docs.columns) if c not in ("copy", "n_copies", "rate", "mix_key")]
    if rates is None:
        rates = saved(source_rates(docs, source, text), "mixing-rates")
    at = docs.select(*dict.fromkeys([*names, "doc_id", source]))
    u = uniform(F.col("doc_id"), seed=seed)
    below = lambda u: F.size(F.filter(F.coalesce("__steps", F.array(F.lit(1.0))), lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda n, k: n + below(uniform(F.col("doc_id"), k, seed=seed)))
    count = below(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(F.lit(0))
    drawn = with_rates(at, rates, source).withColumn("__u", u).withColumn("n_copies", count).where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return keyed.select(*names, "copy", "n_copies", "rate", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, columns=["doc_id", "text", "source"]).select("doc_id", "source", "copy", "n_copies", "rate", "mix_key", "text")


ORACLE_6 = f"""
WITH size AS (SELECT source, count(*) n_docs, sum(length(coalesce(text, ''))) n_chars FROM documents GROUP BY source),
w AS (SELECT *, CAST(round(pow(CAST(n_chars AS DOUBLE), {POWER}), 6) AS DECIMAL(28,6)) weight FROM size),
t AS (SELECT CAST(sum(n_chars) AS DOUBLE) all_chars, CAST(sum(weight) AS DOUBLE) all_weight FROM w),
r AS (SELECT source, round(CASE WHEN n_chars > 0 THEN CAST(weight AS DOUBLE) * all_chars / (all_weight * n_chars) ELSE 1.0 END, 6) rate FROM w, t),
q AS (SELECT source, rate, greatest(CAST(ceil(rate / {PART}) AS INTEGER), 1) parts FROM r),
e AS (SELECT *, rate / parts x, CASE WHEN rate / parts <= {MAX_RATE} THEN {COUNTS} ELSE CAST(ceil(rate / parts + 12 * sqrt(rate / parts)) AS INTEGER) + {COUNTS} END AS last FROM q),
s AS (SELECT source, k, exp(-x) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: x / j)), 1.0) p FROM (SELECT *, unnest(range(0, last + 1)) k FROM e)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) c FROM s),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
u AS (SELECT rid, d.source, part, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE part WHEN 0 THEN '' ELSE ':' || part END), 1, 13)) AS BIGINT) / 4503599627370496.0 u
      FROM d JOIN (SELECT *, unnest(range(0, parts)) part FROM q) q ON d.source IS NOT DISTINCT FROM q.source),
n AS (SELECT rid, count(CASE WHEN c.c <= u.u THEN 1 END) n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY rid)
SELECT doc_id, d.source AS source, CAST(k AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, rate, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k) AS mix_key, text
FROM (SELECT rid, n_copies, unnest(range(0, n_copies)) AS k FROM n) n JOIN d USING (rid) JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
