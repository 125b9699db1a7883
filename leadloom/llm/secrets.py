"""Secret scans with corpus-wide ownership frequency.

Candidates are found in one pass over the texts. Their values are hashed and counted over the corpus by distinct
repositories (documents) and owners (sources): a value that many owners hold is a widely copied example, one that a single
owner holds and that looks random is taken for a live credential. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, text_of

#: Kinds in their order, their patterns, and the least length of the value. The base kinds come first.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: The method's own candidates: long runs of token characters.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
PATTERNS = (ASSIGN, ACCESS, HEX, OPAQUE)
N_BASE = 3

#: A value held by this many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3
#: A live-looking value has at least so many different characters, with letters and digits among them.
DISTINCT_CHARS = 8


def _matches(text: Column, kind: int) -> Column:
    """Matches of one kind in order: ``struct(kind, idx, gap, gap_bytes, match)``; gap is what lies between it and the last match."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind == 1:
        found = F.when(F.contains(text, F.lit("AKIA")), found).otherwise(F.array().cast("array<string>"))
    between = F.split(text, PATTERNS[kind], -1)
    size = lambda f, i: f(F.get(between, i))
    return F.transform(
        found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), size(F.length, i).alias("gap"), size(F.octet_length, i).alias("gap_bytes"), m.alias("match"))
    )


def _value(kind: Column, match: Column) -> Column:
    return F.when(kind == 0, F.regexp_extract(match, "^" + ASSIGN, 2)).otherwise(match)


def live_looking(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS)


def scanned(docs: DataFrame, text: str, owner: str) -> DataFrame:
    """Per row ``(doc_id, owner, text_hash, found)``: one pass over the texts, saved; nothing of the text but its matches stays."""
    t = text_of(text)
    found = F.concat(*[_matches(t, k) for k in range(len(KINDS))])
    return saved(docs.select("doc_id", F.col(owner).alias("owner"), F.xxhash64(t).alias("text_hash"), found.alias("found")), "secrets-found")


def candidates(scan: DataFrame) -> DataFrame:
    """One row per candidate of each distinct text: ``doc_id, text_hash, kind, start, end, start_byte, value_hash, live``.

    Offsets are running sums of gaps and matches within a text and kind; matches that fail their kind's test count in the
    sums and are then dropped. A match is ASCII, so it is as long in bytes as in characters.
    """
    rows = scan.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline("found"))
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("idx")
    upto = lambda gap: F.sum(F.col(gap) + F.length("match")).over(so_far).cast("long")
    value = _value(F.col("kind"), F.col("match"))
    rows = rows.withColumns({"end": upto("gap"), "end_byte": upto("gap_bytes"), "value": value})
    rows = rows.withColumns({"start": F.col("end") - F.length("match"), "start_byte": F.col("end_byte") - F.length("match")})
    return rows.where(_passes()).select("doc_id", "text_hash", "kind", "start", "end", "start_byte", F.xxhash64("value").alias("value_hash"), live_looking(F.col("value")).alias("live"))


def _passes() -> Column:
    n = F.length("value")
    return F.when(F.col("kind") == 0, n >= 6).when(F.col("kind") == 1, n >= 20).when(F.col("kind") == 2, n >= 24).otherwise(live_looking(F.col("value")))


def ownership(scan: DataFrame) -> DataFrame:
    """``(value_hash, n_owners, n_repos)`` over all rows: pairs are made distinct first, so a hot value is counted in parts."""
    match = scan.where(F.size("found") > 0).select("doc_id", "owner", F.inline("found"))
    value = match.withColumn("value", _value(F.col("kind"), F.col("match"))).where(_passes())
    holds = value.select(F.xxhash64("value").alias("value_hash"), "owner", "doc_id").distinct()
    by_owner = holds.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def secret_spans(docs: DataFrame, text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> tuple[DataFrame, DataFrame]:
    """The scan's rows and the spans of each distinct ``(doc_id, text_hash)``.

    Spans carry ``kind, start, end, value_hash, verdict``: 'example' where at least ``example_owners`` owners hold the value,
    'live' where fewer do and the value looks random, else 'weak'. The method's own kind is kept only where it is live and
    does not overlap a base span. Null texts are empty; a null owner is an owner of its own; repeated rows count once
    per owner; extra columns are ignored.
    """
    scan = scanned(docs, text, owner)
    owned = saved(ownership(scan), "secrets-owned")  # read from files, so that the rows of a hot value can be split in the join
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("live"), "live").otherwise("weak")
    rows = candidates(scan).join(owned, "value_hash").withColumn("verdict", verdict).where((F.col("kind") < N_BASE) | (F.col("verdict") == "live"))
    # A span meets a base span if one that begins no later ends after its start, or one that begins no earlier begins before its end.
    text_rows, base = Window.partitionBy("doc_id", "text_hash"), F.col("kind") < N_BASE
    ahead = text_rows.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = text_rows.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ended", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("begins", F.min(F.when(base, F.col("start"))).over(behind))
    meets = F.coalesce(F.col("ended") > F.col("start"), F.lit(False)) | F.coalesce(F.col("begins") < F.col("end"), F.lit(False))
    span = F.struct("start", "kind", "end", "verdict", "n_owners", "n_repos", "value_hash", "start_byte")
    per_text = rows.where(base | ~meets).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return scan, per_text.withColumn("base", F.filter("spans", lambda s: s["kind"] < N_BASE))


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source") -> DataFrame:
    """One row per row of ``docs``: counts and spans of secrets, base spans hashed, and counts by verdict."""
    scan, spans = secret_spans(docs, text, owner)
    found = spans.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__hash")
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    none = F.from_json(F.lit("[]"), dict(spans.dtypes)["spans"])
    rows = scan.select("doc_id", "text_hash").join(found, at, "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("base", "spans")})
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    of = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"),
        of("live").alias("n_live"), of("example").alias("n_example"),
    )


def redacted(docs: DataFrame, text: str = "text", owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live credentials replaced by ``mark`` in the text (and ``n_chars`` renewed if there is one).

    Spans marked live are cut out; overlapping ones are cut as one. Documents without any are unchanged, null texts stay null.
    """
    _, spans = secret_spans(docs, text, owner)
    at = lambda s: F.struct(s["start_byte"].alias("a"), (s["start_byte"] + s["end"] - s["start"]).alias("b"))
    live = spans.select("doc_id", "text_hash", F.explode(F.transform(F.filter("spans", lambda s: s["verdict"] == "live"), at)).alias("cut")).select("doc_id", "text_hash", "cut.a", "cut.b")
    # Where a cut begins after the end of all before it, what lies between is kept; overlapping cuts are one.
    before = Window.partitionBy("doc_id", "text_hash").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("from", F.coalesce(F.max("b").over(before), F.lit(0).cast("long")))
    piece = F.when(F.col("a") >= F.col("from"), F.struct("from", F.col("a").alias("upto")))
    kept = live.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_list(piece)).alias("__kept"), F.max("b").alias("__last"))
    rows = docs.withColumn("__key", F.xxhash64(text_of(text))).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    # Pieces are cut by bytes, which costs as much as the piece, and by characters as much as all before it.
    rows = rows.withColumn("__bytes", F.encode(F.col(text), "UTF-8"))
    taken = lambda k: F.decode(F.substr(F.col("__bytes"), (k["from"] + 1).cast("int"), (k["upto"] - k["from"]).cast("int")), "UTF-8")
    rest = F.decode(F.substr(F.col("__bytes"), (F.col("__last") + 1).cast("int")), "UTF-8")
    cut = F.concat(F.array_join(F.transform("__kept", taken), mark), F.lit(mark), rest)
    out = rows.withColumn(text, F.when(F.col("__kept").isNull(), F.col(text)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
