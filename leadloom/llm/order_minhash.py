"""Order MinHash fingerprints: which k-mers a text has, and in which order.

A k-mer is three words in a row (a shorter text is one k-mer, a text without words has none); the second and later occurrence of
the same k-mer count as items of their own. An item's hash deals it to one of 64 cells, and in each cell the two items with the
smallest hashes are selected. Their k-mers, put back into text order, are hashed together to the cell's 32 bits. Moving or
changing words changes the cells whose selected items they touch, and a swap of two selected items changes the cell as well,
which a set of k-mers would not show. Two fingerprints are alike in the share of equal cells, of those not empty in both.

Everything is declarative: texts are shuffled once, in blocks of neighbouring ids; words, k-mers, occurrence numbers, the choice
of the smallest and the next document all come from windows and groups within a block, so no other shuffle follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

K, PICKED, CELLS = 3, 2, 64
EMPTY = "-" * 8
#: Documents in a block and in a partition, on average, and the most blocks; a partition has one block at least.
BLOCK_DOCS, PARTITION_DOCS, MAX_BLOCKS = 64, 512, 1 << 16


def first_id() -> Column:
    """doc_id as a long that sorts like it; null sorts first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def cut_points(docs: DataFrame, blocks: int) -> DataFrame:
    """One row: ``cuts``, the ids at which blocks of about equal numbers of documents begin, the smallest id first."""
    share = [k / blocks for k in range(1, blocks)] or [0.5]
    inner = F.percentile_approx("key", share, 10 * blocks + 1000) if blocks > 1 else F.array().cast("array<long>")
    ids = docs.select(first_id().alias("key"))
    return ids.agg(F.array_sort(F.array_distinct(F.concat(F.array(F.min("key")), inner))).alias("cuts"))


def _not_above(blocks: int) -> Column:
    """How many of the cuts are not above ``key``, by binary search."""
    steps = [1 << k for k in reversed(range(blocks.bit_length()))]
    reach = lambda acc, step: (acc + step <= F.size("cuts")) & (F.get("cuts", acc + step - 1) <= F.col("key"))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, step: F.when(reach(acc, step), acc + step).otherwise(acc))


def neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(block, rid, guest, doc_id, text, next_text)``; in a block ``rid`` counts documents in ascending order from 1.

    The first document of every block also stands, as a guest, at the end of the block before (of the first block: of the last),
    so the document after each is in its own block. Documents that share an id are in one block, in the order of their texts.
    """
    rows = docs.select("doc_id", text_of(text).alias("text")).withColumn("key", first_id())
    n = docs.count()
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK_DOCS))
    placed = rows.crossJoin(F.broadcast(cut_points(docs, blocks))).withColumn("block", _not_above(blocks))  # one row of at most MAX_BLOCKS ids
    opens = F.get("cuts", F.col("block") - 1) == F.col("key")
    before = F.when(F.col("block") == 1, F.size("cuts")).otherwise(F.col("block") - 1)
    at = F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")), F.struct(before.alias("block"), F.lit(1).alias("guest")))
    both = placed.select("doc_id", "text", "key", F.explode(F.when(opens, at).otherwise(F.slice(at, 1, 1))).alias("at")).select("at.block", "at.guest", "doc_id", "key", "text")
    dealt = both.repartition(max(1, min(blocks, -(-n // PARTITION_DOCS))), "block")
    order = Window.partitionBy("block").orderBy("guest", "key", "text")
    return dealt.select("block", F.row_number().over(order).alias("rid"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def kmers(hashed: Column) -> Column:
    """Hashes of the k-mers, from the hashes of the words, in text order."""
    whole = F.array(F.aggregate(hashed, F.lit(K).cast("long"), lambda acc, h: F.xxhash64(acc, h)))
    runs = F.transform(F.sequence(F.lit(0), F.size(hashed) - K), lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(K))))
    return F.when(F.size(hashed) == 0, F.array().cast("array<long>")).when(F.size(hashed) < K, whole).otherwise(runs)


def packed(chosen: Column) -> Column:
    """The fingerprint from the chosen k-mers in the order of their cells and places: the k-mers of a cell hashed one after the other."""
    digits = lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    closed = lambda acc: F.when(acc["cell"] < 0, F.lit("")).otherwise(F.concat(acc["out"], digits(acc["hash"])))
    state = lambda cell, h, out: F.struct(cell.alias("cell"), h.alias("hash"), out.alias("out"))
    gap = lambda n: F.repeat(F.lit(EMPTY), n)
    return F.aggregate(
        chosen,
        state(F.lit(-1), F.lit(0).cast("long"), F.lit("")),
        lambda acc, x: F.when(x["cell"] == acc["cell"], state(acc["cell"], F.xxhash64(acc["hash"], x["kmer"]), acc["out"])).otherwise(
            state(x["cell"], F.xxhash64(F.lit(CELLS).cast("long"), x["kmer"]), F.concat(closed(acc), gap(x["cell"] - acc["cell"] - 1)))
        ),
        lambda acc: F.concat(closed(acc), gap(F.lit(CELLS - 1) - acc["cell"])),
    )


def fingerprints(texts: DataFrame, keys: list[str], info: Column) -> DataFrame:
    """One row per text, told apart by ``keys`` (numbers): ``info`` and its ``fingerprint``, 8 hex digits per cell, dashes where no item falls.

    ``texts`` must be dealt out by a subset of ``keys`` for this to need no shuffle. Every text keeps its row of ``info``, which
    travels with its first item only.
    """
    words = F.transform(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    hashed = texts.select(*keys, info.alias("info"), words.alias("words"))
    items = hashed.select(*keys, "info", F.posexplode_outer(kmers(F.col("words"))).alias("pos", "kmer"))
    items = items.withColumn("info", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("info")))
    told = F.xxhash64(*keys, "kmer").alias("told")  # sorts by one number; the keys behind it only settle equal ones
    seen = Window.partitionBy("told", *keys, "kmer").orderBy("pos")
    numbered = items.select("*", told).select(*keys, "info", "pos", "kmer", F.row_number().over(seen).alias("occurrence"))
    hashed = numbered.withColumn("item", F.xxhash64("kmer", "occurrence")).withColumn("cell", F.when(F.col("pos").isNotNull(), F.pmod("item", F.lit(CELLS)).cast("int")))
    cell = F.xxhash64(*keys, "cell")
    least = Window.partitionBy("shelf", *keys, "cell").orderBy("item", "pos")
    picked = hashed.withColumn("shelf", cell).withColumn("nth", F.row_number().over(least)).where((F.col("nth") <= PICKED) | F.col("info").isNotNull())
    chosen = F.when((F.col("nth") <= PICKED) & F.col("cell").isNotNull(), F.struct("cell", "pos", "kmer"))
    rows = picked.groupBy(*keys).agg(F.max("info").alias("info"), F.array_sort(F.collect_list(chosen)).alias("chosen"))  # at most PICKED a cell
    return rows.select(*keys, "info", packed(F.col("chosen")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal cells among those that are not empty in both; 1 where all are."""
    cell = lambda c, k: F.substring(c, 8 * k + 1, F.lit(8))
    number = lambda test: F.size(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: test(cell(a, k), cell(b, k))))
    used = number(lambda x, y: (x != EMPTY) | (y != EMPTY))
    return F.when(used == 0, F.lit(1.0)).otherwise(number(lambda x, y: (x == y) & (x != EMPTY)) / used)


def edited(text: Column, following: Column) -> Column:
    """The last quarter of a text replaced by as much of the beginning of another (or all of it)."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    Null texts are empty; empty texts have empty fingerprints, which are like each other. The next document is that with the next
    doc_id, after the last the first (a single document follows itself); null ids come first; rows that share an id are
    documents of their own, in the order of their texts. An empty table gives no rows; other columns do not matter.
    """
    near = neighbours(docs, text)
    own, changed = F.col("text"), edited(F.col("text"), F.col("next_text"))
    at = F.array(F.struct(F.lit(0).alias("version"), own.alias("text")), F.struct(F.lit(1).alias("version"), changed.alias("text")))
    versions = near.select("block", "rid", "guest", "doc_id", F.explode(F.when(F.col("guest") == 1, F.slice(at, 1, 1)).otherwise(at)).alias("v"))
    versions = versions.select("block", (2 * F.col("rid") + F.col("v.version")).alias("sub"), "guest", "doc_id", "v.version", "v.text")
    info = F.struct("guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.when(F.col("version") == 1, F.sha2("text", 256)).alias("sha"))
    prints = fingerprints(versions, ["block", "sub"], info).withColumns({"version": F.col("sub") % 2, "rid": F.expr("sub div 2")})
    order = Window.partitionBy("block").orderBy("version", "sub")
    own_row = F.col("version") == 0
    pairs = prints.withColumn("next", F.lead("fingerprint").over(order)).groupBy("block", "rid").agg(
        F.max(F.when(own_row, F.col("info"))).alias("info"), F.max(F.when(own_row, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(own_row, F.col("next"))).alias("next"),
        F.max(F.when(~own_row, F.col("fingerprint"))).alias("edited_fingerprint"), F.max(F.when(~own_row, F.col("info.sha"))).alias("edited_sha256"),
    )
    return pairs.where("info.guest = 0").select(
        "info.doc_id", "info.n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
