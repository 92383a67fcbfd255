"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.shared import saved

WEIGHTS = (3, 1, 2)
SLOTS = 1 << 16
BLOCK_WORDS = 1 << 20
"""Least number of slots of a mix that is large enough, and words of a block at most: beyond their product there are more slots."""
MOST = 2
FINE = 256
"""Sources whose target is fewer blocks than this are filled exactly; for others the points' unevenness is a small part."""
GOLDEN = 2654435769
"""2**32 divided by the golden ratio, rounded to odd: its multiples modulo 2**32 are the golden-ratio points."""


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    blank = r"\x20\x09-\x0D"
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, f"[^{blank}]+[{blank}]*", "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def _sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, key (a non-null name of the source), size; rows that repeat a doc_id and source are one document."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return rows.withColumn("key", key).groupBy("doc_id", "key").agg(F.max("source").alias("source"), F.sum("size").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: key, source_size, target, lo and hi (its part of the range 0 to 2**32).

    All sources share 150 % of all words by weight; a target stops at MOST times the source's size and the excess goes to
    the others by weight. Filling stops at the least ratios of size to weight first, so one ordered pass finds the level.
    """
    by = sizes.groupBy("key").agg(F.sum("size").alias("s"))
    rank = F.row_number().over(W.orderBy("key"))  # "~" (null) sorts behind "s..."
    named = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    order = W.orderBy(F.col("s") / F.col("w"), "key")
    before, rest, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = named.select("*", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("c"), F.sum("w").over(rest).alias("wr"), F.sum("s").over(everything).alias("total"))
    full = filled.withColumn("capped", 2 * MOST * F.col("s") * F.col("wr") <= (3 * F.col("total") - 2 * MOST * F.col("c")) * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct("c", "wr"))).over(W.partitionBy())
    leveled = full.withColumn("level", level)
    share = F.when(F.col("capped"), (MOST * F.col("s")).cast("double")).otherwise((3 * F.col("total") - 2 * MOST * F.col("level.c")) / F.lit(2.0) * F.col("w") / F.col("level.wr"))
    upto = F.sum("target").over(W.orderBy("key"))
    cut = lambda x: F.when(F.col("total") > 0, F.round(x / (1.5 * F.col("total")) * float(1 << 32))).otherwise(0).cast("bigint")
    out = leveled.withColumn("target", share).withColumn("upto", upto)
    return out.select("key", F.col("s").alias("source_size"), "target", "total", cut(F.col("upto") - F.col("target")).alias("lo"), cut(F.col("upto")).alias("hi"))


def _running(rows: DataFrame, bucket: str, order: list[str], value: Column) -> DataFrame:
    """Adds `before`, the sum of value over the rows of the same key that come earlier by bucket and order.

    Sums of a key's buckets are added up first, so no task holds more than a bucket of a key, however large the key is.
    """
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy("key", bucket).agg(F.sum("_v").alias("_n"))
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_n").over(W.partitionBy("key").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.coalesce(F.sum("_v").over(W.partitionBy("key", bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inner).join(offsets, ["key", bucket]).withColumn("before", F.col("_off") + F.col("_in")).drop("_v", "_in", "_off")


def _block(n_slots: int) -> Column:
    """Words of a block: the mix's words by slots, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.col("total") * 1.5 / n_slots)).cast("bigint")


def _limited(shares: DataFrame, n_slots: int) -> DataFrame:
    """Adds words, the exact number that a source of few blocks gives; null where the points decide."""
    return shares.withColumn("words", F.when(F.col("target") < FINE * _block(n_slots), F.round("target").cast("bigint")))


def slots(spark: SparkSession, shares: DataFrame, n_slots: int) -> DataFrame:
    """The schedule: slot, key and block (the slot's rank in its source). Slots order the mix; each has one source.

    Slot k << 32 has the golden-ratio point k. The blocks of a source of few blocks, the last one partial, stand evenly
    behind such slots, in slots of their own (k << 32 and the source's rank).
    """
    cell = 20
    used = F.ceil(F.col("total") * 1.5 / _block(n_slots))
    few = shares.filter("words > 0").select("key", used.alias("used"), F.ceil(F.col("words") / _block(n_slots)).alias("n"), F.row_number().over(W.orderBy("key")).cast("bigint").alias("rank"))
    few = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    few = few.select(F.expr("shiftleft((2 * block + 1) * used div (2 * n), 32) + rank").alias("slot"), "key", "block")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}L) % {1 << 32}L").alias("point")).withColumn("cell", F.shiftright("point", cell))
    ranges = shares.filter("hi > lo AND words IS NULL").select("key", "lo", "hi", used.alias("used"), F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("hi") - 1, cell))).alias("cell"))
    dealt = points.join(ranges, "cell").filter("point >= lo AND point < hi AND slot < used").select("slot", "key", F.shiftright("slot", 8).alias("part"))
    return _running(dealt, "part", ["slot"], F.lit(1)).select(F.shiftleft("slot", 32).alias("slot"), "key", F.col("before").alias("block")).union(few)


def schedule(documents: DataFrame, *, n_slots: int = SLOTS, seed: str = "", weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as rows (slot, source key, block, doc_id, start, tokens), and the sizes and targets it is made from.

    The documents of a source are shuffled by a seeded hash and cut into blocks of equal tokens; a second pass through
    the source follows the first. The r-th slot of a source takes its block r. Blocks past MOST passes don't exist, so
    no document is taken more often. n_slots blocks make up the mix, or as many of BLOCK_WORDS words as it takes, besides those of
    sources of fewer than FINE blocks, which give exactly their target in words; small mixes have fewer, of one word each.
    """
    spark = documents.sparkSession
    sizes = saved(_sizes(documents), "mix-sizes")
    shares = saved(targets(sizes, weights), "mix-targets")
    total = shares.agg(F.max("total")).first()[0] or 0
    n_slots = max(n_slots, -(-3 * int(total) // (2 * BLOCK_WORDS)))
    shares = _limited(shares, n_slots)
    shuffled = sizes.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).withColumn("part", F.substring("order", 1, 3))
    placed = _running(shuffled.filter("size > 0"), "part", ["order", "doc_id"], F.col("size")).join(shares, "key").withColumn("block_size", _block(n_slots))
    passes = placed.withColumn("at", F.explode(F.transform(F.array(*map(F.lit, range(MOST))), lambda p: F.col("before") + p * F.col("source_size"))))
    passes = passes.withColumn("upto", F.least(F.col("at") + F.col("size"), F.col("words"))).filter("at < upto")
    spans = passes.withColumn("block", F.explode(F.sequence(F.expr("at div block_size"), F.expr("(upto - 1) div block_size"))))
    begin, end = F.greatest("at", F.col("block") * F.col("block_size")), F.least(F.col("upto"), (F.col("block") + 1) * F.col("block_size"))
    spans = spans.select("key", "block", "doc_id", (begin - F.col("at")).alias("start"), (end - begin).alias("tokens"))
    return spans.join(slots(spark, shares, n_slots), ["key", "block"]).select("slot", "key", "block", "doc_id", "start", "tokens"), sizes, shares


def mix(documents: DataFrame, *, n_slots: int = SLOTS, seed: str = "", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words in the mix, repeats counted).

    Sizes count `[^\\x20\\x09-\\x0D]+` words; a null text has none. Sources are weighed in code point order, null last.
    Documents without words take none. Rows that repeat a doc_id and source are one document of their summed size.
    A rerun gives the same mix. An empty table gives an empty result.
    """
    plan, sizes, shares = schedule(documents, n_slots=n_slots, seed=seed, weights=weights)
    taken = plan.groupBy("key", "doc_id").agg(F.sum("tokens").alias("taken"))
    rows = sizes.join(shares.select("key", "source_size", "target"), "key").join(taken, ["key", "doc_id"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
