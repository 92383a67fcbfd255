"""Exact dedup with an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.llm.shared import Bitmap, saved

CAPACITY, MAX_DEPTH = 8192, 22
"""Keys in a bucket, and doublings of the directory, which so has 4,194,304 cells at most. Beyond 2**31 keys the capacity grows instead."""
SLACK = 4
"""Doublings beyond the least that could do, worked out in one aggregate."""
SALTS = 8
"""At most so many partial groups of one text reach its owner, however many copies there are."""
RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """A-Z in lower case, other characters as they are; null is empty. For pure ASCII that is lower(), which is much faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _key(norm: Column, hash_bits: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(norm), 64 - hash_bits), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(norm)


def _cell(depth: int, key: str = "key") -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def _doubled(keys: DataFrame, capacity: int, depth: int) -> DataFrame:
    """The directory after `depth` doublings: cell, its bucket's local depth and number (its first cell), and keys of the cell."""
    cells = keys.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("n"))
    deep = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    fits = deep.groupBy("depth", "prefix").agg(F.sum("n").alias("size")).filter((F.col("size") <= capacity) | (F.col("depth") == depth))
    least = deep.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "size")).alias("b"))
    local = F.col("b.depth")
    return least.select("cell", local.alias("depth"), F.expr(f"shiftleft(shiftright(cell, {depth} - b.depth), {depth} - b.depth)").alias("bucket"), F.col("b.size").alias("size"))


class Directory:
    """The directory of distinct keys: a table (cell, depth, bucket, size) on shared files, and its buckets as an array of 2**depth.

    It starts as one bucket. While a bucket holds more than `capacity` keys, the directory doubles and the bucket splits by its
    next hash bit. The first doublings, which a uniform hash needs, are worked out in one aggregate; further ones follow only
    while a bucket stays overfull.
    """

    def __init__(self, keys: DataFrame, n_keys: int, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> None:
        spark = keys.sparkSession
        self.capacity = max(capacity, n_keys >> max(0, max_depth - SLACK))
        self.depth = min(max_depth, max(1, math.ceil(math.log2(max(1, n_keys / self.capacity))) + SLACK))
        while True:
            self.table = saved(_doubled(keys, self.capacity, self.depth), "directory")
            if self.depth == max_depth or self.table.filter(F.col("size") > self.capacity).isEmpty():
                break
            self.depth = min(max_depth, self.depth + SLACK)
        cells = spark.range(1 << self.depth).select(F.col("id").cast("int").alias("cell")).join(self.table, "cell", "left").select("cell", F.coalesce("bucket", "cell").alias("bucket"))
        whole = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "bucket"))), lambda x: x["bucket"]).alias("buckets"))
        self.buckets = saved(whole, "directory-cells").scalar()

    def bucket(self, key: str = "_key") -> Column:
        return F.element_at(self.buckets, _cell(self.depth, key) + 1)


class Index:
    """The extendible-hash index of normalised texts.

    Rows are keyed by a 64-bit hash. Keys that several rows have are dealt to buckets by the directory, a bucket being a range of
    keys with one owner. Keys of a single row need no entry. A bitmap of the other keys holds back all other texts, so only texts
    that may have copies move.
    """

    def __init__(self, keys: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> None:
        self.hash_bits = hash_bits
        several = saved(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "exact-keys")
        n_keys = several.count()
        self.directory = Directory(several, n_keys, capacity, max_depth)
        self.bitmap = Bitmap(several, n_keys)

    def _owned(self, rows: DataFrame, partial: list[Column], total: list[Column]) -> DataFrame:
        """Rows (_key, _norm, _salt and what the aggregates read) by owner: one row per bucket, key and text.

        A task first groups the rows it has read and salts split what is left of a text's copies, so an owner gets at most SALTS
        rows of a text. Within a bucket the owner compares the texts of a key byte by byte.
        """
        few = rows.withColumn("_bucket", self.directory.bucket()).groupBy("_bucket", "_key", "_norm", "_salt").agg(*partial)
        return few.repartition("_bucket").groupBy("_bucket", "_key", "_norm").agg(*total)

    def entries(self, documents: DataFrame) -> DataFrame:
        """A table in the shared folder: _bucket, _key, _chain, _chains, _size, _keep, and _norm where a key has several texts.

        Texts that share a key are chained: numbered from 1 in order of their bytes.
        """
        rows = keyed(documents, self.hash_bits).filter(self.bitmap.may_have("_key"))
        owned = self._owned(rows, [F.count("*").alias("_n"), F.max("_doc").alias("_keep")], [F.sum("_n").alias("_size"), F.max("_keep").alias("_keep")])
        key = W.partitionBy("_bucket", "_key")
        chained = owned.withColumn("_chains", F.count("*").over(key)).withColumn("_chain", F.row_number().over(key.orderBy("_norm")))
        return saved(chained.withColumn("_norm", F.when(F.col("_chains") > 1, F.col("_norm"))), "exact-index")

    def kept(self, rows: DataFrame) -> DataFrame:
        """Of rows with _row (all their columns), those that stay."""
        by = F.struct("_doc", "_tie")
        owned = self._owned(
            rows.filter(self.bitmap.may_have("_key")),
            [F.max_by("_row", by).alias("_row"), F.max(by).alias("_by")],
            [F.max_by("_row", F.col("_by")).alias("_row")],
        )
        return rows.filter(~self.bitmap.may_have("_key")).select("_row.*").unionByName(owned.select("_row.*"))


def keyed(documents: DataFrame, hash_bits: int, *more: Column) -> DataFrame:
    """_doc, _norm, _key and _salt of each row."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("_doc"), normalised(F.col("text")).alias("_norm"), *more)
    return rows.withColumn("_key", _key(F.col("_norm"), hash_bits)).withColumn("_salt", F.pmod(F.hash("_doc"), F.lit(SALTS)))


def exact_groups(documents: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256; other columns follow, but text.

    Texts are equal when identical after lower-casing A-Z; null equals the empty text. Of equal texts the row with the largest
    doc_id stays. Rows that repeat a doc_id and its text are counted each and marked alike. A null doc_id is less than any other;
    where all ids of a group are null, keep_id is null and all its rows are kept. Columns called like a result are left out.
    An empty table gives an empty result. hash_bits can be lowered to force chains.

    A row finds its entry by its key, whose texts the owner has found equal; where the owner has chained several texts under a
    key, the row's text is compared with theirs. Rows whose key no other row has are groups of one.
    """
    extra = [c for c in documents.columns if c not in (*RESULT, "text")]
    source = documents.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)))
    carried = [F.col(f"_x{i}") for i in range(len(extra))]
    narrow = saved(keyed(source, hash_bits, *carried).select("_doc", "_key", F.sha2("_norm", 256).alias("_sha"), *carried), "exact-rows")
    index = Index(narrow.select(F.col("_key").alias("key")), capacity=capacity, max_depth=max_depth, hash_bits=hash_bits)
    entries = index.entries(source)

    heads = entries.filter("_chain = 1").select("_key", "_chains", "_size", "_keep")
    rows = narrow.join(heads, "_key", "left")
    alone = F.col("_chains").isNull()
    found = rows.filter(alone | (F.col("_chains") == 1)).withColumn("_keep", F.when(alone, F.col("_doc")).otherwise(F.col("_keep"))).withColumn("_size", F.coalesce("_size", F.lit(1)))
    columns = ["_doc", "_keep", "_size", "_sha", *(f"_x{i}" for i in range(len(extra)))]
    found = found.select(*columns)
    chained = entries.filter("_chains > 1")
    if not chained.isEmpty():
        texts = keyed(source, hash_bits, *carried).join(chained.select("_key").distinct(), "_key", "left_semi")
        met = texts.join(chained.select("_key", "_norm", "_size", "_keep"), ["_key", "_norm"]).withColumn("_sha", F.sha2("_norm", 256))
        found = found.unionByName(met.select(*columns))
    kept = F.col("_doc").eqNullSafe(F.col("_keep"))
    return found.select(
        F.col("_doc").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").cast("bigint").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"), *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra))
    )


def drop_copies(documents: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> DataFrame:
    """The documents that stay, with the columns of documents; a repeated row (same doc_id and text) stays once.

    Rows without copies aren't shuffled. Of the others the owners get whole rows, the one with the largest doc_id of each text per
    task; rows that differ only in further columns are told apart by a hash of these. A group of null ids keeps one row.
    """
    hashable = [F.col(f"`{f.name}`") for f in documents.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = keyed(documents, hash_bits, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), F.xxhash64(*hashable).alias("_tie"))
    index = Index(rows.select(F.col("_key").alias("key")), capacity=capacity, max_depth=max_depth, hash_bits=hash_bits)
    return index.kept(rows).select(*(F.col(f"`{c}`") for c in documents.columns))
