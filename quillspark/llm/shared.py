"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = f"quillspark-{uuid.uuid4().hex}"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or one of our own where that is unset (tests).

    Only a local master may do without: executors of a cluster would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="quillspark-")
        base = f"file://{_OWN['dir']}"
    path = f"{base.rstrip('/')}/{_RUN}"
    if path not in _OWN:
        _OWN[path] = path
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes this run's tables when the driver ends; a session that has already stopped has nothing to ask."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at interpreter exit
        pass


def saved(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffle files of what is written when the driver has no reference to them left
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Bitmap:
    """A bit per cell of 64-bit keys as a scalar array: a test without misses that needs no shuffle.

    It has 32 cells for each of n distinct keys, between 2**12 and 2**MOST_BITS; beyond that more keys pass by chance, which a
    join has to sort out anyway.
    """

    MOST_BITS = 26

    def __init__(self, keys: DataFrame, n: int) -> None:
        self.bits = min(self.MOST_BITS, max(12, math.ceil(math.log2(max(1, 32 * n)))))
        place = self._place(F.col(keys.columns[0]))
        words = keys.select(F.shiftright(place, 6).cast("bigint").alias("id"), place.alias("p")).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("w"))
        every = keys.sparkSession.range(1 << (self.bits - 6)).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
        self.words = saved(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("words")), "bitmap").scalar()

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << self.bits).cast("bigint"))

    def may_have(self, key: str) -> Column:
        place = self._place(F.col(key))
        word = F.element_at(self.words, F.shiftright(place, 6).cast("int") + 1)
        return F.call_function("shiftrightunsigned", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def carried(documents: DataFrame, keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    """doc_id, text and the columns named in keep under names that no operator uses (but text), and these names."""
    names = ["text" if c == "text" else f"_kept{i}" for i, c in enumerate(keep or [])]
    return documents.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(keep or [], names, strict=True) if n != "text")), names


def back(result: DataFrame, keep: list[str] | None) -> DataFrame:
    """result with its kept columns under their own names; a kept column called like one of the results has `kept_` before its name."""
    own = [c for c in result.columns if c != "text" and not c.startswith("_kept")]
    return result.select(*own, *(F.col("text") if c == "text" else F.col(f"_kept{i}").alias(f"kept_{c}" if c in own else c) for i, c in enumerate(keep or [])))


def original(result: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as they were before an operator that was given them as `keep`."""
    return [F.col(f"`kept_{c}`" if f"kept_{c}" in result.columns and c in result.columns else f"`{c}`").alias(c) for c in columns]


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key is none of ids (one column of distinct bigints): an anti-join that moves only rows that may be dropped."""
    ids = saved(ids, "dropped")
    name = ids.columns[0]
    bitmap = Bitmap(ids, ids.count())
    maybe = F.coalesce(bitmap.may_have(key), F.lit(False))
    dropped = rows.filter(maybe).join(ids.withColumnRenamed(name, "_dropped"), F.col(key) == F.col("_dropped"), "left_anti")
    return rows.filter(~maybe).unionByName(dropped)
