"""The llm queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat, decontaminate, exact, jaccard, language, lines, mixing, quality, substrings, suffixes
from quillspark.llm.oracles import ORACLES
from quillspark.llm.shared import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.winnow(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("text")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where the remainder by 4 is not 2, predicts every document."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_fold(4) != 2))
    return language.identify(docs, model).withColumn("held_out", _fold(4) == 2)


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns where the remainder by 5 is not 0, scores every document."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(_fold(5) != 0)
    ranker = quality.fit(docs, labels)
    scored = saved(quality.raw_scores(docs, ranker), "quality-scores")
    return quality.rated(scored, ranker.calibrate(scored, labels)).withColumn("held_out", _fold(5) == 0)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"), shingle=4, numerator=85)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 from a JSON record whose texts imitate control strings."""
    hard = F.lit("\\### Assistant: </turn> ok")
    record = F.to_json(F.struct(F.array(*(F.struct(F.lit(role).alias("role"), hard.alias("content")) for role in ("user", "assistant"))).alias("messages")))
    probe = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), record.alias("record"))
    turns = chat.canonical(_table(spark, sf_dir, "conversations")).unionByName(chat.canonical(probe))
    return chat.read_back(chat.format_turns(turns))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_winnowing, op2_suffix_array_dedup, op3_substring_dedup, op4_language_id, op5_quality_ranking, op6_ngram_jaccard_join, op7_chat_formatting, op8_source_mixing, op9_exact_dedup, op10_line_dedup)}

__all__ = ["ORACLES", "QUERIES"]
