"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, decontamination, source mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, exact, jaccard, language, mixing, oracles
from quillspark.llm.shared import original, saved, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null or have no letter go. A null lang becomes the predicted one.

    The model learns from the documents that have a lang; without any, lang stays null. Repeated rows stay repeated.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model, keep=docs.columns).filter(F.col("lang_pred") != "und")
    return found.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else own for c, own in zip(docs.columns, original(found, docs.columns), strict=True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, the one with the largest doc_id; null ids are least, a repeated row stays once."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id. Rows with a null doc_id stay."""
    gone = jaccard.link(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, gone, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items; null and empty texts stay, repeated rows stay repeated."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.winnow(docs, benchmark, keep=docs.columns).filter(~F.col("contaminated"))
    return found.select(*original(found, docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes; documents without words take none."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL: str | None = rf"""
WITH p1 AS (SELECT * FROM documents WHERE regexp_matches(text, '\p{{L}}')),
p2 AS (SELECT p1.* FROM p1 JOIN ({oracles.exact_dedup("p1")}) x USING (doc_id) WHERE x.kept),
p3 AS (SELECT p2.* FROM p2 JOIN ({oracles.jaccard_join("p2")}) x USING (doc_id) WHERE x.component_id = p2.doc_id),
p4 AS (SELECT p3.* FROM p3 JOIN ({oracles.winnowing("p3")}) x USING (doc_id) WHERE NOT x.contaminated)
SELECT * FROM ({oracles.source_mixing("p4")})"""
