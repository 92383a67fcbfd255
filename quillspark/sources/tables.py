"""Reading with explicit schemas, and writing that fails closed."""

from __future__ import annotations

import contextlib
import json
import logging
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("quillspark")

# Schemas of the study's inputs.
SCHEMAS = {
    "ai_monthly": "month date, ai_papers bigint, total_citations bigint, avg_citations double",
    "ai_monthly_subfield": "month date, ai_subfield string, ai_paper_count bigint",
    "prices_daily": "Date date, Ticker string, Adj_Close double",
    "paper_company_panel": "work_id string, institution_name string, publication_date date, categories string, cited_by_count bigint, arxiv_id string",
    "rd_expense_annual": "ticker string, cik bigint, fiscal_year int, fiscal_period_end string, rd_expense_usd bigint, form string, tag_used string",
    "crsp_monthly": "permno int, permco int, ticker string, issuernm string, naics int, mthcaldt date, mthret double, mthcap double, vwretd double, n_papers int",
    "raw_publications": "publication_number string, application_number string, kind_code string, filing_date string, publication_date string, title string, abstract string, cpc_codes string, matched_assignees string",
    "cpc_symbols": "symbol string, title string",
    "arxiv_metadata": "id string, categories string, update_date string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (Parquet keeps its own schema; columns and filters are pushed to the scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None, *, multi_line: bool = False) -> DataFrame:
    """A CSV file with header. Quoted fields may hold line ends with multi_line; invalid UTF-8 is replaced, not refused."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("maxCharsPerColumn", -1).csv(path)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, where: str | None = None) -> DataFrame:
    """Newline-delimited JSON; only the schema's fields are parsed and the filter is applied in the scan."""
    df = spark.read.schema(schema).json(path)
    return df.filter(where) if where else df


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """A code list: symbol and title, trimmed, rows without a symbol left out."""
    df = read_csv(spark, path, SCHEMAS["cpc_symbols"])
    return df.select(F.trim("symbol").alias("symbol"), F.trim("title").alias("title")).filter("symbol <> ''")


def read_config(text: str) -> Any:  # noqa: ANN401
    """A JSON configuration (rules, aliases, concordance), on the driver: bounded by what a person maintains."""
    return json.loads(text)


def write_config(path: str, value: Any) -> None:  # noqa: ANN401
    """A JSON configuration, written beside its place and then moved there."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    part.replace(path)


@contextlib.contextmanager
def diagnostics(path: str) -> Iterator[logging.Logger]:
    """The logger, with its lines on the console and in a new file as well; both end with the block, also after an error."""
    handlers = [logging.StreamHandler(), logging.FileHandler(path, mode="w", encoding="utf-8")]
    level = log.level
    for h in handlers:
        h.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)
    try:
        yield log
    finally:
        log.setLevel(level)
        for h in handlers:
            log.removeHandler(h)
            h.close()


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read; the last error is raised if none can."""
    error: Exception | None = None
    for source in sources:
        try:
            return source()
        except Exception as e:  # noqa: BLE001  any reader may fail in its own way
            error = e
            log.info("source not available: %s", e)
    raise error or ValueError("no source")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame], *, force: bool = False) -> DataFrame:
    """A table that is made once; later calls read it."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require_schema(df: DataFrame, expected: str | T.StructType) -> DataFrame:
    """df if its columns and types are exactly the expected ones."""
    wanted = df.sparkSession.createDataFrame([], expected).schema if isinstance(expected, str) else expected
    have = [(f.name, f.dataType) for f in df.schema]
    if have != [(f.name, f.dataType) for f in wanted]:
        raise ValueError(f"columns are {df.schema.simpleString()}, not {wanted.simpleString()}")
    return df


def require_empty(bad: DataFrame, what: str) -> None:
    """Raises with a few examples if there is any row."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def require_subset(rows: DataFrame, known: DataFrame, keys: list[str], what: str) -> None:
    """Every key of rows is among the known ones."""
    require_empty(rows.select(*keys).distinct().join(known.select(*keys), keys, "left_anti"), what)


def publish(df: DataFrame, path: str, *, expect_rows: int | None = None, partition_by: list[str] | None = None) -> int:
    """Writes beside the target, checks the number of rows as read back, then moves it into place. Returns that number.

    The old table is moved aside first and deleted last; if the new one can't be moved, the old one is put back.
    """
    spark, staging = df.sparkSession, f"{path}.staging"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    n = spark.read.parquet(staging).count() if df.columns else 0
    if expect_rows is not None and n != expect_rows:
        raise ValueError(f"{path}: {n} rows, not {expect_rows}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, new, old = place(path), place(staging), place(f"{path}.old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{staging} can't be moved to {path}")
    fs.delete(old, True)
    return n


def export_csv(df: DataFrame, path: str) -> None:
    """CSV for people: one file with header. For tables of report size; larger ones stay Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cost(df: DataFrame) -> str:
    """The optimizer's estimate before anything runs."""
    return df._jdf.queryExecution().explainString(df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))


def union_pages(pages: Iterable[DataFrame]) -> DataFrame:
    """Pages by column name; missing columns are null."""
    it = iter(pages)
    out = next(it)
    for page in it:
        out = out.unionByName(page, allowMissingColumns=True)
    return out
