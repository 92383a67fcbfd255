"""Sources that come in pieces: reported facts with fallback names, paged downloads that can be resumed, finished jobs by schema."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions import lexicon as lx
from quillspark.sources.tables import exists, log, publish, require_schema

FACTS = "ticker string, cik string, tag string, start string, end string, filed string, fy int, fp string, form string, value double"


@dataclass
class Firm(InputPartition):
    ticker: str
    cik: str


class FactsSource(DataSource):
    """spark.read.format("reported_facts"): facts of firms from a service of JSON documents.

    Options: `base` (a URL; documents are {base}/CIK{cik of ten digits}/{tag}.json, for tests file:// works as well), `firms`
    (ticker=cik, comma-separated), `tags` (in order of preference), `agent` (who asks), `pause` (seconds between requests) and
    `retries`. Each firm is a partition; of its tags the first that has facts is taken. A document that doesn't exist is no fact.
    """

    @classmethod
    def name(cls) -> str:
        return "reported_facts"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema: T.StructType) -> FactsReader:  # noqa: ARG002
        return FactsReader(self.options)


class FactsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base, self.agent = options["base"].rstrip("/"), options.get("agent", "quillspark")
        self.firms = [Firm(*(x.strip() for x in f.split("="))) for f in options["firms"].split(",")]
        self.tags = options.get("tags", ",".join(lx.RD_TAGS)).split(",")
        self.pause, self.retries = float(options.get("pause", "0.12")), int(options.get("retries", "4"))

    def partitions(self) -> Sequence[InputPartition]:
        return self.firms

    def _document(self, url: str) -> dict | None:
        for attempt in range(self.retries):
            time.sleep(self.pause * 2**attempt)
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=60) as r:  # noqa: S310
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if attempt + 1 == self.retries:
                    raise
            except urllib.error.URLError as e:
                if isinstance(e.reason, FileNotFoundError):
                    return None
                if attempt + 1 == self.retries:
                    raise
        return None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cik = partition.cik.zfill(10)
        for tag in self.tags:
            document = self._document(f"{self.base}/CIK{cik}/{tag}.json")
            facts = (document or {}).get("units", {}).get("USD", [])
            if facts:
                for f in facts:
                    yield (partition.ticker, cik, tag, f.get("start"), f.get("end"), f.get("filed"), f.get("fy"), f.get("fp"), f.get("form"), float(f["val"]))
                return


def first_reported(facts: DataFrame, firm: str, tag: str, tags: Sequence[str] = lx.RD_TAGS) -> DataFrame:
    """The facts of each firm under the first of the tags that it reports at all."""
    place = F.array_position(F.array(*map(F.lit, tags)), F.col(tag))
    known = facts.withColumn("_place", place).filter("_place > 0")
    best = known.groupBy(firm).agg(F.min("_place").alias("_place"))
    return known.join(best, [firm, "_place"]).drop("_place")


@dataclass(frozen=True)
class Job:
    name: str
    finished: str
    ok: bool
    table: Callable[[], DataFrame]


def latest_job(jobs: Iterable[Job], expected: str) -> Job:
    """The job that finished last, of those that succeeded and whose table has exactly the expected columns."""
    for job in sorted((j for j in jobs if j.ok), key=lambda j: j.finished, reverse=True):
        try:
            require_schema(job.table(), expected)
        except ValueError as e:
            log.info("job %s: %s", job.name, e)
            continue
        return job
    raise ValueError(f"no finished job has the columns {expected}")


def download_pages(spark: SparkSession, fetch: Callable[[int], DataFrame], sizes: Sequence[int], path: str, *, retries: int = 4, pause: float = 1.0) -> int:
    """Downloads pages 0, 1, ... into path/page=N; sizes are the rows that each should have. Returns the number of all rows.

    A page is published only with its full number of rows, after so many tries at most. Pages that are there already are skipped if
    they are complete and fetched again if not, so a broken download goes on where it stopped.
    """
    for page, size in enumerate(sizes):
        target = f"{path}/page={page}"
        if exists(spark, f"{target}/_SUCCESS") and spark.read.parquet(target).count() == size:
            continue
        for attempt in range(retries):
            try:
                publish(fetch(page), target, expect_rows=size)
                break
            except Exception as e:
                log.warning("page %d, try %d: %s", page, attempt + 1, e)
                if attempt + 1 == retries:
                    raise
                time.sleep(pause * 2**attempt)
    n = spark.read.parquet(path).count() if sizes else 0
    if n != sum(sizes):
        raise ValueError(f"{path}: {n} rows, not {sum(sizes)}")
    return n
