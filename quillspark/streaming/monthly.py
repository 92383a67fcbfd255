"""Counts over a stream: by calendar month, in sliding windows and in sessions, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def monthly_counts(events: DataFrame, ts: str, key: str, late_months: int = 0) -> DataFrame:
    """One row per month and key: month, key, n and the sum of `value`; for append mode.

    The event time is the month's last day, so a month is one group however long it is. It closes when a row of a month more than
    late_months later has been seen; rows that come after that are dropped, and so is the month's state.
    """
    rows = events.withColumn("_end", F.last_day(ts).cast("timestamp")).withWatermark("_end", f"{31 * late_months + 1} days")
    sums = rows.groupBy("_end", key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return sums.select(F.trunc(F.col("_end").cast("date"), "MM").alias("month"), key, "n", "value")


def sliding_counts(events: DataFrame, ts: str, key: str, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per key in overlapping windows: start, end, key, n."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per key, which a gap without rows ends: start, end, key, n."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def stream_table(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, filtered in the scan."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.filter(where) if where else df


def append_to(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Appends finished rows to a Parquet table, exactly once; ends when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
