"""Parsed entries as Parquet, and result files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Timestamp = str | datetime


def write_entries(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store parsed entries by day.

    Text has to be parsed in full on every scan; the Parquet copy lets the
    analyses read only the columns they use and skip days a filter on
    ``date`` rules out. Rows are brought together by day first, so a day has few
    files; adaptive execution splits large days into several tasks. Rows are
    in order of time and ``ord`` inside each file.
    """
    (
        entries.withColumn("date", F.to_date("time"))
        .hint("rebalance", F.col("date"))
        .sortWithinPartitions("date", "time", "ord")
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def read_entries(spark: SparkSession, path: str, since: Timestamp | None = None, until: Timestamp | None = None) -> DataFrame:
    """Stored entries, with ``since`` and ``until`` those of ``since <= time < until``.

    Days that the bounds rule out are not read: the bounds also limit ``date``,
    by a day more on either side, as it was written in the time zone of
    another session perhaps. Texts are read as Spark reads timestamps; a datetime
    without a zone is one of the session.
    """
    entries = spark.read.parquet(path)
    time, date = F.col("time"), F.col("date")
    if since is not None:
        begin = F.lit(since).cast("timestamp")
        entries = entries.where((time >= begin) & (date >= F.date_sub(F.to_date(begin), 1)))
    if until is not None:
        end = F.lit(until).cast("timestamp")
        entries = entries.where((time < end) & (date <= F.date_add(F.to_date(end), 1)))
    return entries


def replay_entries(entries: DataFrame, path: str, parts: int = 4) -> Iterator[DataFrame]:
    """Store entries by ascending time in ``parts`` steps; after each step yields the stream of all stored files.

    A query that goes on from one checkpoint thus sees a part at a time, and
    later requests in later micro-batches.
    """
    spark = entries.sparkSession
    second = F.unix_seconds("time")
    low, high = entries.agg(F.min(second), F.max(second)).first()
    if low is None:
        return
    for i in range(parts):
        begin, end = (low + (high + 1 - low) * k // parts for k in (i, i + 1))
        entries.where((second >= begin) & (second < end)).write.mode("append").parquet(path)
        yield spark.readStream.schema(entries.schema).parquet(path)


def write_report(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a result table as CSV or TSV with a header, as JSON or as Parquet."""
    writer = df.write.mode(mode)
    if format in ("csv", "tsv"):
        sep = "," if format == "csv" else "\t"
        writer.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
    elif format in ("json", "parquet"):
        writer.format(format).save(path)
    else:
        raise ValueError(f"format should be csv, tsv, json or parquet, but: {format}")
