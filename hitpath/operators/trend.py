"""Hits per endpoint and time bucket."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitpath.functions.request import endpoint
from hitpath.functions.values import bucket

# The names users sort by.
SORT_KEYS = ("method", "uri", "sum", "count0", "count1", "countn")


def _check(interval: int) -> None:
    if interval <= 0:
        raise ValueError(f"an interval needs a positive number of seconds, not {interval}")


def period(entries: DataFrame) -> DataFrame:
    """One row: the first and the last request time."""
    return entries.agg(F.min("time").alias("origin"), F.max("time").alias("end"))


def origin(entries: DataFrame) -> Column:
    """The first request time as a scalar subquery."""
    return period(entries).select("origin").scalar()


def last_step(entries: DataFrame, interval: int) -> Column:
    """Index of the last bucket as a scalar subquery."""
    return period(entries).select(bucket(F.col("end"), F.col("origin"), interval)).scalar()


def endpoint_counts(entries: DataFrame) -> DataFrame:
    """Requests per endpoint."""
    return (
        entries.groupBy("method", "uri")
        .agg(F.count("*").alias("count"))
        .select(endpoint().alias("endpoint"), "method", "uri", "count")
    )


def trend_counts(entries: DataFrame, interval: int) -> DataFrame:
    """Requests per endpoint and bucket, leaving out empty buckets."""
    _check(interval)
    step = bucket(F.col("time"), origin(entries), interval)
    return (
        entries.select("method", "uri", step.alias("step"))
        .groupBy("method", "uri", "step")
        .agg(F.count("*").alias("count"))
        .select(endpoint().alias("endpoint"), "method", "uri", "step", "count")
    )


def _neighbours(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("method", "uri").orderBy("step")
    return counts.withColumns(
        {
            "_prev_step": F.lag("step").over(w),
            "_prev_count": F.lag("count").over(w),
            "_next_step": F.lead("step").over(w),
        }
    )


def _signal(step: Column, count: Column, prev: Column) -> Column:
    return (
        F.when((step > 0) & (count * 2 > prev * 3), F.lit("up"))
        .when(count == 0, F.lit("zero"))
        .when((step > 0) & (count * 3 < prev * 2), F.lit("down"))
        .otherwise(F.lit(""))
    )


def signal_of(step: int, count: int, prev: int) -> str:
    """The flag of one bucket, by the rule of ``trend_signals``."""
    if step > 0 and count * 2 > prev * 3:
        return "up"
    if count == 0:
        return "zero"
    return "down" if step > 0 and count * 3 < prev * 2 else ""


def trend_signals(entries: DataFrame, interval: int, dense: bool = True) -> DataFrame:
    """Counts with a surge or drop flag against the bucket before.

    The flags come from the non-empty buckets alone. ``dense=True`` adds a
    row for each empty bucket, spread out of the preceding non-empty one.
    """
    near = _neighbours(trend_counts(entries, interval))
    prev = F.when(F.col("_prev_step") == F.col("step") - 1, F.col("_prev_count")).otherwise(F.lit(0))
    flagged = near.withColumn("signal", _signal(F.col("step"), F.col("count"), prev))
    if not dense:
        return flagged.select("endpoint", "method", "uri", "step", "count", "signal")
    begin = F.when(F.col("_prev_step").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("step"))
    stop = F.coalesce(F.col("_next_step") - 1, last_step(entries, interval))
    hit = F.col("at") == F.col("step")
    return flagged.withColumn("at", F.explode(F.sequence(begin, stop))).select(
        "endpoint",
        "method",
        "uri",
        F.when(hit, F.col("count")).otherwise(F.lit(0)).alias("count"),
        F.when(hit, F.col("signal")).otherwise(F.lit("zero")).alias("signal"),
        F.col("at").alias("step"),
    ).select("endpoint", "method", "uri", "step", "count", "signal")


def trend_vectors(entries: DataFrame, interval: int) -> DataFrame:
    """One row per endpoint with its zero-filled counts and their sum.

    The vector has one element per bucket of the whole log: pick the interval
    with that in mind, or stay with :func:`trend_counts`.
    """
    found = (
        trend_counts(entries, interval)
        .groupBy("endpoint", "method", "uri")
        .agg(
            F.sum("count").alias("sum"),
            F.sort_array(F.collect_list(F.struct("step", "count"))).alias("_hits"),
        )
    )
    # Only non-empty buckets are gathered; each brings the zeros before it.
    hits = F.col("_hits")
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n.cast("int"))
    before = lambda i: F.coalesce(F.get(hits, i - 1)["step"], F.lit(-1))
    filled = F.transform(hits, lambda hit, i: F.concat(zeros(hit["step"] - before(i) - 1), F.array(hit["count"])))
    tail = zeros(last_step(entries, interval) - F.element_at(hits, -1)["step"])
    return found.select("endpoint", "method", "uri", "sum", F.concat(F.flatten(filled), tail).alias("counts"))


def parse_sort(keys: Iterable[str]) -> list[tuple[str, bool]]:
    """``"key:order"`` texts as ``(key, ascending)``; unknown ones are ignored."""
    parsed = []
    for text in keys:
        key, _, order = text.strip().lower().partition(":")
        if key in SORT_KEYS and order in ("", "asc", "desc"):
            parsed.append((key, order != "desc"))
    return parsed


def sort_trend(vectors: DataFrame, keys: Iterable[str] = ("sum:desc",)) -> DataFrame:
    """Order trend vectors, by falling sum if no key is given; equal rows are ordered by URI and method."""
    keys = list(keys) or ["sum:desc"]
    counts = F.col("counts")
    columns = {
        "method": F.col("method"),
        "uri": F.col("uri"),
        "sum": F.col("sum"),
        "count0": F.get(counts, 0),
        "count1": F.get(counts, 1),
        "countn": F.element_at(counts, -1),
    }
    order = [columns[k].asc() if up else columns[k].desc() for k, up in parse_sort(keys)]
    return vectors.orderBy(*order, "uri", "method")


def trend_wide(entries: DataFrame, interval: int, steps: int | None = None) -> DataFrame:
    """One column per bucket, named by its offset in seconds.

    The columns have to be known before the query is planned. Without
    ``steps`` their number is read from the log's first and last time.
    """
    _check(interval)
    limit = int(entries.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if steps is None:
        bounds = period(entries)
        steps = bounds.select(bucket(F.col("end"), F.col("origin"), interval) + 1).first()[0] or 0
    if steps > limit:
        raise ValueError(f"{steps} buckets exceed spark.sql.pivotMaxValues={limit}; use trend_counts")
    offsets = [i * interval for i in range(steps)]
    return (
        trend_counts(entries, interval)
        .withColumn("offset", F.col("step") * interval)
        .groupBy("method", "uri")
        .pivot("offset", offsets)
        .agg(F.sum("count"))
        .na.fill(0)
    )
