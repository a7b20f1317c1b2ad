"""Windowed endpoint counts over a stream of entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hitpath.functions.request import endpoint
from hitpath.operators import trend
from hitpath.sources.scratch import scratch_dir
from hitpath.streaming.state import require_rocksdb


class _Signals(StatefulProcessor):
    """Compares each closed bucket of an endpoint with the one before, and emits the empty ones in between.

    State is the last bucket that was emitted and its count. A timer at the
    end of the next one emits it, and all that have closed since, if nothing
    came for them by then.
    """

    def __init__(self, origin_ms: int, interval_ms: int):
        self._origin_ms, self._interval_ms = origin_ms, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "step bigint, count bigint")

    def _goes_on(self, key, rows: list[tuple], step: int, count: int) -> pd.DataFrame:
        self._last.update((int(step), int(count)))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        # The bucket after the last one is over at the end of the step behind it.
        self._handle.registerTimer(self._origin_ms + (step + 2) * self._interval_ms)
        return pd.DataFrame([(*key, *row) for row in rows], columns=["method", "uri", "step", "count", "signal"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, before = self._last.get() if self._last.exists() else (-1, 0)
        found = []
        for step, count in sorted((int(s), int(c)) for chunk in rows for s, c in zip(chunk["step"], chunk["count"])):
            found += [(empty, 0, "zero") for empty in range(last + 1, step)]
            if step > last + 1:
                before = 0
            found.append((step, count, trend.signal_of(step, count, before)))
            last, before = step, count
        yield self._goes_on(key, found, last, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self._last.get()
        over = (timerValues.getCurrentWatermarkInMs() - self._origin_ms) // self._interval_ms
        empty = [(step, 0, "zero") for step in range(last + 1, over)]
        if empty:
            yield self._goes_on(key, empty, over - 1, 0)
        else:
            self._handle.registerTimer(self._origin_ms + (last + 2) * self._interval_ms)

    def close(self) -> None:
        pass


def signals(entries: DataFrame, interval: int, origin_us: int, delay: str) -> DataFrame:
    """``trend.trend_signals`` of a stream: every closed bucket of every endpoint seen so far, empty ones too.

    Buckets count from ``origin_us``, microseconds since the epoch, as no
    stream knows when its log began. An endpoint's buckets come out once the
    watermark, ``delay`` behind the latest request, has passed their end, those
    before its first request with the first. Requests before the origin are
    not counted. The session must use the RocksDB state store, see
    :func:`hitpath.streaming.transitions.use_rocksdb`.
    """
    require_rocksdb(entries.sparkSession)
    if interval <= 0:
        raise ValueError(f"an interval needs a positive number of seconds, not {interval}")
    size = interval * 1_000_000
    window = F.window("time", f"{interval} seconds", startTime=f"{origin_us % size} microseconds")
    counts = (
        entries.where(F.unix_micros("time") >= origin_us)
        .withWatermark("time", delay)
        .groupBy(window.alias("window"), "method", "uri")
        .agg(F.count("*").alias("count"))
    )
    step = F.call_function("div", F.unix_micros(F.col("window.start")) - F.lit(origin_us), F.lit(size).cast("bigint"))
    found = (
        counts.select("window", "method", "uri", step.alias("step"), "count")
        .groupBy("method", "uri")
        .transformWithStateInPandas(
            statefulProcessor=_Signals(-(-origin_us // 1000), interval * 1000),
            outputStructType="method string, uri string, step bigint, count bigint, signal string",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    return found.select(endpoint().alias("endpoint"), "method", "uri", "step", "count", "signal")


def windowed_counts(entries: DataFrame, interval: int, delay: str) -> DataFrame:
    """Requests per endpoint and tumbling window of ``interval`` seconds.

    Windows are aligned to the epoch. A window is final once the watermark,
    ``delay`` behind the latest request, passes its end; later rows for it are
    dropped.
    """
    if interval <= 0:
        raise ValueError(f"an interval needs a positive number of seconds, not {interval}")
    return (
        entries.withWatermark("time", delay)
        .groupBy(F.window("time", f"{interval} seconds").alias("window"), "method", "uri")
        .agg(F.count("*").alias("count"))
        .select(
            endpoint().alias("endpoint"),
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "count",
        )
    )


def run_append(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available in append mode and return the rows written.

    Rows go to Parquet files under ``path``; the checkpoint lets a restarted
    run continue where the last one stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, "stream-out")
    checkpoint = checkpoint or scratch_dir(spark, "stream-checkpoint")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
