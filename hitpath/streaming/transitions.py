"""Transitions over a stream, with the last endpoint of each user as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from hitpath.functions.request import endpoint
from hitpath.functions.values import micros
from hitpath.streaming.state import require_rocksdb, use_rocksdb  # noqa: F401

_STEPS = "uid string, source string, target string"


_STEP_ROWS = 10_000


class _LastVisit(StatefulProcessor):
    """Links each visit to the user's previous one."""

    def __init__(self, order: list[str], idle_ms: int | None):
        self._order = order
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "endpoint string, us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visits = [row for chunk in rows for row in zip(chunk["us"], *(chunk[name] for name in self._order), chunk["endpoint"])]
        visits.sort(key=lambda row: row[:-1])
        before, seen = self._last.get() if self._last.exists() else ("", visits[0][0])
        steps: list[tuple[str, str]] = []
        for us, *_, visit in visits:
            if self._idle_ms is not None and us - seen > self._idle_ms * 1000:
                steps.append((before, ""))
                before = ""
            steps.append((before, visit))
            before, seen = visit, us
            if len(steps) >= _STEP_ROWS:
                yield self._frame(key, steps)
                steps = []
        if self._idle_ms is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(int(seen) // 1000 + self._idle_ms)
        self._last.update((before, int(seen)))
        yield self._frame(key, steps)

    @staticmethod
    def _frame(key, steps: list[tuple[str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *step) for step in steps], columns=["uid", "source", "target"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._last.exists():
            yield pd.DataFrame({"uid": [key[0]], "source": [self._last.get()[0]], "target": [""]})
            self._last.clear()

    def close(self) -> None:
        pass


def order_columns(entries: DataFrame) -> dict[str, Column]:
    """The parts of ``ord`` as columns of their own: a struct would reach pandas as a dict, which has no order."""
    kind = entries.schema["ord"].dataType
    fields = [F.col("ord")[name] for name in kind.names] if isinstance(kind, StructType) else [F.col("ord")]
    return {f"ord{i}": field for i, field in enumerate(fields)}


def steps(entries: DataFrame, idle_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """One row per step of a user, as it happens.

    Rows of a user are ordered by time and ``ord`` within a micro-batch, for
    which a task holds the times and endpoints one user has in it; bound the
    batches with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``. Between batches the state is one last endpoint per
    user. A stream has no end, so exit steps need a rule: with ``idle_ms`` a
    user without a request for longer than that gets a step to the empty
    target and starts anew. The last exit of a user is written once the
    watermark has passed that time.

    The session must use the RocksDB state store, see :func:`use_rocksdb`.
    """
    require_rocksdb(entries.sparkSession)
    visits = entries if idle_ms is None else entries.withWatermark("time", delay)
    order = order_columns(entries)
    rows = visits.select(
        F.col("uid").cast("string").alias("uid"),
        "time",
        micros(F.col("time")).alias("us"),
        *(column.alias(name) for name, column in order.items()),
        endpoint().alias("endpoint"),
    )
    return rows.groupBy("uid").transformWithStateInPandas(
        statefulProcessor=_LastVisit(list(order), idle_ms),
        outputStructType=_STEPS,
        outputMode="append",
        timeMode="none" if idle_ms is None else "eventTime",
    )
