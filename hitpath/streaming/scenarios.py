"""Loop patterns over a stream, with each user's folded pattern as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hitpath.functions.fold import Folder, pattern_text
from hitpath.functions.request import endpoint
from hitpath.functions.values import micros
from hitpath.streaming.state import require_rocksdb
from hitpath.streaming.transitions import order_columns

_STATE = "first_us bigint, last_us bigint, leaves array<string>, lo array<int>, hi array<int>"
_PATTERN = "uid string, first_us bigint, last_us bigint, pattern string, leaves array<string>"


class _FoldVisits(StatefulProcessor):
    """Folds each user's visits into the pattern so far; a new user id begins another."""

    def __init__(self, order: list[str]):
        self._order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pattern = handle.getValueState("pattern", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        folder, first, last = None, 0, 0
        if self._pattern.exists():
            first, last, leaves, lo, hi = self._pattern.get()
            folder = Folder.resume(list(leaves), list(zip(map(int, lo), map(int, hi))))
        visits = [
            row for chunk in rows
            for row in zip(chunk["us"], *(chunk[name] for name in self._order), chunk["endpoint"], chunk["set_new_uid"])
        ]
        visits.sort(key=lambda row: row[:-2])
        for us, *_, visit, new in visits:
            if new:
                folder, first = Folder(), us
            if folder is not None:
                folder.add(visit)
                last = us
        if folder is not None:
            loops = folder.loops
            self._pattern.update(
                (int(first), int(last), folder.leaves, [lo for lo, _ in loops], [hi for _, hi in loops])
            )
            yield pd.DataFrame(
                {
                    "uid": [key[0]],
                    "first_us": [int(first)],
                    "last_us": [int(last)],
                    "pattern": [pattern_text(folder.leaves, loops)],
                    "leaves": [folder.leaves],
                }
            )

    def close(self) -> None:
        pass


def user_patterns(entries: DataFrame) -> DataFrame:
    """The pattern of each user with new requests, as it is after a micro-batch.

    Fold and state are those of :func:`hitpath.operators.scenario.user_patterns`:
    the state of a user is the folded pattern, however long the sequence. A
    user without a request that set a new user id has none. Rows of a user are
    ordered by time and ``ord`` within a micro-batch, so later batches must
    hold later requests; a batch's rows of one user are sorted in memory, so
    bound the batches with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.

    The session must use the RocksDB state store, see
    :func:`hitpath.streaming.transitions.use_rocksdb`.
    """
    require_rocksdb(entries.sparkSession)
    fields = order_columns(entries)
    rows = entries.select(
        F.col("uid").cast("string").alias("uid"),
        micros(F.col("time")).alias("us"),
        *(column.alias(name) for name, column in fields.items()),
        endpoint().alias("endpoint"),
        "set_new_uid",
    )
    return rows.groupBy("uid").transformWithStateInPandas(
        statefulProcessor=_FoldVisits(list(fields)), outputStructType=_PATTERN, outputMode="update", timeMode="none"
    )
