"""Scenarios: loop patterns of user sequences, counted over users."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from hitpath.functions.fold import Folder, nests, pattern_text
from hitpath.functions.request import endpoint
from hitpath.functions.values import micros, offset_ms
from hitpath.operators.ordering import SLICE_S, with_position, without_long_runs
from hitpath.operators.trend import origin, period
from hitpath.sources.scratch import scratch_dir

LATE_SHARE = 0.95
# Requests of one user that a task folds in one go.
CHUNK_ROWS = 1_000_000

_LOOPS = "array<struct<lo:int,hi:int>>"
_PATTERN = f"pattern string, leaves array<string>, loops {_LOOPS}"
_ARROW_LOOPS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_ARROW_PATTERN = [("pattern", pa.string()), ("leaves", pa.list_(pa.string())), ("loops", _ARROW_LOOPS)]


def _visits(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("uid").cast("string").alias("uid"), "time", "ord", endpoint().alias("endpoint"), "set_new_uid"
    )


def _period_ms(entries: DataFrame) -> Column:
    bounds = period(entries)
    return bounds.select(offset_ms(F.col("end"), F.col("origin"))).scalar()


def in_time(first_req_ms: Column, entries: DataFrame, share: float = LATE_SHARE) -> Column:
    """Whether a user started early enough to be counted."""
    return first_req_ms <= (_period_ms(entries) * F.lit(share)).cast("bigint")


def user_window(entries: DataFrame, share: float = LATE_SHARE) -> DataFrame:
    """First and last request of each user, in ms since the log began.

    The first request is the latest one that set a new user id; users without
    such a request are left out, and so are users who start after ``share`` of
    the logged period.
    """
    start = origin(entries)
    return (
        entries.groupBy("uid")
        .agg(
            F.max(F.when(F.col("set_new_uid"), F.col("time"))).alias("_first"),
            F.max("time").alias("_last"),
        )
        .where(F.col("_first").isNotNull())
        .select(
            "uid",
            offset_ms(F.col("_first"), start).alias("first_req_ms"),
            offset_ms(F.col("_last"), start).alias("last_req_ms"),
        )
        .where(in_time(F.col("first_req_ms"), entries, share))
    )


def user_count(entries: DataFrame, share: float = LATE_SHARE) -> Column:
    """How many users the scenarios of ``entries`` count, without folding any."""
    return user_window(entries, share).agg(F.count("*").alias("users")).scalar()


def orphan_users(entries: DataFrame) -> DataFrame:
    """Users none of whose requests set a user id, with their request count."""
    return (
        entries.groupBy("uid")
        .agg(F.max("set_new_uid").alias("_any"), F.count("*").alias("count"))
        .where(~F.col("_any"))
        .select("uid", "count")
    )


def sequences(entries: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """The requests of each user from the last new user id on, in order.

    Long form, one row per request: a sequence is never gathered in one row.
    """
    return with_position(_visits(entries), "set_new_uid", slice_s).select("uid", "position", "endpoint")


_FOLDED = pa.schema(
    [("uid", pa.string()), ("total", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), *_ARROW_PATTERN]
)
_FOLDED_SQL = f"uid string, total bigint, first_us bigint, last_us bigint, {_PATTERN}"


def _fold_users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows that arrive ordered by user and position, holding one user at a time.

    A row without an endpoint is the user's pattern so far, from which the
    fold goes on.
    """
    current, folder, total, first, last = None, None, 0, 0, 0

    def folded() -> dict:
        return {
            "uid": current,
            "total": total,
            "first_us": first,
            "last_us": last,
            "pattern": pattern_text(folder.leaves, folder.loops),
            "leaves": folder.leaves,
            "loops": [{"lo": lo, "hi": hi} for lo, hi in folder.loops],
        }

    for batch in batches:
        done = []
        uids, totals, starts, times, visits, leaves, loops = (c for c in batch.columns)
        rows = zip(uids.to_pylist(), totals.to_pylist(), starts.to_pylist(), times.to_pylist(), visits.to_pylist(), strict=True)
        for i, (uid, rows_of_user, start, time, visit) in enumerate(rows):
            if uid != current or folder is None:
                if folder is not None:
                    done.append(folded())
                current, folder, total, first = uid, Folder(), rows_of_user, start
            if visit is None:
                folder = Folder.resume(leaves[i].as_py(), [(x["lo"], x["hi"]) for x in loops[i].as_py()])
            else:
                folder.add(visit)
            last = time
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_FOLDED)
    if folder is not None:
        yield pa.RecordBatch.from_pylist([folded()], schema=_FOLDED)


def _ordered_visits(entries: DataFrame, slice_s: int) -> DataFrame:
    """The requests that decide each user's pattern: ``(uid, total, position, first_us, us, endpoint)``.

    They begin with the last new user id. Runs are thinned and rows numbered in
    slices of a user's time, so nothing here depends on how busy a user is.
    """
    rows = without_long_runs(_visits(entries), "endpoint", "set_new_uid", slice_s)
    numbered = with_position(rows, "set_new_uid", slice_s, total=True)
    us = micros(F.col("time"))
    # Only the first row of a user has position 0; the fold takes its time.
    return numbered.select("uid", "total", "position", us.alias("first_us"), us.alias("us"), "endpoint")


_INPUT = ("uid", "total", "first_us", "us", "endpoint", "leaves", "loops")


def _folded(rows: DataFrame) -> DataFrame:
    together = rows.repartition("uid").sortWithinPartitions("uid", "position")
    return together.select(*_INPUT).mapInArrow(_fold_users, _FOLDED_SQL)


def user_patterns(entries: DataFrame, chunk_rows: int = CHUNK_ROWS, slice_s: int = SLICE_S) -> DataFrame:
    """The folded pattern of each user's sequence.

    Folding is sequential within a user by definition, but its state is the
    pattern so far. Sequences are cut into chunks of ``chunk_rows`` requests:
    the first chunks of all users are folded at once, then the second ones of
    those that have more, from the patterns of the first, and so on. However
    many requests a user has, a task sorts and folds no more of them than a
    chunk. The number of rounds, one unless a user has very many requests,
    takes a count of requests per user while the query is built; where there
    are several, rows and patterns in between are written under
    ``spark.checkpoint.dir``.
    """
    if chunk_rows <= 0:
        raise ValueError(f"a chunk needs a positive number of rows, not {chunk_rows}")
    busiest = entries.groupBy("uid").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
    rounds = max(1, -(-busiest // chunk_rows))
    visits = _ordered_visits(entries, slice_s).withColumns(
        {"leaves": F.lit(None).cast("array<string>"), "loops": F.lit(None).cast(_LOOPS)}
    )
    kept = ["uid", "first_us", "last_us", "pattern", "leaves", "loops"]
    if rounds == 1:
        return _folded(visits).select(*kept)

    spark, folder = entries.sparkSession, scratch_dir(entries.sparkSession, "fold")
    chunk = F.floor(F.col("position") / chunk_rows).cast("int")
    visits.withColumn("chunk", chunk).write.partitionBy("chunk").parquet(f"{folder}/visits")
    rows = spark.read.parquet(f"{folder}/visits")
    known, found = None, None
    for i in range(rounds):
        now = rows.where(F.col("chunk") == i).drop("chunk")
        if known is not None:
            # The pattern so far comes before all rows of its user.
            before = known.where(F.col("total") > i * chunk_rows).select(
                "uid", "total", F.lit(-1).cast("bigint").alias("position"), "first_us", F.col("last_us").alias("us"),
                F.lit(None).cast("string").alias("endpoint"), "leaves", "loops",
            )
            now = now.unionByName(before)
        _folded(now).write.parquet(f"{folder}/patterns{i}")
        known = spark.read.schema(_FOLDED_SQL).parquet(f"{folder}/patterns{i}")
        done = known.where(F.col("total") <= (i + 1) * chunk_rows).select(*kept)
        found = done if found is None else found.unionByName(done)
    return found


class _Class:
    """Patterns that nest together: which intervals they have, as bits, and their count and times."""

    def __init__(self, bits: int, row: dict):
        self.bits, self.count = bits, row["count"]
        self.first, self.last = row["first_req_ms"], row["last_req_ms"]

    def add(self, bits: int, row: dict) -> None:
        self.bits |= bits
        self.count += row["count"]
        self.first = min(self.first, row["first_req_ms"])
        self.last = max(self.last, row["last_req_ms"])


class _Crossings:
    """The intervals of a group, numbered, each with the bits of those that it partly overlaps."""

    def __init__(self):
        self.numbers: dict[tuple[int, int], int] = {}
        self.crossed: list[int] = []

    def number(self, lo: int, hi: int) -> int:
        own = self.numbers.get((lo, hi))
        if own is None:
            own = len(self.crossed)
            found = 0
            for (a, b), i in self.numbers.items():
                if a < lo <= b < hi or lo < a <= hi < b:
                    found |= 1 << i
                    self.crossed[i] |= 1 << own
            self.numbers[lo, hi] = own
            self.crossed.append(found)
        return own

    def of(self, loops: list[dict]) -> tuple[int, int]:
        """The bits of a pattern's intervals, and of those that cross one of them."""
        bits = crossed = 0
        for i in [self.number(loop["lo"], loop["hi"]) for loop in loops]:
            bits |= 1 << i
        for i in range(bits.bit_length()):
            if bits >> i & 1:
                crossed |= self.crossed[i]
        return bits, crossed


def _merge_compatible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge patterns with equal leaves whose loops nest together.

    Rows arrive ordered by leaves and descending pattern text. Each pattern
    joins the first earlier one it is compatible with; whether it is, bits of
    the group's intervals tell.
    """
    schema = pa.schema(
        [("first_req_ms", pa.int64()), ("last_req_ms", pa.int64()), ("count", pa.int64()), *_ARROW_PATTERN]
    )
    leaves, crossings, kept = None, _Crossings(), []

    def merged() -> list[dict]:
        found = []
        for c in kept:
            loops = sorted(loop for loop, i in crossings.numbers.items() if c.bits >> i & 1)
            found.append(
                {
                    "first_req_ms": c.first,
                    "last_req_ms": c.last,
                    "count": c.count,
                    "pattern": pattern_text(leaves, loops),
                    "leaves": leaves,
                    "loops": [{"lo": lo, "hi": hi} for lo, hi in loops],
                }
            )
        return found

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["leaves"] != leaves:
                done += merged()
                leaves, crossings, kept = row["leaves"], _Crossings(), []
            bits, crossed = crossings.of(row["loops"])
            for other in kept:
                if not other.bits & crossed:
                    other.add(bits, row)
                    break
            else:
                kept.append(_Class(bits, row))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if kept:
        yield pa.RecordBatch.from_pylist(merged(), schema=schema)


@F.arrow_udf(BooleanType())
def _all_nest(groups: pa.Array) -> pa.Array:
    """Whether no two intervals of a group partly overlap."""
    return pa.array([nests({(loop["lo"], loop["hi"]) for loop in loops}) for loops in groups.to_pylist()], pa.bool_())


def _text_of(leaves: Column, loops: Column) -> Column:
    """``A -> (B -> C)*`` from leaves and loops, as ``pattern_text`` has it."""

    def part(leaf: Column, i: Column) -> Column:
        opened = F.size(F.filter(loops, lambda loop: loop["lo"] == i))
        closed = F.size(F.filter(loops, lambda loop: loop["hi"] == i))
        return F.concat(F.repeat(F.lit("("), opened), leaf, F.repeat(F.lit(")*"), closed))

    return F.array_join(F.transform(leaves, part), " -> ")


def merge_patterns(patterns: DataFrame) -> DataFrame:
    """Merge ``(pattern, leaves, loops, count, first_req_ms, last_req_ms)`` with equal leaves whose loops nest.

    Mostly all patterns of the same leaves nest together, which the set of
    their intervals shows: then sums of the group are the result, made without
    bringing its patterns together. Only where some cross, patterns are merged
    one by one in descending order of their text, each with the first
    earlier one that it nests with.
    """
    single = F.col("pos").isNull() | (F.col("pos") == 0)
    times = [F.min("first_req_ms").alias("first_req_ms"), F.max("last_req_ms").alias("last_req_ms")]
    groups = (
        patterns.select("leaves", "count", "first_req_ms", "last_req_ms", F.posexplode_outer("loops").alias("pos", "loop"))
        .groupBy("leaves")
        .agg(
            F.sum(F.when(single, F.col("count")).otherwise(F.lit(0))).alias("count"),
            *times,
            F.array_sort(F.collect_set("loop")).alias("loops"),
        )
        .withColumn("together", _all_nest("loops"))
    )
    columns = ["first_req_ms", "last_req_ms", "count", "pattern", "leaves", "loops"]
    whole = groups.where("together").withColumn("pattern", _text_of(F.col("leaves"), F.col("loops"))).select(*columns)
    apart = patterns.join(groups.where("NOT together").select("leaves"), "leaves", "left_semi")
    ordered = apart.repartition("leaves").sortWithinPartitions("leaves", F.desc("pattern"))
    resolved = ordered.select("pattern", "leaves", "loops", "count", "first_req_ms", "last_req_ms").mapInArrow(
        _merge_compatible, f"first_req_ms bigint, last_req_ms bigint, count bigint, {_PATTERN}"
    )
    return whole.unionByName(resolved)


def scenarios(entries: DataFrame, share: float = LATE_SHARE) -> DataFrame:
    """Scenarios with their first and last call and the number of users."""
    start = micros(origin(entries))
    ms = lambda us: F.call_function("div", us - start, F.lit(1000).cast("bigint"))
    users = user_patterns(entries).select(
        ms(F.col("first_us")).alias("first_req_ms"), ms(F.col("last_us")).alias("last_req_ms"),
        "pattern", "leaves", "loops",
    )
    patterns = (
        users.where(in_time(F.col("first_req_ms"), entries, share))
        .groupBy("pattern", "leaves", "loops")
        .agg(
            F.count("*").alias("count"),
            F.min("first_req_ms").alias("first_req_ms"),
            F.max("last_req_ms").alias("last_req_ms"),
        )
    )
    return merge_patterns(patterns)


def order_scenarios(found: DataFrame) -> DataFrame:
    """Scenarios by first call, then by falling count and pattern text."""
    return found.orderBy("first_req_ms", F.desc("count"), F.desc("pattern"))
