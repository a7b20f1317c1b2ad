"""Row order within a user, computed so that no user needs a task of its own.

The rows of a user are ordered by ``(time, ord)``. A plain window over ``uid``
sends all rows of a user to one task, which fails when one user makes a large
part of the log. Every user's timeline is therefore cut into slices of fixed
length. Windows run per ``(uid, slice)``; what leaves a slice for the window
over ``uid`` is at most two rows, so a user has no more of them there than twice
the slices of the logged time, however many requests they made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds a slice lasts. Shorter slices split busy users further, longer ones
# send fewer rows into the second window.
SLICE_S = 60


def time_slice(slice_s: int = SLICE_S) -> Column:
    """The slice a row falls into; a row without a time has none."""
    if slice_s <= 0:
        raise ValueError(f"slices need a positive length in seconds, not {slice_s}")
    return F.floor(F.unix_seconds("time") / F.lit(slice_s))


def slice_window() -> Window:
    return Window.partitionBy("uid", "slice").orderBy("time", "ord")


def consecutive_pairs(rows: DataFrame, value: str, slice_s: int = SLICE_S) -> DataFrame:
    """How often a user has two neighbouring values: ``(previous, following, count)``.

    The first value of a user has a NULL ``previous``, the last one a NULL
    ``following``. A pair may come in several rows whose counts add up.
    ``rows`` needs ``uid``, ``time``, ``ord`` and ``value``, which is not NULL.
    """
    w = slice_window()
    linked = rows.select("uid", "time", "ord", F.col(value).alias("here"), time_slice(slice_s).alias("slice")).select(
        "uid", "slice", "here", F.lag("here").over(w).alias("before"), F.lead("here").over(w).isNull().alias("last")
    )
    # Pairs inside slices leave their user behind and are counted before the
    # shuffle; the first and last row of a slice go on under their user.
    first = F.col("before").isNull()
    inner = F.struct(
        F.lit(None).cast(linked.schema["uid"].dataType).alias("uid"),
        F.lit(None).cast("bigint").alias("slice"),
        F.col("before").alias("previous"),
        F.col("here").alias("following"),
        F.lit(False).alias("first"),
        F.lit(False).alias("last"),
    )
    edge = F.struct(
        "uid",
        "slice",
        F.lit(None).cast("string").alias("previous"),
        F.col("here").alias("following"),
        first.alias("first"),
        "last",
    )
    parts = F.array_compact(F.array(F.when(~first, inner), F.when(first | F.col("last"), edge)))
    found = linked.select(F.inline(parts))
    counted = found.groupBy(*found.columns).agg(F.count("*").alias("count"))

    # An inner pair has no neighbours in this window: its pair is part of the key.
    pair = F.when(~F.col("first") & ~F.col("last"), F.struct("previous", "following"))
    timeline = Window.partitionBy("uid", pair).orderBy("slice", F.desc("first"))
    near = counted.withColumns(
        {"_before": F.lag("following").over(timeline), "_end": F.lead("following").over(timeline).isNull()}
    )
    step = lambda previous, following: F.struct(
        previous.alias("previous"), following.alias("following"), F.col("count")
    )
    steps = F.array_compact(
        F.array(
            F.when(pair.isNotNull(), step(F.col("previous"), F.col("following"))),
            F.when(F.col("first"), step(F.col("_before"), F.col("following"))),
            F.when(F.col("last") & F.col("_end"), step(F.col("following"), F.lit(None).cast("string"))),
        )
    )
    return near.select(F.inline(steps))


def with_position(rows: DataFrame, since: str | None = None, slice_s: int = SLICE_S, total: bool = False) -> DataFrame:
    """Add ``position``, the 0-based rank of a row within its user, and with ``total`` how many rows the user has.

    With ``since``, a boolean column, a user's rows count from the last one for
    which it is true; rows before it are left out, and so are users without
    such a row. Rows are ranked within their slice, one row per slice tells how
    many it keeps, and the rows take the start of their slice from it; they are
    shuffled by slice, never by user alone.
    """
    ranked = rows.withColumn("slice", time_slice(slice_s)).withColumn("_rank", F.row_number().over(slice_window()))
    begins = F.max(F.when(F.col(since), F.col("_rank"))) if since else F.lit(None).cast("int")
    slices = ranked.groupBy("uid", "slice").agg(F.count("*").alias("_rows"), begins.alias("_begins"))
    user = Window.partitionBy("uid")
    timeline = user.orderBy("slice")
    if since:
        last = F.max(F.when(F.col("_begins").isNotNull(), F.col("slice"))).over(user)
        slices = slices.withColumn("_last", last).where(F.col("slice") >= F.col("_last"))
        skipped = F.when(F.col("slice") == F.col("_last"), F.col("_begins") - 1).otherwise(F.lit(0))
    else:
        skipped = F.lit(0)
    left = F.sum(F.col("_rows") - F.col("_skipped"))
    slices = slices.withColumn("_skipped", skipped).select(
        "uid",
        "slice",
        "_skipped",
        F.coalesce(
            left.over(timeline.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
        ).alias("_start"),
        *([left.over(user).alias("total")] if total else []),
    )
    kept = ranked.join(slices, ["uid", "slice"]).where(F.col("_rank") > F.col("_skipped"))
    position = F.col("_start") + F.col("_rank") - F.col("_skipped") - 1
    return kept.select(*rows.columns, position.alias("position"), *(["total"] if total else []))


def without_long_runs(rows: DataFrame, value: str, reset: str, slice_s: int = SLICE_S) -> DataFrame:
    """Drop the middle of each run of one repeated value within a slice of a user's timeline.

    The first two rows of a run and its last one stay, and so does each row
    with ``reset`` set and the one after it. Folding gives the same pattern for
    two repetitions as for any larger number: two equal leaves at the end are
    always merged into a loop of one leaf, and adding that leaf to such a loop
    changes nothing. So this changes no result. It would not hold for longer
    blocks, whose repetition may take several rounds to settle or never does.
    """
    w = slice_window()
    near = rows.withColumn("slice", time_slice(slice_s)).withColumns(
        {
            "_p1": F.lag(value, 1).over(w),
            "_p2": F.lag(value, 2).over(w),
            "_n1": F.lead(value, 1).over(w),
            "_r1": F.lag(reset, 1).over(w),
        }
    )
    same = F.col(value)
    middle = (
        (same == F.col("_p1")) & (same == F.col("_p2")) & (same == F.col("_n1")) & ~F.col(reset) & ~F.col("_r1")
    )
    return near.where(~F.coalesce(middle, F.lit(False))).select(*rows.columns)
