"""The most frequent values of parameters without shuffling all values.

Each task that reads the log keeps a bounded summary of the values it sees
(Misra and Gries: where it overflows, all counters lose the same amount, and
what they lost in all is remembered). The summaries name candidates; those are
counted again, exactly, in a second pass. No value outside the summaries can
occur more often than the sum of what tasks lost, so where the last of a
parameter's top values beats that sum, nothing was missed. For the parameters of
which that cannot be said, all values are counted and shuffled as usual.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitpath.functions.request import endpoint
from hitpath.functions.scores import rate
from hitpath.operators.params import PARAM, label_of_parameter, pieces
from hitpath.operators.routes import Routes
from hitpath.sources.scratch import scratch_dir

#: Counters of a task. A counter is a value and its parameter, some hundred bytes.
WIDTH = 100_000

_KEY = [*PARAM, "value"]
_SUMMARY = pa.schema(
    [
        ("method", pa.string()), ("uri", pa.string()), ("kind", pa.string()), ("position", pa.int32()), ("name", pa.string()),
        ("value", pa.string()), ("count", pa.int64()), ("lost", pa.int64()),
    ]
)
_SUMMARY_SQL = "method string, uri string, kind string, position int, name string, value string, count bigint, lost bigint"


def _summaries(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.table(batch).append_column("count", pa.array([1] * batch.num_rows, pa.int64()))
            both = new if held is None else pa.concat_tables([held, new])
            held = both.group_by(_KEY).aggregate([("count", "sum")]).rename_columns([*_KEY, "count"])
            if held.num_rows > width:
                counts = held["count"].combine_chunks()
                cut = counts[pc.array_sort_indices(counts, order="descending")[width].as_py()].as_py()
                lost += cut
                held = held.set_column(len(_KEY), "count", pc.subtract(counts, cut))
                held = held.filter(pc.greater(held["count"], 0))
        if held is not None:
            rows = held.append_column("lost", pa.nulls(held.num_rows, pa.int64()))
            # What was lost is a row of its own, without a parameter.
            total = pa.table([*(pa.nulls(1, f.type) for f in list(_SUMMARY)[:-2]), pa.array([0]), pa.array([lost])], schema=_SUMMARY)
            yield from pa.concat_tables([rows.select(_SUMMARY.names).cast(_SUMMARY), total]).combine_chunks().to_batches(10_000)

    return work


def _best(counts: DataFrame, num: int) -> DataFrame:
    order = Window.partitionBy(*PARAM).orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num)


def param_heavy_values(
    entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all", num: int = 5, width: int = WIDTH
) -> DataFrame:
    """The ``num`` most frequent values of each parameter, as ``param_top_values`` has them, but for ``more``.

    How many values are left out takes a count of all; all else is exact,
    whatever the data. The log is read twice, or three times if some
    parameters have no value that stands out; summaries and candidates are
    written under ``spark.checkpoint.dir`` while the query is built.
    """
    if num <= 0 or width <= 0:
        raise ValueError(f"num and width must be positive: {num}, {width}")
    spark = entries.sparkSession
    folder = scratch_dir(spark, "heavy")
    values = pieces(entries, routes, kind)
    values.select(*_KEY).mapInArrow(_summaries(width), _SUMMARY_SQL).write.parquet(f"{folder}/summaries")
    summaries = spark.read.schema(_SUMMARY_SQL).parquet(f"{folder}/summaries")
    lost = summaries.agg(F.sum("lost")).first()[0] or 0

    # At least so often a value occurs, and at most so much more often: what cannot reach the num-th is no candidate.
    least = summaries.where("kind IS NOT NULL").groupBy(*_KEY).agg(F.sum("count").alias("count"))
    last = _best(least, num).where(F.col("rank") == num).select(*PARAM, F.col("count").alias("last"))
    candidates = least.join(last, PARAM, "left").where(F.col("count") + lost >= F.coalesce("last", F.lit(0))).select(*_KEY)
    candidates.write.parquet(f"{folder}/candidates")
    candidates = spark.read.parquet(f"{folder}/candidates")

    counted = values.join(candidates, _KEY, "left_semi").groupBy(*_KEY).agg(F.count("*").alias("count"))
    best = _best(counted, num)
    totals = values.groupBy(*PARAM).agg(F.count("*").alias("total"))
    if lost:
        best.write.parquet(f"{folder}/best")
        best = spark.read.parquet(f"{folder}/best")
        proven = best.where((F.col("rank") == num) & (F.col("count") > lost)).select(*PARAM)
        rest = values.join(proven, PARAM, "left_anti").groupBy(*_KEY).agg(F.count("*").alias("count"))
        best = best.join(proven, PARAM, "left_semi").unionByName(_best(rest, num))
    running = Window.partitionBy(*PARAM).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        best.withColumn("cum_count", F.sum("count").over(running))
        .join(totals, PARAM)
        .select(
            endpoint().alias("endpoint"),
            "method",
            "uri",
            F.col("kind").alias("type"),
            "position",
            label_of_parameter().alias("parameter"),
            "rank",
            "value",
            "count",
            "cum_count",
            rate(F.col("cum_count"), F.col("total")).alias("cum_rate"),
        )
    )
