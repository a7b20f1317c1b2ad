"""Parameter statistics kept from day to day, and united when they are asked for.

Whole logs need not be read again for a statement about a month. For each day
two tables are stored: how often each value of each parameter occurred, which
adds up to every exact statistic, and a sketch of each parameter's distinct values,
a few kilobytes each, for estimates that read no values.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitpath.functions.request import endpoint
from hitpath.operators import params
from hitpath.operators.params import PARAM
from hitpath.operators.routes import Routes

Day = str | date


def write_param_state(
    entries: DataFrame, path: str, routes: Routes | Iterable[str] = (), kind: str = "all", precision: int = 12
) -> None:
    """Add the parameters of some days to the state under ``path``.

    A day that is written again takes the place of what was stored of it, so a
    job that is repeated counts nothing twice; days must therefore come whole.
    ``precision`` is the logarithm of the number of registers of a sketch.
    """
    days = entries.select(*entries.columns, F.to_date("time").alias("date"))
    counts = params.value_counts(days, routes, kind, marker=True, by=["date"])
    _replace_days(counts, f"{path}/values")
    stored = entries.sparkSession.read.parquet(f"{path}/values")
    sketched = (
        stored.join(counts.select("date").distinct(), "date", "left_semi")
        .groupBy("date", *PARAM)
        .agg(F.hll_sketch_agg("value", precision).alias("sketch"), F.sum("count").alias("count"))
    )
    _replace_days(sketched, f"{path}/sketches")


def _replace_days(table: DataFrame, path: str) -> None:
    (
        table.hint("rebalance", F.col("date"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    )


def _days(table: DataFrame, since: Day | None, until: Day | None) -> DataFrame:
    """The days from ``since`` to ``until``, both included; other days are not read."""
    if since is not None:
        table = table.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        table = table.where(F.col("date") <= F.lit(until).cast("date"))
    return table


def param_stat_of_days(
    spark: SparkSession, path: str, since: Day | None = None, until: Day | None = None, corrected: bool = False
) -> DataFrame:
    """``params.param_stat`` of the stored days, exact."""
    values = _days(spark.read.parquet(f"{path}/values"), since, until)
    counts = values.groupBy(*PARAM, "value").agg(F.sum("count").alias("count"))
    return params.stat_of_counts(counts, corrected)


def param_cardinality_of_days(spark: SparkSession, path: str, since: Day | None = None, until: Day | None = None) -> DataFrame:
    """The estimated number of distinct values of each parameter, from the sketches of the stored days alone."""
    sketches = _days(spark.read.parquet(f"{path}/sketches"), since, until).where("kind <> 'request'")
    return sketches.groupBy(*PARAM).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality"), F.sum("count").alias("count")
    ).select(
        endpoint().alias("endpoint"), F.col("kind").alias("type"), "position",
        params.label_of_parameter().alias("parameter"), "cardinality", "count",
    )
