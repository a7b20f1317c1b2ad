"""Row filter over the documented request fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_entries(entries: DataFrame, condition: str | Column = "") -> DataFrame:
    """Keep entries that meet a Spark SQL predicate or a boolean Column.

    An empty condition keeps everything. Apply it after :func:`apply_routes`
    when ``uri`` should mean the route pattern.
    """
    if isinstance(condition, str):
        if condition.strip() == "":
            return entries
        condition = F.expr(condition)
    return entries.where(condition)
