"""Numeric scores and labels used by the graph and parameter reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_norm(num: Column, src: Column, target: int) -> Column:
    """Map ``num`` from [1, src] to [0, target] on a logarithmic scale.

    Values outside the domain score 0.
    """
    inside = (num > 1) & (src > 1) & F.lit(target > 0)
    return F.when(inside, F.lit(float(target)) * F.ln(num) / F.ln(src)).otherwise(F.lit(0.0))


def percent_truncated(part: Column, whole: Column) -> Column:
    """A percentage cut (not rounded) to two digits after the sixth is rounded."""
    exact = (F.lit(100.0) * part / whole).cast("decimal(20,6)")
    return (F.floor(exact * 100) / 100).cast("double")


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f", F.lit(100.0) * part / whole)


def rate(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole


def intensity(level: Column, maximum: Column) -> Column:
    """``level / maximum`` clamped to [0.2, 0.8] and rescaled to [0, 1]."""
    share = level.cast("double") / maximum
    return (F.greatest(F.lit(0.2), F.least(F.lit(0.8), share)) - 0.2) / 0.6


def parameter_label(kind: Column, position: Column, name: Column) -> Column:
    """``?key`` for query keys, ``:name`` or ``Path param(i)`` for path groups."""
    return (
        F.when(kind == "query", F.concat(F.lit("?"), name))
        .when(name != "", F.concat(F.lit(":"), name))
        .otherwise(F.format_string("Path param(%d)", position))
    )


def thousands(count: Column) -> Column:
    return F.format_number(count, 0)
