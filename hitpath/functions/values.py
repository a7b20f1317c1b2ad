"""Typed columns from the text values of single log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


def parse_status(text: Column) -> Column:
    """An optionally signed decimal integer; NULL for anything else."""
    return F.when(text.rlike("^[+-]?[0-9]+\\z"), text.try_cast("int"))


def parse_time(text: Column, time_format: str = DEFAULT_TIME_FORMAT) -> Column:
    return F.try_to_timestamp(text, F.lit(time_format))


def strip_cookie_name(text: Column) -> Column:
    """``uid=ABC`` becomes ``ABC``; text without ``=`` is kept."""
    return F.substr(text, F.instr(text, "=") + F.lit(1))


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def _whole(amount: Column, unit: int) -> Column:
    return F.call_function("div", amount, F.lit(unit).cast("bigint"))


def offset_ms(time: Column, origin: Column) -> Column:
    """Whole milliseconds from ``origin`` to ``time``."""
    return _whole(micros(time) - micros(origin), 1000)


def bucket(time: Column, origin: Column, interval: int) -> Column:
    """Index of the ``interval``-second bucket that ``time`` falls in."""
    return _whole(micros(time) - micros(origin), interval * 1_000_000)
