"""Reading LTSV access logs into request entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitpath.functions.request import computed_once, text_after, with_request_parts
from hitpath.functions.values import (
    DEFAULT_TIME_FORMAT,
    parse_status,
    parse_time,
    strip_cookie_name,
)

LABELS = ("req", "status", "time", "uidset", "uidgot")
MODES = ("failfast", "permissive", "dropmalformed")

ENTRY_COLUMNS = (
    "ord",
    "req",
    "method",
    "uri",
    "path",
    "query",
    "status",
    "uid",
    "set_new_uid",
    "time",
    "route_id",
)

def _labels(overrides: Mapping[str, str] | None) -> dict[str, str]:
    labels = {name: name for name in LABELS}
    labels.update({k: v for k, v in (overrides or {}).items() if k in labels})
    return labels


def _fields(fields: Column, labels: Iterable[str]) -> Column:
    """The fields of a line that carry one of ``labels``."""
    marks = [f"{label}:" for label in labels]
    return F.filter(fields, lambda f: reduce(or_, (f.startswith(mark) for mark in marks)))


def _last(fields: Column, label: str) -> Column:
    """Value of the last field with this label; NULL without one."""
    field = F.try_element_at(_fields(fields, [label]), F.lit(-1))
    return F.substr(field, F.lit(len(label) + 2))


def _bad_before(fields: Column, label: str, parse: Callable[[Column], Column]) -> Column:
    """Whether a repeated field with this label cannot be parsed; looked into only where it is repeated."""
    found = _fields(fields, [label])
    text = lambda f: F.substr(f, F.lit(len(label) + 2))
    return F.when(F.size(found) > 1, F.exists(found, lambda f: parse(text(f)).isNull())).otherwise(F.lit(False))


def _cookies(fields: Column, labels: list[str]) -> Column:
    """The fields with one of ``labels`` that hold a cookie.

    Nothing at all and a lone dash both mean that there is none.
    """
    absent = [f"{label}:{value}" for label in labels for value in ("", "-")]
    return F.filter(_fields(fields, labels), lambda f: ~f.isin(absent))


def parse_lines(
    lines: DataFrame,
    *,
    labels: Mapping[str, str] | None = None,
    time_format: str = DEFAULT_TIME_FORMAT,
    mode: str = "failfast",
    value: str = "value",
    ord: str = "ord",
) -> DataFrame:
    """Parse a DataFrame of LTSV lines into entries.

    ``failfast`` raises on the first malformed line that is read,
    ``permissive`` keeps such lines with an ``error`` text, and
    ``dropmalformed`` leaves them out. Blank lines are skipped. Of a repeated
    field the last one counts, but a status or time that cannot be read is an
    error wherever it stands. Parsing and checks are built-in expressions,
    evaluated once per line.
    """
    if mode not in MODES:
        raise ValueError(f"mode should be one of {MODES}, but: {mode}")
    names = _labels(labels)
    line, fields = F.col("_line"), F.col("_fields")
    df = lines.where(F.col(value) != "").select(
        F.col(ord).alias("ord"), F.col(value).alias("_line"), F.split(value, "\t").alias("_fields")
    )
    # Each line is cut up once; most of its fields are then out of the way.
    df = df.select(
        "ord",
        "_line",
        F.exists(fields, lambda f: ~F.contains(f, F.lit(":"))).alias("_unlabelled"),
        _fields(fields, names.values()).alias("_fields"),
    )
    df = df.select(
        "ord",
        "_line",
        "_unlabelled",
        F.coalesce(_last(fields, names["req"]), F.lit("")).alias("req"),
        _last(fields, names["status"]).alias("_status"),
        _last(fields, names["time"]).alias("_time"),
        _bad_before(fields, names["status"], parse_status).alias("_bad_status"),
        _bad_before(fields, names["time"], lambda v: parse_time(v, time_format)).alias("_bad_time"),
        F.try_element_at(_cookies(fields, [names["uidset"], names["uidgot"]]), F.lit(-1)).alias("_cookie"),
        (F.size(_cookies(fields, [names["uidset"]])) > 0).alias("set_new_uid"),
    )
    df = df.withColumns(
        {
            "uid": F.coalesce(strip_cookie_name(text_after(F.col("_cookie"), ":")), F.lit("")),
            "status": parse_status(F.col("_status")),
            "time": parse_time(F.col("_time"), time_format),
        }
    )
    status, time = F.col("status"), F.col("time")
    error = (
        F.when(F.col("_unlabelled"), F.lit("field without a label"))
        .when(F.col("_bad_status") | (status.isNull() & F.col("_status").isNotNull()), F.lit("bad status"))
        .when(F.col("_bad_time") | (time.isNull() & F.col("_time").isNotNull()), F.lit("bad time"))
        .when(F.col("req") == "", F.lit("missing req"))
        .when(status.isNull() | (status == 0), F.lit("missing status"))
        .when(time.isNull(), F.lit("missing time"))
        .when(F.col("uid") == "", F.lit("missing uid"))
    )
    df = with_request_parts(df.withColumn("error", error)).withColumns(
        {"uri": F.col("path"), "route_id": F.lit(None).cast("int")}
    )
    df = computed_once(df.select(*ENTRY_COLUMNS, "error", "_line"))
    good = F.col("error").isNull()
    if mode == "failfast":
        stop = F.raise_error(F.concat(F.lit("malformed log line: "), "error", F.lit(": "), "_line"))
        df = df.where(F.when(good, True).otherwise(stop.cast("boolean")))
    elif mode == "dropmalformed":
        df = df.where(good)
    extra = ("error",) if mode == "permissive" else ()
    return df.select(*ENTRY_COLUMNS, *extra)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of text files, blank ones too, as ``(value, ord)`` with ``ord`` the file and the line number, from 1.

    Spark cuts files into splits and knows a line's place in its split only.
    A first pass counts the lines of every split; what the splits before it in
    the file add up to is where its own numbers begin. That table has a row
    per split, so the second pass, which reads the texts, is not shuffled
    unless it is larger than a broadcast may be.
    """
    row = F.monotonically_increasing_id().alias("row")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    splits = spark.read.text(paths).select(*place, row).groupBy("file", "block").agg(
        F.count("*").alias("rows"), F.min("row").alias("first")
    )
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of a split follow one another, and both passes cut files alike.
    begins = splits.select(
        "file", "block", (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    lines = spark.read.text(paths).select("value", *place, row)
    return lines.join(begins, ["file", "block"]).select(
        "value", F.struct("file", (F.col("row") + F.col("shift")).alias("line")).alias("ord")
    )


def read_ltsv(spark: SparkSession, paths: str | list[str], line_numbers: bool = False, **options) -> DataFrame:
    """Read one or more LTSV files, directories or globs into entries.

    ``ord`` keeps the order of lines: by file, then by the offset of the split
    within the file, then by the row within the split. With ``line_numbers``
    it is the file and the number of the line in it, which takes a pass more
    to count lines, see :func:`numbered_lines`.
    """
    if line_numbers:
        return parse_lines(numbered_lines(spark, paths), **options)
    lines = spark.read.text(paths).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ord"),
    )
    return parse_lines(lines, **options)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the number of the row within its task, so within each split rows rise in line order."""
    start = 0
    for batch in batches:
        rows = pa.array(range(start, start + batch.num_rows), pa.int64())
        start += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "row"])


def stream_ltsv(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """New LTSV files in a folder as a stream of entries.

    ``ord`` keeps the order of lines as :func:`read_ltsv` does. Spark numbers
    no rows in a stream, so the tasks that read the lines count them.
    """
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = (
        reader.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .mapInArrow(_numbered, "value string, path string, block bigint, row bigint")
        .select("value", F.struct("path", "block", "row").alias("ord"))
    )
    return parse_lines(lines, **options)
