"""Request entries from structured tables instead of log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.functions.request import computed_once, with_request_parts
from hitpath.functions.values import DEFAULT_TIME_FORMAT
from hitpath.sources.ltsv import ENTRY_COLUMNS


def _instant(wall: Column) -> Column:
    """A zoneless timestamp read as UTC, whatever the session time zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))


def event_requests(events: DataFrame) -> DataFrame:
    """Requests from an ``events`` table, batch or stream, row by row."""
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    path = F.concat(F.lit("/"), "event_type")
    query = F.concat(F.lit("k="), F.get_json_object("props", "$.k"))
    return events.select(
        F.col("event_id").alias("ord"),
        F.concat(method, F.lit(" "), path, F.lit("?"), query, F.lit(" HTTP/1.1")).alias("req"),
        method.alias("method"),
        path.alias("uri"),
        path.alias("path"),
        query.alias("query"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("user_id").cast("string").alias("uid"),
        _instant(F.col("ts")).alias("time"),
        F.lit(None).cast("int").alias("route_id"),
    )


def entries_from_events(events: DataFrame) -> DataFrame:
    """Entries from an ``events`` table of user actions.

    The first event of a user counts as the one that set the user id. It is
    found by an aggregation and matched back by event, so that no task has to
    see all events of a busy user.
    """
    first = (
        events.groupBy(F.col("user_id").cast("string").alias("uid"))
        .agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("ord"))
        .withColumn("_first", F.lit(True))
    )
    return (
        event_requests(events)
        .join(first, ["uid", "ord"], "left")
        .withColumn("set_new_uid", F.coalesce("_first", F.lit(False)))
        .select(*ENTRY_COLUMNS)
    )


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """Entries from a ``pages`` table: a GET of each URL by a user of its own."""
    rows = pages.select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1")).alias("req"),
        F.lit(200).alias("status"),
        F.col("page_id").cast("string").alias("uid"),
        F.lit(True).alias("set_new_uid"),
        F.timestamp_seconds("page_id").alias("time"),
        F.lit(None).cast("int").alias("route_id"),
    )
    parsed = with_request_parts(rows).withColumn("uri", F.col("path"))
    return computed_once(parsed.select(*ENTRY_COLUMNS))


def entries_from_conversations(conversations: DataFrame) -> DataFrame:
    """Entries from a ``conversations`` table: each turn posts to its role."""
    path = F.concat(F.lit("/"), "role")
    return conversations.select(
        F.col("turn").alias("ord"),
        F.concat(F.lit("POST "), path, F.lit(" HTTP/1.1")).alias("req"),
        F.lit("POST").alias("method"),
        path.alias("uri"),
        path.alias("path"),
        F.lit("").alias("query"),
        F.lit(200).alias("status"),
        F.col("conv_id").cast("string").alias("uid"),
        (F.col("turn") == 0).alias("set_new_uid"),
        F.timestamp_seconds("turn").alias("time"),
        F.lit(None).cast("int").alias("route_id"),
    )


def render_ltsv(entries: DataFrame, time_format: str = DEFAULT_TIME_FORMAT, labels: dict[str, str] | None = None) -> DataFrame:
    """Entries written back as LTSV lines, ``(ord, value)``."""
    name = lambda label: (labels or {}).get(label, label)
    cookie = F.concat(F.lit("uid="), "uid")
    new = F.col("set_new_uid")
    fields = {
        "time": F.date_format("time", time_format),
        "req": F.col("req"),
        "status": F.col("status").cast("string"),
        "uidset": F.when(new, cookie).otherwise("-"),
        "uidgot": F.when(new, F.lit("-")).otherwise(cookie),
    }
    parts = [F.concat(F.lit(name(label) + ":"), text) for label, text in fields.items()]
    return entries.select("ord", F.concat_ws("\t", *parts, F.lit("host:-")).alias("value"))
