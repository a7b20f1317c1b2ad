"""Endpoint-to-endpoint transitions per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.functions.request import endpoint
from hitpath.operators.ordering import SLICE_S, consecutive_pairs


def transition_edges(entries: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Count of each step from ``source`` to ``target`` over all users.

    An empty ``source`` marks a user's first request, an empty ``target`` the
    end after the last one.
    """
    rows = entries.select("uid", "time", "ord", endpoint().alias("endpoint"))
    pairs = consecutive_pairs(rows, "endpoint", slice_s)
    return (
        pairs.groupBy(
            F.coalesce("previous", F.lit("")).alias("source"),
            F.coalesce("following", F.lit("")).alias("target"),
        )
        .agg(F.sum("count").alias("count"))
    )


def endpoint_names(entries: DataFrame) -> list[str]:
    """The columns of the matrix: the end, then all endpoints in order.

    Refuses more names than ``spark.sql.pivotMaxValues``.
    """
    limit = int(entries.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = entries.select(endpoint().alias("endpoint")).distinct().orderBy("endpoint").limit(limit)
    names = [row[0] for row in found.collect()]
    if len(names) >= limit:
        raise ValueError(f"{limit} endpoints or more; use the edge list")
    return ["", *names] if names else []


def transition_matrix(edges: DataFrame, endpoints: list[str] | None = None) -> DataFrame:
    """The square, zero-filled count table, one row per source endpoint.

    ``endpoints`` names the columns, as :func:`endpoint_names` does from the
    entries; without it they are read from the edges, which are then computed
    twice, up to ``spark.sql.pivotMaxValues``. The edge list has no such bound.
    """
    if endpoints is None:
        limit = int(edges.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = edges.select(F.col("target").alias("endpoint")).distinct().orderBy("endpoint").limit(limit + 1)
        endpoints = [row[0] for row in found.collect()]
        if len(endpoints) > limit:
            raise ValueError(f"more than {limit} endpoints; use the edge list")
    return (
        edges.groupBy("source")
        .pivot("target", endpoints)
        .agg(F.sum("count"))
        .na.fill(0)
        .orderBy("source")
    )
