"""Node and edge tables of the transition and scenario graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.functions.scores import intensity, log_norm, percent_truncated


def _total(counts: DataFrame, of: Column) -> Column:
    return counts.agg(F.sum(of).alias("total")).select(F.coalesce("total", F.lit(0))).scalar()


def transition_nodes(counts: DataFrame) -> DataFrame:
    """Endpoints with their share, font size and intensity.

    ``counts`` is the result of ``endpoint_counts``. The total is taken over
    the same counts, so the shuffle that made them is used twice, not redone.
    """
    total = _total(counts, F.col("count"))
    sized = counts.select("endpoint", "count", total.alias("total"))
    return sized.select(
        "endpoint",
        "count",
        percent_truncated(F.col("count"), F.col("total")).alias("percent"),
        (log_norm(F.col("count"), F.col("total"), 16) + 8).alias("font_size"),
        intensity(F.col("count"), F.col("total")).alias("intensity"),
    )


def requests(entries: DataFrame) -> Column:
    """The number of requests as a scalar subquery."""
    return entries.agg(F.count("*").alias("total")).scalar()


def transition_graph_edges(edges: DataFrame, total: Column | None = None) -> DataFrame:
    """Edges with weight, pen width and intensity; ``start`` and ``end`` named.

    Every request is the target of exactly one edge, so ``total`` is the number
    of requests, a plain count of the entries. Without it the edges into real
    endpoints are added up, for which they are computed a second time.
    """
    if total is None:
        total = _total(edges, F.when(F.col("target") != "", F.col("count")))
    sized = edges.withColumn("total", total)
    named = lambda name, mark: F.when(F.col(name) == "", mark).otherwise(F.col(name))
    count, whole = F.col("count"), F.col("total")
    return sized.select(
        named("source", "start").alias("source"),
        named("target", "end").alias("target"),
        "count",
        (log_norm(count, whole, 1000) + 1).alias("weight"),
        (log_norm(count, whole, 7) + 1).alias("pen_width"),
        intensity(count, whole).alias("intensity"),
        F.when(F.col("source") == F.col("target"), "back").otherwise("forward").alias("dir"),
    )


def _shares(scenarios: DataFrame, total: Column | None) -> DataFrame:
    if total is None:
        total = _total(scenarios, F.col("count"))
    return scenarios.select(
        F.col("pattern").alias("scenario"), "leaves", "loops", "count", total.alias("total")
    ).withColumn("intensity", intensity(F.col("count"), F.col("total")))


def scenario_nodes(scenarios: DataFrame, total: Column | None = None) -> DataFrame:
    """One node per leaf of each scenario, plus its ``start`` and ``end``.

    Leaves are numbered from 0; ``start`` and ``end`` have no position.
    ``total`` is the number of users, see ``scenario.user_count``; without it
    the scenarios are computed a second time to add up their users.
    """
    node = lambda position, label, shade: F.struct(
        position.cast("int").alias("position"), label.alias("label"), shade.cast("double").alias("intensity")
    )
    none = F.lit(None)
    leaves = F.transform("leaves", lambda label, i: node(i, label, F.col("intensity")))
    ends = F.array(node(none, F.lit("start"), none), node(none, F.lit("end"), none))
    return _shares(scenarios, total).select("scenario", F.inline(F.concat(leaves, ends)))


def scenario_edges(scenarios: DataFrame, total: Column | None = None) -> DataFrame:
    """Forward edges between neighbouring leaves and a back edge per loop.

    ``source`` and ``target`` are leaf positions as text, or ``start`` and
    ``end``. ``in_reference`` is false for the back edge of a loop that begins
    the pattern without spanning it, which classic drawings leave out.
    ``total`` is as for :func:`scenario_nodes`.
    """
    shared = _shares(scenarios, total).withColumn("pen_width", F.col("count") * 10 / F.col("total") + 1)
    size = F.size("leaves")
    edge = lambda a, b, weight, drawn: F.struct(
        a.cast("string").alias("source"),
        b.cast("string").alias("target"),
        F.lit(weight).alias("weight"),
        drawn.alias("in_reference"),
    )
    yes = F.lit(True)
    forward = F.when(
        size > 1,
        F.transform(F.sequence(F.lit(0), size - 2), lambda i: edge(i, i + 1, 1000.0, yes)),
    ).otherwise(F.array().cast("array<struct<source:string,target:string,weight:double,in_reference:boolean>>"))
    back = F.transform(
        "loops",
        lambda loop: edge(loop["hi"], loop["lo"], 1.0, (loop["lo"] > 0) | (loop["hi"] == size - 1)),
    )
    ends = F.array(
        edge(F.lit("start"), F.lit(0), 1000.0, yes), edge(size - 1, F.lit("end"), 1000.0, yes)
    )
    return shared.select(
        "scenario", F.inline(F.concat(forward, back, ends)), "pen_width", "intensity"
    )
