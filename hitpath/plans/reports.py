"""The user-facing reports: options checked, columns named, rows ordered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.functions.scores import thousands
from hitpath.operators import params, scenario, transition, trend
from hitpath.operators.routes import Routes


def trend_report(
    entries: DataFrame, interval: int = 5, sort: Iterable[str] = ("sum:desc",), steps: int | None = None
) -> DataFrame:
    """Method, URI and one count column per time bucket, in ``sort`` order."""
    wide = trend.trend_wide(entries, interval, steps)
    counts = F.array(*(F.col(f"`{c}`") for c in wide.columns[2:]))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    ready = wide.withColumns({"counts": counts, "sum": total})
    return trend.sort_trend(ready, sort).drop("counts", "sum")


def transition_matrix_report(entries: DataFrame, endpoints: list[str] | None = None) -> DataFrame:
    """The transition counts as a square table."""
    if endpoints is None:
        endpoints = transition.endpoint_names(entries)
    return transition.transition_matrix(transition.transition_edges(entries), endpoints)


def scenario_report(entries: DataFrame, share: float = scenario.LATE_SHARE) -> DataFrame:
    """Scenarios in order of their first call."""
    found = scenario.scenarios(entries, share)
    return scenario.order_scenarios(found).select("first_req_ms", "last_req_ms", "count", "pattern")


def param_stat_report(
    entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all", display: bool = False
) -> DataFrame:
    """One row per parameter; ``display`` formats the numbers as text."""
    stat = params.order_params(params.param_stat(entries, routes, kind))
    shown = thousands if display else (lambda c: c)
    gini = F.format_string("%.3f", "gini") if display else F.col("gini")
    return stat.select(
        "endpoint",
        "type",
        "parameter",
        shown(F.col("count")).alias("count"),
        "percent",
        shown(F.col("cardinality")).alias("cardinality"),
        gini.alias("gini"),
    )


def param_detail_report(
    entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all", num: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Top values per parameter, and top query combinations per endpoint.

    The combinations are those the report shows: of endpoints with more than
    one combination of query keys. ``kind="path"`` has none.
    """
    values = params.param_top_values(entries, routes, kind, num).orderBy(
        "uri", "method", "type", "position", "parameter", "rank"
    )
    combos = params.query_combo_top(entries, num).where(F.col("shown") & F.lit(kind.lower() != "path"))
    return values, combos.orderBy("uri", "method", "kind", "rank")
