"""Path and query parameter statistics.

Everything starts from two count tables, each made in one scan and one
shuffle: :func:`param_values` (one row per parameter value) and
:func:`query_combos` (one row per combination of query keys or of whole
key-value lists). The statistics are further aggregations of those tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitpath.functions.request import endpoint
from hitpath.functions.scores import parameter_label, percent_text, rate
from hitpath.operators.routes import Routes

KINDS = ("path", "query", "all")
NONE = "(none)"

PARAM = ["method", "uri", "kind", "position", "name"]
COMBO = ["method", "uri", "kind"]


def _check_kind(kind: str) -> str:
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}: path, query or all")
    return kind


def _pieces(
    entries: DataFrame, routes: Routes | Iterable[str], kind: str, marker: bool, by: Iterable[str] = ()
) -> DataFrame:
    """One row per path group value and query token of each request.

    Group values and tokens are put in one array and exploded by position, so
    both kinds come out of a single scan. With ``marker`` each request also
    yields a row of kind ``request``, which counts the endpoint. Columns
    ``by`` go along.
    """
    if not isinstance(routes, Routes):
        routes = Routes(routes)
    path, route = F.col("path"), F.col("route_id")
    none = F.array().cast("array<string>")
    groups = names = none
    width = F.lit(0)
    if kind != "query" and len(routes):
        groups = F.coalesce(
            routes.by_id(
                route,
                [
                    F.array(*(F.regexp_extract(path, r.java, i + 1) for i in range(len(r.groups)))).cast("array<string>")
                    for r in routes.routes
                ],
            ),
            none,
        )
        names = F.coalesce(
            routes.by_id(route, [F.array(*map(F.lit, r.groups)).cast("array<string>") for r in routes.routes]), none
        )
        width = F.coalesce(routes.by_id(route, [len(r.groups) for r in routes.routes]), F.lit(0))
    tokens = F.split("query", "&") if kind != "path" else none
    head = F.array(F.lit("")) if marker else none
    offset = 1 if marker else 0

    rows = entries.select(
        *by,
        "method",
        "uri",
        names.alias("_names"),
        width.alias("_width"),
        F.posexplode(F.concat(head, groups, tokens)).alias("_at", "_text"),
    )
    at, text = F.col("_at") - offset, F.col("_text")
    request, grouped = at < 0, (at >= 0) & (at < F.col("_width"))
    cut = F.instr(text, "=")
    return rows.where(request | grouped | (cut > 0)).select(
        *by,
        "method",
        "uri",
        F.when(request, "request").when(grouped, "path").otherwise("query").alias("kind"),
        F.when(grouped, at + 1).otherwise(F.lit(0)).alias("position"),
        F.when(request, F.lit(""))
        .when(grouped, F.get("_names", at))
        .otherwise(F.substring_index(text, "=", 1))
        .alias("name"),
        F.when(request | grouped, text).otherwise(F.substr(text, cut + F.lit(1))).alias("value"),
    )


def pieces(entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all") -> DataFrame:
    """One row per value of a parameter of a request."""
    return _pieces(entries, routes, _check_kind(kind), marker=False)


def value_counts(
    entries: DataFrame, routes: Routes | Iterable[str], kind: str, marker: bool, by: Iterable[str] = ()
) -> DataFrame:
    """How often each value occurs; with ``marker`` also each endpoint, as a parameter of kind ``request``."""
    return (
        _pieces(entries, routes, _check_kind(kind), marker, by)
        .groupBy(*by, *PARAM, "value")
        .agg(F.count("*").alias("count"))
    )


def param_values(entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all") -> DataFrame:
    """How often each value of each parameter occurs.

    Path parameters are the capture groups of the matched route, numbered from
    1 and named if the group is; query parameters have position 0.
    """
    return value_counts(entries, routes, kind, marker=False)


def query_tokens(entries: DataFrame) -> DataFrame:
    """The ``key=value`` tokens of each query, sorted bytewise within it."""
    rows = entries.select(
        "ord", endpoint().alias("endpoint"),
        F.posexplode(F.sort_array(F.split("query", "&"))).alias("position", "token"),
    )
    cut = F.instr("token", "=")
    return rows.where(cut > 0).select(
        "ord",
        "endpoint",
        "position",
        F.substring_index("token", "=", 1).alias("key"),
        F.substr("token", cut + F.lit(1)).alias("value"),
    )


def query_key_counts(entries: DataFrame) -> DataFrame:
    """How often each query key occurs per endpoint."""
    return (
        _pieces(entries, (), "query", marker=False)
        .groupBy("method", "uri", F.col("name").alias("key"))
        .agg(F.count("*").alias("count"))
    )


def combo_counts(entries: DataFrame) -> DataFrame:
    """Counts of the combinations of all endpoints, also of those that never have a query; batch or stream."""
    whole = F.array_join(F.sort_array(F.split("query", "&")), "&")
    keys = F.array_join(F.regexp_extract_all("_tokens", F.lit("(?:^|&)([^=&]*)="), F.lit(1)), "&")
    none = F.col("query") == ""
    combo = lambda kind, text: F.struct(
        F.lit(kind).alias("kind"), F.when(none, NONE).otherwise(text).alias("combo")
    )
    rows = entries.select("method", "uri", "query", whole.alias("_tokens")).select(
        "method",
        "uri",
        none.alias("is_none"),
        F.inline(F.array(combo("key", keys), combo("value", F.col("_tokens")))),
    )
    return rows.groupBy(*COMBO, "is_none", "combo").agg(F.count("*").alias("count"))


def _combo_totals(counts: DataFrame) -> DataFrame:
    """Totals per endpoint and kind, for endpoints with at least one query."""
    real = ~F.col("is_none")
    per_kind = counts.groupBy(*COMBO).agg(
        F.sum("count").alias("total"),
        F.count("*").alias("cardinality"),
        F.count(F.when(real, 1)).alias("counted"),
    )
    return _with_shown(per_kind)


def _with_shown(per_kind: DataFrame) -> DataFrame:
    of_endpoint = Window.partitionBy("method", "uri")
    key_combos = F.max(F.when(F.col("kind") == "key", F.col("counted"))).over(of_endpoint)
    return per_kind.withColumn("shown", key_combos > 1).where(F.col("counted") > 0)


def query_combos(entries: DataFrame) -> DataFrame:
    """Counts of query key combinations and of whole key-value combinations.

    Kind ``key`` joins the keys and kind ``value`` the tokens of a query, in
    token order. Requests without a query count as ``(none)``, for endpoints
    that have a query at least once. That test reads the same shuffled counts.
    """
    return of_queried_endpoints(combo_counts(entries))


def of_queried_endpoints(counts: DataFrame) -> DataFrame:
    """The counts of endpoints with at least one query."""
    return counts.join(_combo_totals(counts).select(*COMBO), COMBO, "left_semi")


def _gini_terms(counts: DataFrame, keys: list[str], counted: Column | None = None) -> DataFrame:
    """Count distribution per group: how many values occur ``count`` times.

    A group with N hits has at most about sqrt(2N) distinct counts, so the
    running rank below works on few rows however many values there are.
    """
    x = F.col("count") if counted is None else F.when(counted, F.col("count"))
    sizes = counts.groupBy(*keys, x.alias("x")).agg(
        F.count("*").alias("m"), F.sum("count").alias("hits")
    )
    before = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("x").isNotNull()
    rank0 = F.coalesce(F.sum(F.when(real, F.col("m"))).over(before), F.lit(0))
    return sizes.withColumn("_rank0", rank0).withColumn(
        "_weighted",
        F.when(
            real,
            F.col("x").cast("double")
            * (F.col("m").cast("double") * F.col("_rank0") + F.col("m").cast("double") * (F.col("m") + 1) / 2),
        ),
    )


def distribution(
    counts: DataFrame, keys: list[str], counted: Column | None = None, corrected: bool = False
) -> DataFrame:
    """Total, cardinality and Gini coefficient of a count table per group.

    ``counted`` restricts the rows that enter the Gini coefficient; all rows
    enter total and cardinality. ``corrected`` multiplies by n / (n - 1).
    """
    terms = _gini_terms(counts, keys, counted)
    real = F.col("x").isNotNull()
    n = F.sum(F.when(real, F.col("m")))
    hits = F.sum(F.when(real, F.col("hits")))
    plain = F.lit(2.0) * F.sum("_weighted") / (n.cast("double") * hits) - (n + 1) / n
    if corrected:
        plain = F.when(n > 1, plain * n / (n - 1)).otherwise(F.lit(0.0))
    return terms.groupBy(*keys).agg(
        F.sum("hits").alias("count"),
        F.sum("m").alias("cardinality"),
        F.coalesce(n, F.lit(0)).alias("counted"),
        plain.alias("gini"),
    )


def label_of_parameter() -> Column:
    return parameter_label(F.col("kind"), F.col("position"), F.col("name"))


def param_stat(
    entries: DataFrame,
    routes: Routes | Iterable[str] = (),
    kind: str = "all",
    corrected: bool = False,
) -> DataFrame:
    """Count, share, cardinality and Gini coefficient of each parameter.

    A path parameter occurs in every request of its endpoint. The requests of
    an endpoint travel through the same counts as a parameter of their own.
    """
    return stat_of_counts(value_counts(entries, routes, kind, marker=True), corrected)


def stat_of_counts(counts: DataFrame, corrected: bool = False) -> DataFrame:
    """The statistics of a table of value counts that has those of the endpoints."""
    stats = distribution(counts, PARAM, corrected=corrected)
    of_endpoint = Window.partitionBy("method", "uri")
    requests = F.max(F.when(F.col("kind") == "request", F.col("count"))).over(of_endpoint)
    return (
        stats.withColumn("requests", requests)
        .where(F.col("kind") != "request")
        .select(
            endpoint().alias("endpoint"),
            "method",
            "uri",
            F.col("kind").alias("type"),
            "position",
            label_of_parameter().alias("parameter"),
            "count",
            rate(F.col("count"), F.col("requests")).alias("rate"),
            percent_text(F.col("count"), F.col("requests")).alias("percent"),
            "cardinality",
            "gini",
        )
    )


def param_cardinality(
    entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all", error: float | None = None
) -> DataFrame:
    """Number of distinct values of each parameter.

    Exact by default; ``error`` is the relative error of an estimate that
    does not have to shuffle the values.
    """
    if error is None:
        grouped = param_values(entries, routes, kind).groupBy(*PARAM).agg(F.count("*").alias("cardinality"))
    else:
        pieces = _pieces(entries, routes, _check_kind(kind), marker=False)
        grouped = pieces.groupBy(*PARAM).agg(F.approx_count_distinct("value", error).alias("cardinality"))
    return grouped.select(
        endpoint().alias("endpoint"), F.col("kind").alias("type"), "position", label_of_parameter().alias("parameter"), "cardinality"
    )


def order_params(stat: DataFrame) -> DataFrame:
    """Reading order: endpoints by URI and method, path before query."""
    return stat.orderBy("uri", "method", "type", "position", "parameter")


def _check_num(num: int) -> None:
    if num < 0:
        raise ValueError(f"num is negative: {num}")


def _top(counts: DataFrame, keys: list[str], value: str, num: int) -> DataFrame:
    """The ``num`` most frequent rows per group with running counts.

    The rank comes first: Spark cuts each partition to ``num`` rows per group
    before the shuffle, and the running sum then sees no more than that.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), value)
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num)
    running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("cum_count", F.sum("count").over(running))


def param_top_values(
    entries: DataFrame, routes: Routes | Iterable[str] = (), kind: str = "all", num: int = 5
) -> DataFrame:
    """The most frequent values of each parameter with their cumulative share.

    ``more`` is the number of values left out.
    """
    _check_num(num)
    counts = param_values(entries, routes, kind)
    totals = counts.groupBy(*PARAM).agg(
        F.sum("count").alias("total"), F.count("*").alias("cardinality")
    )
    return (
        _top(counts, PARAM, "value", num)
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
            F.greatest(F.col("cardinality") - num, F.lit(0)).alias("more"),
        )
    )


def query_combo_stat(entries: DataFrame, corrected: bool = False) -> DataFrame:
    """Cardinality and Gini coefficient of the combinations of each endpoint.

    ``(none)`` counts towards cardinality but not towards the Gini
    coefficient. ``shown`` tells whether the endpoint has more than one key
    combination, the rule by which the detail report lists either kind.
    """
    stats = distribution(combo_counts(entries), COMBO, ~F.col("is_none"), corrected)
    return _with_shown(stats).select(
        endpoint().alias("endpoint"), *COMBO, "count", "cardinality", "gini", "shown"
    )


def query_combo_top(entries: DataFrame, num: int = 5) -> DataFrame:
    """The most frequent combinations with their share of the endpoint's requests."""
    _check_num(num)
    counts = combo_counts(entries)
    return (
        _top(counts, COMBO, "combo", num)
        .join(_combo_totals(counts), COMBO)
        .select(
            endpoint().alias("endpoint"),
            *COMBO,
            "rank",
            "combo",
            "is_none",
            "count",
            "cum_count",
            rate(F.col("cum_count"), F.col("total")).alias("cum_rate"),
            F.greatest(F.col("cardinality") - num, F.lit(0)).alias("more"),
            "shown",
        )
    )
