"""Queries over the test tables, each with the SQL that states its result.

``events`` is read as an access log of 150 x (sf / 0.01) users, ``pages`` as a
log of absolute URLs with path and query parameters, and ``conversations`` as
user sequences whose folded pattern has a closed form. Every query reads its
whole table.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hitpath.functions.request import endpoint
from hitpath.functions.scores import log_norm
from hitpath.operators import graph, heavy, params, paramstate, scenario, transition, trend
from hitpath.operators.filters import filter_entries
from hitpath.operators.routeindex import RouteIndex, apply_route_index, route_params, write_route_index
from hitpath.operators.routes import Routes, apply_routes
from hitpath.plans import reports
from hitpath.sources.ltsv import parse_lines, read_ltsv
from hitpath.sources.store import read_entries, replay_entries, write_entries, write_report
from hitpath.sources.tables import (
    entries_from_conversations,
    entries_from_events,
    entries_from_pages,
    event_requests,
    render_ltsv,
)
from hitpath.streaming import counts as stream_counts
from hitpath.streaming import scenarios as stream_scenario
from hitpath.streaming import transitions as stream_transitions
from hitpath.streaming import trend as stream_trend

# The training-data operators are optional; without their folder, or what they need, the rest works alone.
try:
    import corpus_pipeline
    from hitpath.llm import queries as llm_queries
except ImportError:
    llm_queries = None

DAY = 86400
LANGUAGES = ("de", "en", "es", "fr", "ja", "zh")
ROUTE = "^/(?P<lang>[a-z]{2})/([0-9]+)"
ROUTES = ["^/en/([0-9]+)\\.html$", "^/(?P<lang>en|fr)/(?P<id>[0-9]+)", "^/(de)/"]
FILTER = (
    "(method = 'POST' AND contains(uri, 'sign')) OR (status >= 500 AND NOT set_new_uid"
    " AND time >= TIMESTAMP '2024-01-10 10:00:00Z')"
)
LABELS = {"req": "request", "uidset": "set_id", "uidgot": "got_id"}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return entries_from_events(spark.read.parquet(f"{sf}/events.parquet"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return entries_from_pages(spark.read.parquet(f"{sf}/pages.parquet"))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return apply_routes(_pages(spark, sf), Routes([ROUTE]))


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    return entries_from_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: transitions between endpoints."""
    return transition.transition_edges(_events(spark, "/root/testdata/sf0.001"))


# --- Reading and parsing -----------------------------------------------------


def _parsed(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ord").alias("event_id"),
        "method",
        "uri",
        "query",
        "status",
        "uid",
        "set_new_uid",
        F.unix_seconds("time").alias("time_s"),
    )


def ltsv_parse(spark, sf):
    return _parsed(parse_lines(render_ltsv(_events(spark, sf))))


def ltsv_parse_labels(spark, sf):
    lines = render_ltsv(_events(spark, sf), labels=LABELS)
    return _parsed(parse_lines(lines, labels=LABELS))


def ltsv_rejects(spark, sf):
    """Lines damaged in five ways by the event's value, counted by error."""
    lines = render_ltsv(_events(spark, sf)).withColumnRenamed("ord", "event_id")
    values = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    line, x = F.col("value"), F.col("x")
    damaged = (
        F.when(x < 5, F.replace(line, F.lit("host:-"), F.lit("host")))
        .when(x < 10, F.replace(line, F.lit("status:"), F.lit("status:x")))
        .when(x < 15, F.regexp_replace(line, "time:[^\t]*", "time:yesterday"))
        .when(x < 20, F.regexp_replace(line, "req:[^\t]*\t", ""))
        .when(x < 25, F.replace(line, F.lit("uid="), F.lit("")))
        .when(x < 30, F.regexp_replace(line, "uid=[^\t]*", "-"))
        .otherwise(line)
    )
    broken = lines.join(values.withColumnRenamed("value", "x"), "event_id").select(
        F.col("event_id").alias("ord"), damaged.alias("value")
    )
    return (
        parse_lines(broken, mode="permissive")
        .groupBy(F.coalesce("error", F.lit("ok")).alias("error"))
        .agg(F.count("*").alias("lines"))
    )


def ltsv_file_lines(spark, sf):
    """The log as text files of four servers, read back with the numbers of their lines."""
    folder = f"{_scratch(spark)}/ltsv"
    lines = render_ltsv(_events(spark, sf)).withColumn("server", F.col("ord") % 4)
    lines.repartition("server").sortWithinPartitions("server", "ord").select("server", "value").write.partitionBy("server").text(folder)
    found = read_ltsv(spark, folder, line_numbers=True)
    server = F.regexp_extract("ord.file", "server=([0-9]+)", 1).cast("int")
    return found.select(server.alias("server"), "ord.line", "method", "uri", "query", "uid")


def entries_between(spark, sf):
    """Requests of some hours of the stored log, whose other days are not read."""
    folder = f"{_scratch(spark)}/entries"
    write_entries(_events(spark, sf), folder)
    found = read_entries(spark, folder, "2024-01-10 10:00:00Z", "2024-01-12 00:30:00Z")
    return found.select(F.col("ord").alias("event_id"), "method", "uri", "uid")


def request_parts(spark, sf):
    return _pages(spark, sf).select(F.col("ord").alias("page_id"), "method", "path", "query")


def filter_rows(spark, sf):
    return filter_entries(_events(spark, sf), FILTER).select(
        F.col("ord").alias("event_id"), "method", "uri", "status", "uid"
    )


# --- Routes and parameters ---------------------------------------------------


def route_groups(spark, sf):
    return apply_routes(_pages(spark, sf), Routes(ROUTES)).select(
        F.col("ord").alias("page_id"), "route_id", endpoint().alias("endpoint")
    )


def route_groups_join(spark, sf):
    """A given list of routes, one per language, taken from a configuration table."""
    table = spark.createDataFrame([(i, f"^/{lang}/([0-9]+)") for i, lang in enumerate(LANGUAGES)], "route_id int, pattern string")
    return trend.endpoint_counts(apply_route_index(_pages(spark, sf), _index(spark, table))).select("endpoint", "count")


def _index(spark, table):
    folder = f"{_scratch(spark)}/routes"
    write_route_index(table, folder)
    return RouteIndex(spark, folder)


def _part_log(spark, sf):
    """Order lines as requests for the page of a part and its supplier, every seventh through another site."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    path = F.concat(
        F.when(F.col("l_linenumber") == 7, F.lit("/mirror")).otherwise(F.lit("")),
        F.lit("/parts/"), "l_partkey", F.lit("/suppliers/"), "l_suppkey",
    )
    return lines.select(F.lit("GET").alias("method"), path.alias("path"), F.lit(None).cast("int").alias("route_id"), path.alias("uri"))


def _part_routes(spark, sf):
    """A route for each part: of even ones wherever it stands, of odd ones at the start; and, before them, for some suppliers."""
    key = F.col("p_partkey")
    part = F.concat(
        F.when(key % 2 == 0, F.lit("/parts/")).otherwise(F.lit("^/parts/")), key.cast("string"),
        F.lit("/suppliers/(?P<supplier>[0-9]+)$"),
    )
    parts = spark.read.parquet(f"{sf}/part.parquet").select((key + 10).cast("int").alias("route_id"), part.alias("pattern"))
    first = spark.range(3).select(
        F.col("id").cast("int").alias("route_id"),
        F.concat(F.lit("^/parts/(?P<part>[0-9]*"), F.col("id").cast("string"), F.lit(")/suppliers/"), (F.col("id") + 4).cast("string"), F.lit("$")).alias("pattern"),
    )
    return first.unionByName(parts)


def route_index_counts(spark, sf):
    """A list of routes as long as the table of parts."""
    log = apply_route_index(_part_log(spark, sf), _index(spark, _part_routes(spark, sf)))
    return log.groupBy("route_id", "uri").agg(F.count("*").alias("count"))


def route_index_params(spark, sf):
    found = route_params(_part_log(spark, sf), _index(spark, _part_routes(spark, sf)))
    return found.select("uri", "position", "name", "value", "count")

def path_params(spark, sf):
    values = params.param_values(_routed(spark, sf), [ROUTE], "path")
    return values.select(endpoint().alias("endpoint"), "position", "name", "value", "count")


def path_param_counts(spark, sf):
    values = params.param_values(apply_routes(_pages(spark, sf), Routes(ROUTES)), ROUTES, "path")
    return values.select(endpoint().alias("endpoint"), "position", "name", "value", "count")


def query_tokens(spark, sf):
    return params.query_tokens(_pages(spark, sf)).select(
        F.col("ord").alias("page_id"), "position", "key", "value"
    )


def query_key_counts(spark, sf):
    return params.query_key_counts(_routed(spark, sf)).select(endpoint().alias("endpoint"), "key", "count")


def query_value_counts(spark, sf):
    values = params.param_values(_routed(spark, sf), kind="query")
    return values.select(endpoint().alias("endpoint"), F.col("name").alias("key"), "value", "count")


def _combos(spark, sf, kind):
    combos = params.query_combos(_routed(spark, sf)).where(F.col("kind") == kind)
    return combos.select(endpoint().alias("endpoint"), "combo", "count")


def param_cardinality(spark, sf):
    found = params.param_cardinality(_routed(spark, sf), [ROUTE])
    return found.select("endpoint", "type", "parameter", "cardinality")


def param_gini(spark, sf):
    stat = params.param_stat(_routed(spark, sf), [ROUTE])
    return stat.select("endpoint", "type", "parameter", F.round("gini", 6).alias("gini"))


def _stat(df):
    return df.select(
        "endpoint",
        "type",
        "parameter",
        "count",
        F.round("rate", 6).alias("rate"),
        "percent",
        "cardinality",
        F.round("gini", 6).alias("gini"),
    )


def param_stat(spark, sf):
    return _stat(params.param_stat(_routed(spark, sf), [ROUTE]))


def param_stat_query_only(spark, sf):
    return _stat(params.param_stat(_routed(spark, sf), [ROUTE], "query"))


def param_stat_events(spark, sf):
    return _stat(params.param_stat(_events(spark, sf)))


def _param_days(spark, sf):
    """The state of the log's parameters, stored in two goes."""
    folder, log = f"{_scratch(spark)}/params", _events(spark, sf)
    early = F.to_date("time") < F.lit("2024-01-12").cast("date")
    paramstate.write_param_state(log.where(early), folder)
    paramstate.write_param_state(log.where(~early), folder)
    return folder


def param_stat_days(spark, sf):
    """Statistics of all stored days, united."""
    return _stat(paramstate.param_stat_of_days(spark, _param_days(spark, sf)))


def param_stat_some_days(spark, sf):
    """Statistics of a week of them."""
    return _stat(paramstate.param_stat_of_days(spark, _param_days(spark, sf), "2024-01-08", "2024-01-14"))


def param_cardinality_days(spark, sf):
    """Distinct values by sketches, which are exact for so few."""
    found = paramstate.param_cardinality_of_days(spark, _param_days(spark, sf))
    return found.select("endpoint", "type", "parameter", "cardinality", "count")


def param_top_values(spark, sf):
    top = params.param_top_values(_routed(spark, sf), [ROUTE], num=3)
    return top.select(
        "endpoint", "type", "parameter", "rank", "value", "count", "cum_count",
        F.round("cum_rate", 6).alias("cum_rate"), "more",
    )


def param_top_values_events(spark, sf):
    top = params.param_top_values(_events(spark, sf), num=5)
    return top.select(
        "endpoint", "type", "parameter", "rank", "value", "count", "cum_count",
        F.round("cum_rate", 6).alias("cum_rate"), "more",
    )


def param_heavy_values(spark, sf):
    """Top values by summaries of each task and an exact count of their candidates."""
    _scratch(spark)
    top = heavy.param_heavy_values(_events(spark, sf), num=5)
    return top.select(
        "endpoint", "type", "parameter", "rank", "value", "count", "cum_count", F.round("cum_rate", 6).alias("cum_rate")
    )


def query_combo_top(spark, sf):
    top = params.query_combo_top(_routed(spark, sf), num=3)
    return top.select(
        "endpoint", "kind", "rank", "combo", "count", "cum_count",
        F.round("cum_rate", 6).alias("cum_rate"), "more", "shown",
    )


def query_combo_stat(spark, sf):
    stat = params.query_combo_stat(_routed(spark, sf))
    return stat.select(
        "endpoint", "kind", "count", "cardinality", F.round("gini", 6).alias("gini"), "shown"
    )


def param_stat_display(spark, sf):
    """The report as it is read, with numbers as text."""
    return reports.param_stat_report(_routed(spark, sf), [ROUTE], display=True)


# --- Trend -------------------------------------------------------------------


def endpoint_counts(spark, sf):
    return trend.endpoint_counts(_events(spark, sf)).select("endpoint", "count")


def trend_long(spark, sf):
    return trend.trend_counts(_events(spark, sf), DAY).select("endpoint", "step", "count")


def trend_signal(spark, sf):
    return trend.trend_signals(_events(spark, sf), 3600).select("endpoint", "step", "count", "signal")


def trend_vector(spark, sf):
    return trend.trend_vectors(_events(spark, sf), DAY).select(
        "endpoint", "sum", F.array_join("counts", ",").alias("counts")
    )


def trend_sorted(spark, sf):
    ordered = trend.sort_trend(
        trend.trend_vectors(_events(spark, sf), DAY), ["method:asc", "sum:desc", "countN:asc"]
    )
    return ordered.select(
        "method",
        "uri",
        "sum",
        F.get("counts", 0).alias("count0"),
        F.get("counts", 1).alias("count1"),
        F.element_at("counts", -1).alias("countn"),
    )


def trend_wide(spark, sf):
    return trend.trend_wide(_events(spark, sf), 10 * DAY)


def report_files(spark, sf):
    """A report written as CSV and as TSV, and both read back as text with its schema."""
    table = trend.trend_wide(_events(spark, sf), 10 * DAY)
    folder, found = _scratch(spark), []
    for format, sep in (("csv", ","), ("tsv", "\t")):
        write_report(table, f"{folder}/{format}", format)
        read = spark.read.schema(table.schema).option("header", True).option("enforceSchema", False).option("sep", sep)
        found.append(read.csv(f"{folder}/{format}").withColumn("format", F.lit(format)))
    return found[0].unionByName(found[1])


# --- Transitions -------------------------------------------------------------


def transition_edges(spark, sf):
    return transition.transition_edges(_events(spark, sf))


def transition_matrix(spark, sf):
    events = _events(spark, sf)
    matrix = transition.transition_matrix(transition.transition_edges(events), transition.endpoint_names(events))
    return matrix.withColumnRenamed("", "(end)")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def transition_nodes(spark, sf):
    nodes = graph.transition_nodes(trend.endpoint_counts(_events(spark, sf)))
    return _rounded(nodes, "percent", "font_size", "intensity")


def transition_graph_edges(spark, sf):
    events = _events(spark, sf)
    edges = graph.transition_graph_edges(transition.transition_edges(events), graph.requests(events))
    return _rounded(edges, "weight", "pen_width", "intensity")


def log_norm_events(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    num = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", F.round(log_norm(num, F.lit(1_000_000), 6), 6).alias("scaled")
    )


# --- Scenarios ---------------------------------------------------------------


def user_window(spark, sf):
    return scenario.user_window(_events(spark, sf))


def user_window_early(spark, sf):
    return scenario.user_window(_events(spark, sf), share=0.005)


def scenario_orphans(spark, sf):
    """Users left without a new-id request by a filter on the path."""
    visible = filter_entries(_events(spark, sf), "uri NOT IN ('/view', '/click')")
    return scenario.orphan_users(visible)


def scenario_sequences(spark, sf):
    return scenario.sequences(_events(spark, sf))


def _pattern(df):
    return df.select(F.col("uid").alias("conv_id"), "pattern")


def scenario_patterns(spark, sf):
    return _pattern(scenario.user_patterns(_talks(spark, sf)))


def scenario_patterns_events(spark, sf):
    return scenario.user_patterns(_events(spark, sf)).select("uid", "pattern", F.size("leaves").alias("leaves"))


def scenarios(spark, sf):
    return scenario.scenarios(_talks(spark, sf)).select("first_req_ms", "last_req_ms", "count", "pattern")


def scenarios_events(spark, sf):
    found = scenario.order_scenarios(scenario.scenarios(_events(spark, sf), share=0.005))
    return found.select("first_req_ms", "last_req_ms", "count", "pattern")


def scenarios_all_events(spark, sf):
    """The scenarios of all users but those of the last twentieth of the period."""
    return scenario.scenarios(_events(spark, sf)).select("first_req_ms", "last_req_ms", "count", "pattern")


def scenario_nodes(spark, sf):
    talks = _talks(spark, sf)
    return _rounded(graph.scenario_nodes(scenario.scenarios(talks), scenario.user_count(talks)), "intensity")


def scenario_edges(spark, sf):
    talks = _talks(spark, sf)
    return _rounded(graph.scenario_edges(scenario.scenarios(talks), scenario.user_count(talks)), "pen_width", "intensity")


# --- Streams -----------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _scratch(spark):
    """A new folder that all executors share; where the session names none, as in tests, this machine is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="hitpath-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/query-{uuid.uuid4().hex}"


def _folders(spark):
    """New folders for the output and the checkpoint of a stream."""
    run = _scratch(spark)
    return f"{run}/out", f"{run}/checkpoint"


def _replayed(spark, sf):
    """The log as a stream, part by part, each a micro-batch at least."""
    yield from replay_entries(_events(spark, sf), f"{_scratch(spark)}/replay", parts=3)


def stream_trend_days(spark, sf):
    found = stream_trend.windowed_counts(event_requests(_stream(spark, sf)), DAY, "1 hour")
    return stream_trend.run_append(found, *_folders(spark)).select(
        "endpoint", F.unix_seconds("window_start").alias("window_s"), "count"
    )


def stream_transition_edges(spark, sf):
    stream_transitions.use_rocksdb(spark)
    steps = stream_transitions.steps(event_requests(_stream(spark, sf)))
    done = stream_trend.run_append(steps, *_folders(spark))
    return done.groupBy("source", "target").agg(F.count("*").alias("count"))


def stream_trend_signal(spark, sf):
    """The flags of all closed six-hour buckets, from the log part by part."""
    stream_transitions.use_rocksdb(spark)
    out, checkpoint = _folders(spark)
    origin = _events(spark, sf).agg(F.unix_micros(F.min("time"))).first()[0]
    for log in _replayed(spark, sf):
        found = stream_trend.run_append(stream_trend.signals(log, 6 * 3600, origin, "1 hour"), out, checkpoint)
    return found.select("endpoint", "step", "count", "signal")


def stream_endpoint_counts(spark, sf):
    found = stream_counts.endpoint_counts(event_requests(_stream(spark, sf)))
    return stream_counts.run_complete(found, *_folders(spark)).select("endpoint", "count")


def stream_param_counts(spark, sf):
    found = stream_counts.query_value_counts(event_requests(_stream(spark, sf)))
    return stream_counts.run_complete(found, *_folders(spark)).select("endpoint", "key", "value", "count")


def stream_combo_counts(spark, sf):
    out, checkpoint = _folders(spark)
    for log in _replayed(spark, sf):
        table = stream_counts.run_complete(stream_counts.combo_counts(log), out, checkpoint)
    found = params.of_queried_endpoints(table).where("kind = 'key'")
    return found.select(endpoint().alias("endpoint"), "combo", "count")


def stream_scenarios(spark, sf):
    """The patterns of all users, folded on from one micro-batch to the next."""
    stream_transitions.use_rocksdb(spark)
    out, checkpoint = _folders(spark)
    for log in _replayed(spark, sf):
        found = stream_counts.run_update(stream_scenario.user_patterns(log), ["uid"], out, checkpoint)
    return found.select("uid", "pattern", F.size("leaves").alias("leaves"))


IDLE_MS = 12 * 3600 * 1000


def stream_transition_exits(spark, sf):
    """Steps of users who leave when they are idle for half a day, the last exits by timers."""
    stream_transitions.use_rocksdb(spark)
    out, checkpoint = _folders(spark)
    for log in _replayed(spark, sf):
        found = stream_trend.run_append(stream_transitions.steps(log, idle_ms=IDLE_MS), out, checkpoint)
    return found.groupBy("source", "target").agg(F.count("*").alias("count"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ltsv_parse": ltsv_parse,
        "ltsv_parse_labels": ltsv_parse_labels,
        "ltsv_rejects": ltsv_rejects,
        "ltsv_file_lines": ltsv_file_lines,
        "entries_between": entries_between,
        "request_parts": request_parts,
        "filter_entries": filter_rows,
        "route_groups": route_groups,
        "route_groups_join": route_groups_join,
        "route_index_counts": route_index_counts,
        "route_index_params": route_index_params,
        "path_params": path_params,
        "path_param_counts": path_param_counts,
        "query_tokens": query_tokens,
        "query_key_counts": query_key_counts,
        "query_value_counts": query_value_counts,
        "query_key_combos": lambda spark, sf: _combos(spark, sf, "key"),
        "query_value_combos": lambda spark, sf: _combos(spark, sf, "value"),
        "param_cardinality": param_cardinality,
        "param_gini": param_gini,
        "param_stat": param_stat,
        "param_stat_query_only": param_stat_query_only,
        "param_stat_display": param_stat_display,
        "param_stat_events": param_stat_events,
        "param_stat_days": param_stat_days,
        "param_stat_some_days": param_stat_some_days,
        "param_cardinality_days": param_cardinality_days,
        "param_top_values": param_top_values,
        "param_top_values_events": param_top_values_events,
        "param_heavy_values": param_heavy_values,
        "query_combo_top": query_combo_top,
        "query_combo_stat": query_combo_stat,
        "endpoint_counts": endpoint_counts,
        "trend_long": trend_long,
        "trend_signal": trend_signal,
        "trend_vector": trend_vector,
        "trend_sorted": trend_sorted,
        "trend_wide": trend_wide,
        "report_files": report_files,
        "transition_edges": transition_edges,
        "transition_matrix": transition_matrix,
        "transition_nodes": transition_nodes,
        "transition_graph_edges": transition_graph_edges,
        "log_norm": log_norm_events,
        "scenario_user_window": user_window,
        "scenario_user_window_early": user_window_early,
        "scenario_orphans": scenario_orphans,
        "scenario_sequences": scenario_sequences,
        "scenario_patterns": scenario_patterns,
        "scenario_patterns_events": scenario_patterns_events,
        "scenarios": scenarios,
        "scenarios_events": scenarios_events,
        "scenarios_all_events": scenarios_all_events,
        "scenario_nodes": scenario_nodes,
        "scenario_edges": scenario_edges,
        "stream_trend": stream_trend_days,
        "stream_trend_signal": stream_trend_signal,
        "stream_transitions": stream_transition_edges,
        "stream_endpoint_counts": stream_endpoint_counts,
        "stream_param_counts": stream_param_counts,
        "stream_combo_counts": stream_combo_counts,
        "stream_scenarios": stream_scenarios,
        "stream_transition_exits": stream_transition_exits,
        **(llm_queries.queries() | {"pipeline": corpus_pipeline.run} if llm_queries else {}),
    }


# --- The same results in SQL -------------------------------------------------

# events as requests
_E = """
e AS (
  SELECT event_id AS ord,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/' || event_type AS uri,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END || ' /' || event_type AS endpoint,
         'k=' || regexp_extract(props, '"k": ([0-9]+)', 1) AS query,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CAST(user_id AS VARCHAR) AS uid,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS set_new_uid,
         ts AS "time", epoch_us(ts) AS us, value
  FROM events)"""

# pages as requests
_P = """
p AS (
  SELECT page_id, 'GET' AS method,
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') AS path,
         CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?')
              THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^[^?]*[?]', '') ELSE '' END AS query
  FROM pages)"""

_ROUTED = (
    _P
    + """,
r AS (
  SELECT *, 'GET ' || CASE WHEN regexp_matches(path, '^/[a-z]{2}/[0-9]+')
                           THEN '^/(?P<lang>[a-z]{2})/([0-9]+)' ELSE path END AS endpoint,
         regexp_matches(path, '^/[a-z]{2}/[0-9]+') AS routed
  FROM p)"""
)

# query tokens with "=", numbered in sorted order
_TOKENS = """,
t0 AS (SELECT {id} AS id, {endpoint} AS endpoint, query, unnest(list_sort(string_split(query, '&'))) AS token,
              generate_subscripts(string_split(query, '&'), 1) - 1 AS position FROM {source}),
t AS (SELECT id, endpoint, position, split_part(token, '=', 1) AS key,
             substr(token, strpos(token, '=') + 1) AS value FROM t0 WHERE contains(token, '='))"""

_PAGE_TOKENS = _TOKENS.format(id="page_id", endpoint="endpoint", source="r")
_EVENT_TOKENS = _TOKENS.format(id="ord", endpoint="endpoint", source="e")

# values of path groups and query keys
_PAGE_VALUES = (
    _ROUTED
    + _PAGE_TOKENS
    + """,
v AS (
  SELECT endpoint, 'path' AS type, ':lang' AS parameter, regexp_extract(path, '^/([a-z]{2})/([0-9]+)', 1) AS value,
         count(*) AS count FROM r WHERE routed GROUP BY ALL
  UNION ALL
  SELECT endpoint, 'path', 'Path param(2)', regexp_extract(path, '^/([a-z]{2})/([0-9]+)', 2), count(*)
  FROM r WHERE routed GROUP BY ALL
  UNION ALL
  SELECT endpoint, 'query', '?' || key, value, count(*) FROM t GROUP BY ALL),
n AS (SELECT endpoint, count(*) AS requests FROM r GROUP BY ALL)"""
)
_EVENT_VALUES = (
    _E
    + _EVENT_TOKENS
    + """,
v AS (SELECT endpoint, 'query' AS type, '?' || key AS parameter, value, count(*) AS count FROM t GROUP BY ALL),
n AS (SELECT endpoint, count(*) AS requests FROM e GROUP BY ALL)"""
)

_STAT = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY endpoint, type, parameter ORDER BY count) AS i FROM v),
s AS (
  SELECT endpoint, type, parameter, CAST(sum(count) AS BIGINT) AS count, count(*) AS cardinality,
         2.0 * sum(CAST(i AS DOUBLE) * count) / (count(*)::DOUBLE * sum(count)::DOUBLE)
           - (count(*) + 1)::DOUBLE / count(*)::DOUBLE AS gini
  FROM ranked GROUP BY ALL)
"""
_STAT_ROWS = """
SELECT endpoint, type, parameter, count, round(count::DOUBLE / requests, 6) AS rate,
       printf('%.2f', 100.0::DOUBLE * count / requests) AS percent, cardinality, round(gini, 6) AS gini
FROM s JOIN n USING (endpoint)"""

_TOP = """,
best AS (
  SELECT *, row_number() OVER (PARTITION BY endpoint, type, parameter ORDER BY count DESC, value) AS rank,
         sum(count) OVER (PARTITION BY endpoint, type, parameter ORDER BY count DESC, value
                          ROWS UNBOUNDED PRECEDING) AS running,
         sum(count) OVER (PARTITION BY endpoint, type, parameter) AS total,
         count(*) OVER (PARTITION BY endpoint, type, parameter) AS cardinality
  FROM v)
SELECT endpoint, type, parameter, CAST(rank AS INTEGER) AS rank, value, count,
       CAST(running AS BIGINT) AS cum_count, round(running::DOUBLE / total::DOUBLE, 6) AS cum_rate,
       greatest(cardinality - {num}, 0) AS more
FROM best WHERE rank <= {num}"""

_COMBOS = (
    _ROUTED
    + _PAGE_TOKENS
    + """,
keys AS (SELECT id, string_agg(key, '&' ORDER BY position) AS combo FROM t GROUP BY id),
texts AS (SELECT id, string_agg(token, '&' ORDER BY position) AS combo FROM t0 GROUP BY id),
c0 AS (
  SELECT endpoint, 'key' AS kind, query = '' AS is_none,
         CASE WHEN query = '' THEN '(none)' ELSE coalesce(combo, '') END AS combo
  FROM r LEFT JOIN keys ON page_id = id
  UNION ALL
  SELECT endpoint, 'value', query = '', CASE WHEN query = '' THEN '(none)' ELSE combo END
  FROM r JOIN texts ON page_id = id),
c AS (
  SELECT endpoint, kind, is_none, combo, count(*) AS count FROM c0
  WHERE endpoint IN (SELECT endpoint FROM r WHERE query <> '') GROUP BY ALL),
k AS (SELECT endpoint, count(*) > 1 AS shown FROM c WHERE kind = 'key' AND NOT is_none GROUP BY ALL)"""
)

# order lines as requests of parts, with the first of the routes that fits
_PARTS = """
l AS (
  SELECT l_partkey AS part, l_suppkey AS supplier, l_linenumber = 7 AS mirror,
         CASE WHEN l_linenumber = 7 THEN '/mirror' ELSE '' END || '/parts/' || l_partkey || '/suppliers/' || l_suppkey AS path
  FROM lineitem),
m AS (
  SELECT part, supplier, CASE WHEN NOT mirror AND supplier BETWEEN 4 AND 6 AND part % 10 = supplier - 4 THEN supplier - 4
                              WHEN p_partkey IS NULL OR (mirror AND part % 2 = 1) THEN NULL ELSE part + 10 END::INTEGER AS route_id,
         CASE WHEN route_id IS NULL THEN path
              WHEN route_id < 10 THEN '^/parts/(?P<part>[0-9]*' || route_id || ')/suppliers/' || supplier || '$'
              ELSE CASE WHEN part % 2 = 0 THEN '' ELSE '^' END || '/parts/' || part || '/suppliers/(?P<supplier>[0-9]+)$' END AS uri
  FROM l LEFT JOIN part ON p_partkey = part)"""

_TREND = (
    _E
    + """,
b AS (SELECT endpoint, method, uri, (us - (SELECT min(us) FROM e)) // (CAST({interval} AS BIGINT) * 1000000) AS step FROM e),
l AS (SELECT endpoint, method, uri, step, count(*) AS count FROM b GROUP BY ALL),
g AS (
  SELECT endpoint, method, uri, unnest(range(0, (SELECT max(step) + 1 FROM l))) AS step
  FROM (SELECT DISTINCT endpoint, method, uri FROM e)),
d AS (SELECT endpoint, method, uri, step, coalesce(count, 0) AS count FROM g LEFT JOIN l USING (endpoint, method, uri, step))"""
)

_EDGES = (
    _E
    + """,
w AS (
  SELECT endpoint, lag(endpoint) OVER u AS before, lead(endpoint) OVER u AS after
  FROM e WINDOW u AS (PARTITION BY uid ORDER BY "time", ord)),
x AS (
  SELECT coalesce(before, '') AS source, endpoint AS target FROM w
  UNION ALL
  SELECT endpoint, '' FROM w WHERE after IS NULL),
edges AS (SELECT source, target, count(*) AS count FROM x GROUP BY ALL),
total AS (SELECT count(*) AS total FROM e)"""
)

_INTENSITY = "(greatest(0.2::DOUBLE, least(0.8::DOUBLE, {level}::DOUBLE / {max}::DOUBLE)) - 0.2::DOUBLE) / 0.6::DOUBLE"
_LOG = "CASE WHEN {num} > 1 AND {src} > 1 THEN {target}::DOUBLE * ln({num}::DOUBLE) / ln({src}::DOUBLE) ELSE 0.0::DOUBLE END"

_WINDOW = (
    _E
    + """,
f AS (
  SELECT uid, (max(us) FILTER (WHERE set_new_uid) - (SELECT min(us) FROM e)) // 1000 AS first_req_ms,
         (max(us) - (SELECT min(us) FROM e)) // 1000 AS last_req_ms
  FROM e GROUP BY uid)
SELECT uid, first_req_ms, last_req_ms FROM f
WHERE first_req_ms <= (SELECT floor(((max(us) - min(us)) // 1000)::DOUBLE * {share}::DOUBLE) FROM e)"""
)

# the fold of every user's sequence, one request a step: a word and its loops, both ends included. Of the sizes z at
# which the last z leaves repeat the z before them, the least one counts whose cut lies inside no loop, whose first
# copy no loop enters from the left, and whose copies have no loops that cross when laid over each other.
_FOLD = (
    _E
    + """,
q AS (SELECT uid, endpoint, row_number() OVER (PARTITION BY uid ORDER BY us, ord) AS k FROM e),
fold AS (
  SELECT DISTINCT uid, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS w,
         CAST([] AS STRUCT(lo BIGINT, hi BIGINT)[]) AS loops FROM q
  UNION ALL
  SELECT uid, k, CASE WHEN z IS NULL THEN w ELSE w[1 : len(w) - z] END,
         CASE WHEN z IS NULL THEN loops ELSE list_distinct(list_concat(
           list_filter(loops, lambda l: l.hi <= len(w) - z),
           list_transform(list_filter(loops, lambda l: l.lo > len(w) - z),
                          lambda l: {'lo': CAST(l.lo - z AS BIGINT), 'hi': CAST(l.hi - z AS BIGINT)}),
           [{'lo': CAST(len(w) - 2 * z + 1 AS BIGINT), 'hi': CAST(len(w) - z AS BIGINT)}])) END
  FROM (
    SELECT *, list_filter(range(1, len(w) // 2 + 1), lambda z:
             w[len(w) - 2 * z + 1 : len(w) - z] = w[len(w) - z + 1 : len(w)]
             AND len(list_filter(loops, lambda l: l.lo <= len(w) - z AND l.hi > len(w) - z)) = 0
             AND len(list_filter(loops, lambda l:
                   l.lo <= len(w) - 2 * z AND l.hi > len(w) - 2 * z AND l.hi < len(w) - z)) = 0
             AND len(list_filter(loops, lambda a: a.lo > len(w) - 2 * z AND a.hi <= len(w) - z
                   AND len(list_filter(loops, lambda b: b.lo > len(w) - z
                         AND ((a.lo < b.lo - z AND b.lo - z <= a.hi AND a.hi < b.hi - z)
                           OR (b.lo - z < a.lo AND a.lo <= b.hi - z AND b.hi - z < a.hi)))) > 0)) = 0)[1] AS z
    FROM (SELECT uid, q.k, list_append(fold.w, q.endpoint) AS w, fold.loops
          FROM fold JOIN q USING (uid) WHERE q.k = fold.k + 1))),
folded AS (SELECT uid, arg_max(w, k) AS w, arg_max(loops, k) AS loops FROM fold GROUP BY uid)"""
)

_PATTERN = """array_to_string(list_transform(range(1, len({w}) + 1), lambda i:
           repeat('(', len(list_filter({loops}, lambda l: l.lo = i))) || {w}[i]
           || repeat(')*', len(list_filter({loops}, lambda l: l.hi = i)))), ' -> ')"""

# patterns of users in time, by leaves from the last text to the first: each joins the first one before it whose loops
# it does not cross
_MERGED = (
    _FOLD
    + _WINDOW.removeprefix(_E).rpartition("\nSELECT uid")[0]
    + f""",
same AS (
  SELECT w, list_sort(loops) AS loops, {_PATTERN.format(w="w", loops="list_sort(loops)")} AS pattern, count(*) AS count,
         min(first_req_ms) AS a, max(last_req_ms) AS b
  FROM folded JOIN f USING (uid)
  WHERE first_req_ms <= (SELECT floor(((max(us) - min(us)) // 1000)::DOUBLE * SHARE::DOUBLE) FROM e)
  GROUP BY w, list_sort(loops)),
given AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pattern DESC) AS k FROM same),
kept AS (
  SELECT w, k, [{{'loops': loops, 'count': count, 'a': a, 'b': b}}] AS classes FROM given WHERE k = 1
  UNION ALL
  SELECT w, k, CASE WHEN slot IS NULL THEN list_append(classes, {{'loops': loops, 'count': count, 'a': a, 'b': b}})
    ELSE list_transform(classes, lambda c, i: CASE WHEN i <> slot THEN c ELSE {{
      'loops': list_distinct(list_concat(c.loops, loops)), 'count': c.count + count,
      'a': least(c.a, a), 'b': greatest(c.b, b)}} END) END
  FROM (
    SELECT n.w, n.k, classes, n.loops, n.count, n.a, n.b,
           list_filter(range(1, len(classes) + 1), lambda j:
             len(list_filter(n.loops, lambda x: len(list_filter(classes[j].loops, lambda y:
               (x.lo < y.lo AND y.lo <= x.hi AND x.hi < y.hi) OR (y.lo < x.lo AND x.lo <= y.hi AND y.hi < x.hi))) > 0)) = 0)[1] AS slot
    FROM kept JOIN given n USING (w) WHERE n.k = kept.k + 1)),
merged AS (SELECT w, unnest(arg_max(classes, k)) AS c FROM kept GROUP BY w)"""
)

# conversations: an optional system turn, then user and assistant in turn
_TALKS = """
roles AS (
  SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS sys, max(turn) AS last_turn,
         (count(*) - count(*) FILTER (WHERE role = 'system')) // 2 AS pairs,
         (count(*) - count(*) FILTER (WHERE role = 'system')) % 2 = 1 AS extra
  FROM conversations GROUP BY conv_id),
shapes AS (
  SELECT *, CASE WHEN sys THEN ['POST /system'] ELSE [] END
         || CASE WHEN pairs >= 2 THEN ['(POST /user -> POST /assistant)*']
                 WHEN pairs = 1 THEN ['POST /user -> POST /assistant'] ELSE [] END
         || CASE WHEN extra THEN ['POST /user'] ELSE [] END AS parts
  FROM roles),
merged AS (
  SELECT sys, least(pairs, 1) AS has_pair, extra, max(pairs) >= 2 AS looped, count(*) AS count,
         CAST(0 AS BIGINT) AS first_req_ms, max(last_turn) * 1000 AS last_req_ms
  FROM roles GROUP BY sys, least(pairs, 1), extra),
sc AS (
  SELECT *, CASE WHEN sys THEN ['POST /system'] ELSE [] END
         || CASE WHEN has_pair = 1 THEN ['POST /user', 'POST /assistant'] ELSE [] END
         || CASE WHEN extra THEN ['POST /user'] ELSE [] END AS leaves,
         array_to_string(CASE WHEN sys THEN ['POST /system'] ELSE [] END
         || CASE WHEN looped THEN ['(POST /user -> POST /assistant)*']
                 WHEN has_pair = 1 THEN ['POST /user -> POST /assistant'] ELSE [] END
         || CASE WHEN extra THEN ['POST /user'] ELSE [] END, ' -> ') AS pattern
  FROM merged),
sc_total AS (SELECT CAST(sum(count) AS BIGINT) AS total FROM sc)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def oracle_sql() -> dict[str, str]:
    parsed = "ord AS event_id, method, uri, query, status, uid, set_new_uid, us // 1000000 AS time_s"
    level = {"level": "count", "max": "total"}
    merged = _with(
        _MERGED,
        f"""SELECT c.a AS first_req_ms, c.b AS last_req_ms, CAST(c.count AS BIGINT) AS count,
                  {_PATTERN.format(w="w", loops="c.loops")} AS pattern FROM merged""",
    ).replace("WITH", "WITH RECURSIVE", 1)
    patterns = _with(
        _FOLD, f"SELECT uid, {_PATTERN.format(w='w', loops='loops')} AS pattern, CAST(len(w) AS INTEGER) AS leaves FROM folded"
    ).replace("WITH", "WITH RECURSIVE", 1)
    return {
        "ltsv_parse": _with(_E, f"SELECT {parsed} FROM e"),
        "ltsv_parse_labels": _with(_E, f"SELECT {parsed} FROM e"),
        "ltsv_rejects": """
            SELECT CASE WHEN value < 5 THEN 'field without a label' WHEN value < 10 THEN 'bad status'
                        WHEN value < 15 THEN 'bad time' WHEN value < 20 THEN 'missing req' WHEN value < 25 THEN 'ok'
                        WHEN value < 30 THEN 'missing uid' ELSE 'ok' END AS error, count(*) AS lines
            FROM events GROUP BY 1""",
        "ltsv_file_lines": _with(
            _E,
            """SELECT CAST(ord % 4 AS INTEGER) AS server, row_number() OVER (PARTITION BY ord % 4 ORDER BY ord) AS line,
                      method, uri, query, uid FROM e""",
        ),
        "entries_between": _with(
            _E,
            """SELECT ord AS event_id, method, uri, uid FROM e
               WHERE "time" >= TIMESTAMP '2024-01-10 10:00:00' AND "time" < TIMESTAMP '2024-01-12 00:30:00'""",
        ),
        "request_parts": _with(_P, "SELECT page_id, method, path, query FROM p"),
        "filter_entries": _with(
            _E,
            """SELECT ord AS event_id, method, uri, status, uid FROM e
               WHERE (method = 'POST' AND contains(uri, 'sign'))
                  OR (status >= 500 AND NOT set_new_uid AND "time" >= TIMESTAMP '2024-01-10 10:00:00')""",
        ),
        "route_groups": _with(
            _P,
            """SELECT page_id,
                 CASE WHEN regexp_matches(path, '^/en/([0-9]+)\\.html$') THEN 0
                      WHEN regexp_matches(path, '^/(en|fr)/([0-9]+)') THEN 1
                      WHEN regexp_matches(path, '^/(de)/') THEN 2 END AS route_id,
                 'GET ' || CASE WHEN regexp_matches(path, '^/en/([0-9]+)\\.html$') THEN '^/en/([0-9]+)\\.html$'
                      WHEN regexp_matches(path, '^/(en|fr)/([0-9]+)') THEN '^/(?P<lang>en|fr)/(?P<id>[0-9]+)'
                      WHEN regexp_matches(path, '^/(de)/') THEN '^/(de)/' ELSE path END AS endpoint
               FROM p""",
        ),
        "route_groups_join": _with(
            _P,
            """, routes AS (SELECT '^/' || unnest(['de', 'en', 'es', 'fr', 'ja', 'zh']) || '/([0-9]+)' AS pattern),
               hit AS (SELECT page_id, min(pattern) AS pattern FROM p JOIN routes ON regexp_matches(path, pattern) GROUP BY page_id)
               SELECT 'GET ' || coalesce(hit.pattern, path) AS endpoint, count(*) AS count
               FROM p LEFT JOIN hit USING (page_id) GROUP BY 1""",
        ),
        "route_index_counts": _with(_PARTS, "SELECT route_id, uri, count(*) AS count FROM m GROUP BY ALL"),
        "route_index_params": _with(
            _PARTS,
            """SELECT uri, 1 AS position, CASE WHEN route_id < 10 THEN 'part' ELSE 'supplier' END AS name,
                      CAST(CASE WHEN route_id < 10 THEN part ELSE supplier END AS VARCHAR) AS value, count(*) AS count
               FROM m WHERE route_id IS NOT NULL GROUP BY ALL""",
        ),
        "path_params": _with(
            _ROUTED,
            """SELECT endpoint, 1 AS position, 'lang' AS name,
                      regexp_extract(path, '^/([a-z]{2})/([0-9]+)', 1) AS value, count(*) AS count
               FROM r WHERE routed GROUP BY ALL
               UNION ALL
               SELECT endpoint, 2, '', regexp_extract(path, '^/([a-z]{2})/([0-9]+)', 2), count(*)
               FROM r WHERE routed GROUP BY ALL""",
        ),
        "path_param_counts": _with(
            _P,
            """, m AS (
                 SELECT path, CASE WHEN regexp_matches(path, '^/en/([0-9]+)\\.html$') THEN 0
                      WHEN regexp_matches(path, '^/(en|fr)/([0-9]+)') THEN 1
                      WHEN regexp_matches(path, '^/(de)/') THEN 2 END AS id FROM p),
               g AS (
                 SELECT 'GET ^/en/([0-9]+)\\.html$' AS endpoint, 1 AS position, '' AS name,
                        regexp_extract(path, '^/en/([0-9]+)\\.html$', 1) AS value FROM m WHERE id = 0
                 UNION ALL SELECT 'GET ^/(?P<lang>en|fr)/(?P<id>[0-9]+)', 1, 'lang', regexp_extract(path, '^/(en|fr)/([0-9]+)', 1)
                 FROM m WHERE id = 1
                 UNION ALL SELECT 'GET ^/(?P<lang>en|fr)/(?P<id>[0-9]+)', 2, 'id', regexp_extract(path, '^/(en|fr)/([0-9]+)', 2)
                 FROM m WHERE id = 1
                 UNION ALL SELECT 'GET ^/(de)/', 1, '', 'de' FROM m WHERE id = 2)
               SELECT endpoint, position, name, value, count(*) AS count FROM g GROUP BY ALL""",
        ),
        "query_tokens": _with(
            _ROUTED + _PAGE_TOKENS,
            "SELECT id AS page_id, CAST(position AS INTEGER) AS position, key, value FROM t",
        ),
        "query_key_counts": _with(
            _ROUTED + _PAGE_TOKENS, "SELECT endpoint, key, count(*) AS count FROM t GROUP BY ALL"
        ),
        "query_value_counts": _with(
            _ROUTED + _PAGE_TOKENS, "SELECT endpoint, key, value, count(*) AS count FROM t GROUP BY ALL"
        ),
        "query_key_combos": _with(_COMBOS, "SELECT endpoint, combo, count FROM c WHERE kind = 'key'"),
        "query_value_combos": _with(_COMBOS, "SELECT endpoint, combo, count FROM c WHERE kind = 'value'"),
        "param_cardinality": _with(_PAGE_VALUES + _STAT, "SELECT endpoint, type, parameter, cardinality FROM s"),
        "param_gini": _with(
            _PAGE_VALUES + _STAT, "SELECT endpoint, type, parameter, round(gini, 6) AS gini FROM s"
        ),
        "param_stat": _with(_PAGE_VALUES + _STAT, _STAT_ROWS),
        "param_stat_query_only": _with(_PAGE_VALUES + _STAT, _STAT_ROWS + " WHERE type = 'query'"),
        "param_stat_display": _with(
            _PAGE_VALUES + _STAT,
            """SELECT endpoint, type, parameter, format('{:,}', count) AS count,
                      printf('%.2f', 100.0::DOUBLE * count / requests) AS percent,
                      format('{:,}', cardinality) AS cardinality, printf('%.3f', gini) AS gini
               FROM s JOIN n USING (endpoint)""",
        ),
        "param_stat_events": _with(_EVENT_VALUES + _STAT, _STAT_ROWS),
        "param_stat_days": _with(_EVENT_VALUES + _STAT, _STAT_ROWS),
        "param_stat_some_days": _with(
            _EVENT_VALUES.replace("FROM events)", "FROM events),\ne0 AS (SELECT * FROM e WHERE \"time\" >= TIMESTAMP '2024-01-08' AND \"time\" < TIMESTAMP '2024-01-15')", 1)
            .replace("FROM e)", "FROM e0)").replace("FROM e GROUP", "FROM e0 GROUP") + _STAT,
            _STAT_ROWS,
        ),
        "param_cardinality_days": _with(_EVENT_VALUES + _STAT, "SELECT endpoint, type, parameter, cardinality, count FROM s"),
        "param_top_values": _with(_PAGE_VALUES, _TOP.format(num=3)),
        "param_top_values_events": _with(_EVENT_VALUES, _TOP.format(num=5)),
        "param_heavy_values": _with(_EVENT_VALUES, _TOP.format(num=5)).replace(
            ",\n       greatest(cardinality - 5, 0) AS more", ""
        ),
        "query_combo_top": _with(
            _COMBOS,
            """, best AS (
                 SELECT *, row_number() OVER u AS rank, sum(count) OVER (u ROWS UNBOUNDED PRECEDING) AS running,
                        sum(count) OVER (PARTITION BY endpoint, kind) AS total,
                        count(*) OVER (PARTITION BY endpoint, kind) AS cardinality
                 FROM c WINDOW u AS (PARTITION BY endpoint, kind ORDER BY count DESC, combo))
               SELECT endpoint, kind, CAST(rank AS INTEGER) AS rank, combo, count, CAST(running AS BIGINT) AS cum_count,
                      round(running::DOUBLE / total::DOUBLE, 6) AS cum_rate, greatest(cardinality - 3, 0) AS more, shown
               FROM best JOIN k USING (endpoint) WHERE rank <= 3""",
        ),
        "query_combo_stat": _with(
            _COMBOS,
            """, i AS (
                 SELECT *, row_number() OVER (PARTITION BY endpoint, kind, is_none ORDER BY count) AS i FROM c),
               s AS (
                 SELECT endpoint, kind, CAST(sum(count) AS BIGINT) AS count, count(*) AS cardinality,
                        count(*) FILTER (WHERE NOT is_none)::DOUBLE AS m,
                        sum(count) FILTER (WHERE NOT is_none)::DOUBLE AS hits,
                        sum(i::DOUBLE * count) FILTER (WHERE NOT is_none) AS weighted
                 FROM i GROUP BY ALL)
               SELECT endpoint, kind, count, cardinality,
                      round(2.0::DOUBLE * weighted / (m * hits) - (m + 1) / m, 6) AS gini, shown
               FROM s JOIN k USING (endpoint)""",
        ),
        "endpoint_counts": _with(_E, "SELECT endpoint, count(*) AS count FROM e GROUP BY endpoint"),
        "trend_long": _with(_TREND.format(interval=DAY), "SELECT endpoint, step, count FROM l"),
        "trend_signal": _with(
            _TREND.format(interval=3600),
            """, z AS (SELECT *, lag(count) OVER (PARTITION BY endpoint ORDER BY step) AS prev FROM d)
               SELECT endpoint, step, count,
                      CASE WHEN step > 0 AND count * 2 > prev * 3 THEN 'up' WHEN count = 0 THEN 'zero'
                           WHEN step > 0 AND count * 3 < prev * 2 THEN 'down' ELSE '' END AS signal FROM z""",
        ),
        "trend_vector": _with(
            _TREND.format(interval=DAY),
            """SELECT endpoint, CAST(sum(count) AS BIGINT) AS sum,
                      string_agg(CAST(count AS VARCHAR), ',' ORDER BY step) AS counts FROM d GROUP BY endpoint""",
        ),
        "trend_sorted": _with(
            _TREND.format(interval=DAY),
            """SELECT method, uri, CAST(sum(count) AS BIGINT) AS sum, arg_min(count, step) AS count0,
                      max(count) FILTER (WHERE step = 1) AS count1, arg_max(count, step) AS countn
               FROM d GROUP BY method, uri ORDER BY method, sum DESC, countn, uri""",
        ),
        "trend_wide": _with(
            _TREND.format(interval=10 * DAY),
            """SELECT method, uri, count(*) FILTER (WHERE step = 0) AS "0", count(*) FILTER (WHERE step = 1) AS "864000",
                      count(*) FILTER (WHERE step = 2) AS "1728000" FROM b GROUP BY method, uri""",
        ),
        "report_files": _with(
            _TREND.format(interval=10 * DAY),
            """SELECT method, uri, count(*) FILTER (WHERE step = 0) AS "0", count(*) FILTER (WHERE step = 1) AS "864000",
                      count(*) FILTER (WHERE step = 2) AS "1728000", unnest(['csv', 'tsv']) AS format
               FROM b GROUP BY method, uri""",
        ),
        "transition_edges": _with(_EDGES, "SELECT source, target, count FROM edges"),
        "transition_matrix": _with(
            _EDGES,
            "SELECT source, "
            + ", ".join(
                f"CAST(coalesce(sum(count) FILTER (WHERE target = '{target}'), 0) AS BIGINT) AS \"{name}\""
                for target, name in [
                    ("", "(end)"),
                    ("GET /click", "GET /click"),
                    ("GET /error", "GET /error"),
                    ("GET /view", "GET /view"),
                    ("POST /purchase", "POST /purchase"),
                    ("POST /signup", "POST /signup"),
                ]
            )
            + " FROM edges GROUP BY source",
        ),
        "transition_nodes": _with(
            _EDGES,
            f""", c AS (SELECT endpoint, count(*) AS count FROM e GROUP BY endpoint)
               SELECT endpoint, count,
                      round(floor(CAST(100.0::DOUBLE * count / total AS DECIMAL(20, 6)) * 100)::DOUBLE / 100, 6) AS percent,
                      round({_LOG.format(num="count", src="total", target=16)} + 8, 6) AS font_size,
                      round({_INTENSITY.format(**level)}, 6) AS intensity
               FROM c, total""",
        ),
        "transition_graph_edges": _with(
            _EDGES,
            f"""SELECT CASE WHEN source = '' THEN 'start' ELSE source END AS source,
                      CASE WHEN target = '' THEN 'end' ELSE target END AS target, count,
                      round({_LOG.format(num="count", src="total", target=1000)} + 1, 6) AS weight,
                      round({_LOG.format(num="count", src="total", target=7)} + 1, 6) AS pen_width,
                      round({_INTENSITY.format(**level)}, 6) AS intensity,
                      CASE WHEN source = target THEN 'back' ELSE 'forward' END AS dir
               FROM edges, total""",
        ),
        "log_norm": f"""
            SELECT event_id, round({_LOG.format(num="k", src="1000000", target=6)}, 6) AS scaled
            FROM (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
        "scenario_user_window": _with(*_split(_WINDOW.format(share=0.95))),
        "scenario_user_window_early": _with(*_split(_WINDOW.format(share=0.005))),
        "scenario_orphans": _with(
            _E,
            """SELECT uid, count(*) AS count FROM e WHERE uri NOT IN ('/view', '/click')
               GROUP BY uid HAVING NOT bool_or(set_new_uid)""",
        ),
        "scenario_sequences": _with(
            _E,
            """SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY "time", ord) - 1 AS position, endpoint FROM e""",
        ),
        "scenario_patterns": _with(
            _TALKS,
            "SELECT CAST(conv_id AS VARCHAR) AS conv_id, array_to_string(parts, ' -> ') AS pattern FROM shapes",
        ),
        "scenario_patterns_events": patterns,
        "scenarios_events": merged.replace("SHARE", "0.005"),
        "scenarios_all_events": merged.replace("SHARE", "0.95"),
        "scenarios": _with(_TALKS, "SELECT first_req_ms, last_req_ms, count, pattern FROM sc"),
        "scenario_nodes": _with(
            _TALKS,
            f"""SELECT pattern AS scenario, CAST(generate_subscripts(leaves, 1) - 1 AS INTEGER) AS position,
                      unnest(leaves) AS label, round({_INTENSITY.format(**level)}, 6) AS intensity
               FROM sc, sc_total
               UNION ALL
               SELECT pattern, NULL, unnest(['start', 'end']), NULL FROM sc""",
        ),
        "scenario_edges": _with(
            _TALKS,
            f""", z AS (
                 SELECT pattern AS scenario, len(leaves) AS size, CASE WHEN sys THEN 1 ELSE 0 END AS lo, looped,
                        round(count * 10 / total::DOUBLE + 1, 6) AS pen_width,
                        round({_INTENSITY.format(**level)}, 6) AS intensity FROM sc, sc_total),
               f AS (SELECT *, unnest(range(0, size - 1)) AS i FROM z)
               SELECT scenario, CAST(i AS VARCHAR) AS source, CAST(i + 1 AS VARCHAR) AS target,
                      1000.0::DOUBLE AS weight, true AS in_reference, pen_width, intensity FROM f
               UNION ALL
               SELECT scenario, CAST(lo + 1 AS VARCHAR), CAST(lo AS VARCHAR), 1.0::DOUBLE,
                      lo > 0 OR lo + 1 = size - 1, pen_width, intensity FROM z WHERE looped
               UNION ALL
               SELECT scenario, 'start', '0', 1000.0::DOUBLE, true, pen_width, intensity FROM z
               UNION ALL
               SELECT scenario, CAST(size - 1 AS VARCHAR), 'end', 1000.0::DOUBLE, true, pen_width, intensity FROM z""",
        ),
        "stream_trend": _with(
            _E,
            """, d AS (SELECT endpoint, us // 86400000000 * 86400 AS window_s, count(*) AS count FROM e GROUP BY ALL)
               SELECT endpoint, window_s, count FROM d
               WHERE (window_s + 86400) * 1000 <= (SELECT max(us) // 1000 FROM e) - 3600000""",
        ),
        "stream_trend_signal": _with(
            _TREND.format(interval=6 * 3600),
            """, z AS (SELECT *, lag(count) OVER (PARTITION BY endpoint ORDER BY step) AS prev FROM d)
               SELECT endpoint, step, count,
                      CASE WHEN step > 0 AND count * 2 > prev * 3 THEN 'up' WHEN count = 0 THEN 'zero'
                           WHEN step > 0 AND count * 3 < prev * 2 THEN 'down' ELSE '' END AS signal
               FROM z
               WHERE (SELECT min(us) FROM e) + (step + 1) * 21600000000 <= ((SELECT max(us) // 1000 FROM e) - 3600000) * 1000""",
        ),
        "stream_transitions": _with(_EDGES, "SELECT source, target, count FROM edges WHERE target <> ''"),
        "stream_endpoint_counts": _with(_E, "SELECT endpoint, count(*) AS count FROM e GROUP BY endpoint"),
        "stream_param_counts": _with(
            _E + _EVENT_TOKENS, "SELECT endpoint, key, value, count(*) AS count FROM t GROUP BY ALL"
        ),
        "stream_combo_counts": _with(_E, "SELECT endpoint, 'k' AS combo, count(*) AS count FROM e GROUP BY endpoint"),
        "stream_scenarios": patterns,
        "stream_transition_exits": _with(
            _E,
            f""", w AS (
                 SELECT uid, endpoint, us, lag(us) OVER u AS us0, lag(endpoint) OVER u AS before, lead(us) OVER u IS NULL AS last
                 FROM e WINDOW u AS (PARTITION BY uid ORDER BY us, ord)),
               x AS (
                 SELECT CASE WHEN us - us0 > {IDLE_MS * 1000} THEN '' ELSE coalesce(before, '') END AS source, endpoint AS target FROM w
                 UNION ALL SELECT before, '' FROM w WHERE us - us0 > {IDLE_MS * 1000}
                 UNION ALL SELECT endpoint, '' FROM w
                 WHERE last AND us // 1000 + {IDLE_MS} < (SELECT max(us) // 1000 FROM e))
               SELECT source, target, count(*) AS count FROM x GROUP BY ALL""",
        ),
        **(llm_queries.oracle_sql() if llm_queries else {}),
    }


def _split(text: str) -> tuple[str, str]:
    """A statement of CTEs and a final SELECT, cut before the SELECT."""
    at = text.rindex("\nSELECT")
    return text[:at], text[at:]
