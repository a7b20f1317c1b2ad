"""hitpath: access-log analytics expressed as Spark DataFrame operations.

Every operator takes an *entries* DataFrame (one row per request) and returns
a DataFrame; nothing is executed until the caller writes or shows a result.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from hitpath.sources.ltsv import parse_lines, read_ltsv
from hitpath.sources.store import read_entries, write_entries, write_report
from hitpath.operators.filters import filter_entries
from hitpath.operators.routeindex import RouteIndex, apply_route_index, write_route_index
from hitpath.operators.routes import Routes, apply_routes
from hitpath.plans.reports import (
    param_detail_report,
    param_stat_report,
    scenario_report,
    transition_matrix_report,
    trend_report,
)

__all__ = [
    "RouteIndex",
    "Routes",
    "apply_route_index",
    "apply_routes",
    "filter_entries",
    "param_detail_report",
    "param_stat_report",
    "parse_lines",
    "read_entries",
    "read_ltsv",
    "scenario_report",
    "transition_matrix_report",
    "trend_report",
    "write_entries",
    "write_report",
    "write_route_index",
]

# Functions that run inside tasks are sent to the executors by value, so the
# package has to be importable on the driver only.
register_pickle_by_value(sys.modules[__name__])
