"""Parameter statistics kept by day: united days against the one-shot statistics."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators import params, paramstate
from hitpath.operators.routes import Routes, apply_routes

ROUTES = ["^/p/(?P<id>[0-9]+)/([a-z])"]


@pytest.fixture(scope="module")
def log(entries):
    rnd = random.Random(6)
    made = [
        (i * 600, f"GET /p/{rnd.randrange(40)}/{rnd.choice('abc')}?k={rnd.randrange(30)}&j=1 HTTP/1.1" if i % 3 else "GET /q HTTP/1.1", f"u{i % 5}", i < 5)
        for i in range(100)
    ]
    table = apply_routes(entries(made), Routes(ROUTES))
    for i in range(1, 4):
        shifted = table.where(f"hash(req) % {i + 1} <> 0").withColumn("time", F.col("time") + F.expr(f"make_interval(0, 0, 0, {2 * i})"))
        table = table.unionByName(shifted)
    return table


def stat(table):
    return sorted(rows(table.select("endpoint", "type", "parameter", "count", "percent", "cardinality", F.round("gini", 9))))


def test_united_days(spark, log, tmp_path):
    path = str(tmp_path / "state")
    days = sorted(r[0] for r in log.select(F.to_date("time")).distinct().collect())
    early = log.where(F.to_date("time") <= F.lit(days[1]))
    late = log.where(F.to_date("time") > F.lit(days[1]))
    for part in (early, late, late):  # The last is a job that is repeated.
        paramstate.write_param_state(part, path, ROUTES)
    assert stat(paramstate.param_stat_of_days(spark, path)) == stat(params.param_stat(log, ROUTES))
    assert stat(paramstate.param_stat_of_days(spark, path, until=days[1])) == stat(params.param_stat(early, ROUTES))
    middle = log.where(F.to_date("time").between(F.lit(days[1]), F.lit(days[2])))
    assert stat(paramstate.param_stat_of_days(spark, path, days[1], str(days[2]))) == stat(params.param_stat(middle, ROUTES))

    got = paramstate.param_cardinality_of_days(spark, path, since=days[1])
    want = params.param_cardinality(log.where(F.to_date("time") >= F.lit(days[1])), ROUTES)
    key = ["endpoint", "type", "position", "parameter", "cardinality"]
    assert sorted(rows(got, *key)) == sorted(rows(want, *key))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "/sketches" in plan and "/values" not in plan and "PartitionFilters: [isnotnull(date" in plan


def test_estimates_of_many_values(spark, entries, tmp_path):
    log = entries([(0, "GET /x HTTP/1.1", "u", True)]).crossJoin(spark.range(40_000)).withColumn("query", F.concat(F.lit("k="), F.col("id") % 30_000))
    for i in range(2):
        day = log.where(F.col("id") % 2 == i).withColumn("time", F.col("time") + F.expr(f"make_interval(0, 0, 0, {i})"))
        paramstate.write_param_state(day, str(tmp_path / "state"), kind="query")
    found = rows(paramstate.param_cardinality_of_days(spark, str(tmp_path / "state")), "cardinality", "count")
    assert len(found) == 1 and found[0][1] == 40_000 and abs(found[0][0] - 30_000) < 1_500
