"""Long route lists: the index against testing every pattern."""

import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators import routeindex
from hitpath.operators.routeindex import (
    ANYWHERE, PLACES, RouteIndex, apply_route_index, required_segments, route_params, write_route_index,
)
from hitpath.operators.routes import Routes, apply_routes


@pytest.mark.parametrize(
    "pattern, segments",
    [
        ("^/users/([0-9]+)$", [(1, "users")]),
        ("^/users/([0-9]+)/posts$", [(1, "users"), (3, "posts")]),
        ("^/users/([0-9]+)/posts", [(1, "users")]),
        ("/users/([0-9]+)/", [(ANYWHERE, "users")]),
        ("users/([0-9]+)/x$", [(ANYWHERE, "x")]),
        ("^/a/(.*)/b/", [(1, "a"), (ANYWHERE, "b")]),
        ("^/a/([^/]+)/b/", [(1, "a"), (3, "b")]),
        ("^/a/([^x]+)/b/", [(1, "a"), (ANYWHERE, "b")]),
        (r"^/v1\.0/(?P<id>\d+)/$", [(1, "v1.0"), (3, "")]),
        ("^/a/?(b)", []),
        ("^/ab?/(c)/", []),
        ("^/a/|^/b/", []),
        ("(?i)^/a/", []),
        ("^/(a|b)/c$", [(2, "c")]),
        ("^/(a/|b)/c$", [(ANYWHERE, "c")]),
        ("^/(?:x{2,3})/c$", [(2, "c")]),
        ("^([a-z]+)/c$", [(1, "c")]),
        (r"^/\Qa\E/", []),
        ("^/a$", [(1, "a")]),
        ("^/[.-9]+/c$", [(ANYWHERE, "c")]),
        ("^/[a-z0-9.-]+/c$", [(2, "c")]),
        ("(a)", []),
    ],
)
def test_required_segments(pattern, segments):
    assert required_segments(pattern) == segments


def test_required_segments_are_required():
    """Whatever a pattern matches has the segments, at their places."""
    rng = random.Random(8)
    bits = ["/", "/", "a", "b", "ab", "[a-b]+", "([^/]+)", "(.*)", "(a|b/)", "\\d", "b?", "/?", "[.-9]+", "(?:a+)", "."]
    paths = ["/" + "/".join(rng.choice(["a", "b", "ab", "", "9", "aa"]) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    hits = 0
    for _ in range(1500):
        text = rng.choice(["^", "^/", "", "/"]) + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "$"])
        found = required_segments(text)
        for path in paths if found else ():
            if re.search(text, path):
                hits += 1
                parts = path.split("/")
                for place, segment in found:
                    assert segment in parts[1:] if place == ANYWHERE else parts[place : place + 1] == [segment], (text, path)
    assert hits > 1000


def indexed(spark, folder, patterns):
    table = spark.createDataFrame(list(enumerate(patterns)), "route_id int, pattern string")
    write_route_index(table, str(folder))
    return RouteIndex(spark, str(folder))


LISTS = [
    ["/users/([0-9]+)/posts", "/users/(?P<id>[0-9]+)", "/users/(.*)", "^/(x)$", "deep/(.*)", "^/items/$"],
    ["^/(a)/", "/b/(c)/", "(?i)^/USERS/(.*)", "^/a/([^/]+)/b$", "/(9)$"],
    [],
]


@pytest.mark.parametrize("patterns", LISTS)
def test_same_as_the_chain(spark, entries, tmp_path, patterns):
    paths = ["", "/", "/users/12", "/users/12/posts", "/v1/users/9", "/x", "/a/", "/a/q/b", "/b/c/", "/9", "/z/9", "/items/", "/items", "/USERS/a"]
    paths += ["/1/2/3/4/5/6/7/8/9/users/3", "/1/2/3/4/5/6/7/8/b/c/d", "/1/2/3/4/5/6/7/8/9", "/deep/x"]
    log = entries([(i, f"GET {p}?a=1 HTTP/1.1", "u", i == 0) for i, p in enumerate(paths)])
    got = apply_route_index(log, indexed(spark, tmp_path / "index", patterns))
    assert got.columns == log.columns
    want = apply_routes(log, Routes(patterns)) if patterns else log
    assert sorted(rows(got, "ord", "route_id", "uri")) == sorted(rows(want, "ord", "route_id", "uri"))


def test_random_lists(spark, entries, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    patterns = []
    for _ in range(120):
        parts = [rng.choice([rng.choice(words), "([0-9]+)", "(?P<x>[^/]+)"]) for _ in range(rng.randrange(1, 5))]
        patterns.append(rng.choice(["^/", "/", "^/(.*)/"]) + "/".join(parts) + rng.choice(["", "/", "$"]))
    paths = ["/" + "/".join(rng.choice([rng.choice(words), str(rng.randrange(99))]) for _ in range(rng.randrange(1, PLACES + 4))) for _ in range(400)]
    log = entries([(i, f"GET {p} HTTP/1.1", "u", i == 0) for i, p in enumerate(paths)])
    got = apply_route_index(log, indexed(spark, tmp_path / "index", patterns))
    with pytest.warns(UserWarning):
        want = apply_routes(log, Routes([*patterns, "^nothing$"]))
    assert sorted(rows(got, "ord", "route_id", "uri")) == sorted(rows(want, "ord", "route_id", "uri"))


@pytest.mark.parametrize("patterns", LISTS)
def test_long_list_looks_paths_up_once(spark, entries, tmp_path, monkeypatch, patterns):
    """As a long list does: routes of any place stored once, one join with the index whatever the number of places."""
    monkeypatch.setattr(routeindex, "MOST_BY_PLACE", 1)
    index = indexed(spark, tmp_path / "index", patterns)
    paths = ["", "/", "/users/12", "/users/12/posts", "/v1/users/9", "/a/", "/a/q/b", "/b/c/", "/z/9", "/items/", "/USERS/a", "/users/users/1"]
    paths += ["/1/2/3/4/5/6/7/8/9/users/3", "/1/2/3/4/5/6/7/8/b/c/d", "/deep/x", "/deep/x"]
    log = entries([(i, f"GET {p}?a=1 HTTP/1.1", "u", i == 0) for i, p in enumerate(paths)])
    log = log.unionByName(log.limit(1).withColumns({"ord": F.lit(99), "path": F.lit(None).cast("string"), "uri": F.lit(None).cast("string")}))
    want = apply_routes(log, Routes(patterns)) if patterns else log
    fields = ("uri", "position", "name", "value", "count")
    monkeypatch.setattr(routeindex, "MOST_BY_PLACE", 1000)
    values = rows(route_params(log, indexed(spark, tmp_path / "short", patterns)), *fields)
    # The second form is that of a stream of requests, which has no different paths to look up first.
    for index.by_place in (index.by_place, True):
        got = apply_route_index(log, index)
        assert got.columns == log.columns
        assert sorted(rows(got, "ord", "route_id", "uri"), key=str) == sorted(rows(want, "ord", "route_id", "uri"), key=str)
        assert sorted(rows(route_params(log, index), *fields)) == sorted(values)


def test_long_list_shuffles_the_log_as_often_for_any_number_of_places(spark, entries, tmp_path, monkeypatch):
    monkeypatch.setattr(routeindex, "MOST_BY_PLACE", 10)
    log = entries([(i, f"GET /a/{i}/b HTTP/1.1", "u", i == 0) for i in range(30)])
    index = indexed(spark, tmp_path / "index", [f"/a/{i}/(b)" for i in range(20)] + [f"^/a/{i}/(b)" for i in range(20, 40)])
    assert index.places == [ANYWHERE, 2]
    got = apply_route_index(log, index)
    assert sorted(r[0] for r in rows(got, "route_id")) == list(range(30))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_params_of_the_matching_route(spark, entries, tmp_path):
    index = indexed(spark, tmp_path / "index", ["^/a/(?P<id>[0-9]+)/([a-z]+)$", "/b/(x)?"])
    log = entries([(0, "GET /a/1/q HTTP/1.1", "u", True), (1, "GET /a/1/r HTTP/1.1", "u"), (2, "GET /b/ HTTP/1.1", "u"), (3, "GET /c HTTP/1.1", "u")])
    assert sorted(rows(route_params(log, index), "uri", "position", "name", "value", "count")) == [
        ("/b/(x)?", 1, "", "", 1),
        ("^/a/(?P<id>[0-9]+)/([a-z]+)$", 1, "id", "1", 2),
        ("^/a/(?P<id>[0-9]+)/([a-z]+)$", 2, "", "q", 1),
        ("^/a/(?P<id>[0-9]+)/([a-z]+)$", 2, "", "r", 1),
    ]


def test_plan_does_not_grow_with_the_list(spark, entries, tmp_path):
    log = entries([(0, "GET /r7/1 HTTP/1.1", "u", True)])
    plans = []
    for n in (10, 3000):
        got = apply_route_index(log, indexed(spark, tmp_path / str(n), [f"^/r{i}/([0-9]+)$" for i in range(n)]))
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        assert rows(got, "route_id") == [(7,)]
    assert "r77/" not in plans[1] and abs(len(plans[0]) - len(plans[1])) < 200
    assert "BroadcastHashJoin" in plans[1] and "NestedLoop" not in plans[1] and "Exchange hashpartitioning" not in plans[1]


def test_above_the_broadcast_limit_it_is_shuffled(spark, entries, tmp_path):
    index = indexed(spark, tmp_path / "index", [f"^/r{i}/([0-9]+)$" for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = apply_route_index(entries([(0, "GET /r7/1 HTTP/1.1", "u", True), (1, "GET /q HTTP/1.1", "u")]), index)
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows(got, "ord", "route_id")) == [(0, 7), (1, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_tables(spark, tmp_path):
    table = spark.createDataFrame([(1, None), (2, "^/a/(b)"), (2, "^/a/(b)")], "route_id int, pattern string")
    write_route_index(table, str(tmp_path / "index"))
    index = RouteIndex(spark, str(tmp_path / "index"))
    log = spark.createDataFrame([("/a/b",), (None,)], "path string").withColumn("route", F.lit("mine"))
    assert rows(index.match(log.drop("route")).select("path", "route.route_id")) == [("/a/b", 2), (None, None)]
    with pytest.raises(Exception, match="ungreedy"):
        write_route_index(spark.createDataFrame([(1, "(?U)a+")], "route_id int, pattern string"), str(tmp_path / "bad"))
