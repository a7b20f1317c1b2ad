import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators.filters import filter_entries
from hitpath.operators.routes import Route, Routes, apply_routes

LOG = [
    (0, "GET /users/12 HTTP/1.1", "a", True),
    (1, "GET /users/12/posts?x=1 HTTP/1.1", "a"),
    (2, "POST /items HTTP/1.1", "b", True),
    (3, "GET /v1/users/9 HTTP/1.1", "b", False, 500),
]


@pytest.mark.parametrize(
    "text, java, groups",
    [
        ("^/users/([0-9]+)$", r"^/users/([0-9]+)\z", [""]),
        (r"/price\$[$](x)$", r"/price\$[$](x)\z", [""]),
        ("(?m)^/a(b)$", "(?m)^/a(b)$", [""]),
        ("/(?P<user_id>[^/]+)/(x)?", "/([^/]+)/(x)?", ["user_id", ""]),
        ("/(?<id>a(b))", "/(a(b))", ["id", ""]),
        ("/(?:a|b)/(?i:c)", "/(?:a|b)/(?i:c)", []),
        (r"/\(literal\)/[()]/([[:alpha:]_]+)", r"/\(literal\)/[()]/([\p{Alpha}_]+)", [""]),
        (r"/[]()]/(a)", r"/[]()]/(a)", [""]),
        (r"\Q(x)\E(y)", r"\Q(x)\E(y)", [""]),
    ],
)
def test_pattern_groups(text, java, groups):
    route = Route(text)
    assert (route.java, route.groups) == ("(?d)" + java, groups)


def test_no_group_warns():
    with pytest.warns(UserWarning, match="captures nothing"):
        Routes(["^/$"])


def test_first_match_anywhere_wins(entries):
    routes = Routes(["/users/([0-9]+)/posts", "/users/(?P<id>[0-9]+)", "/users/(.*)"])
    df = apply_routes(entries(LOG), routes)
    assert rows(df, "route_id", "uri", "path") == [
        (1, "/users/(?P<id>[0-9]+)", "/users/12"),
        (0, "/users/([0-9]+)/posts", "/users/12/posts"),
        (None, "/items", "/items"),
        (1, "/users/(?P<id>[0-9]+)", "/v1/users/9"),
    ]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_ends_and_dots_mean_the_whole_path(entries):
    log = entries([(0, "GET /a%0A HTTP/1.1", "u", True), (1, "GET /a HTTP/1.1", "u"), (2, "GET /b%0Dc HTTP/1.1", "u")])
    assert rows(apply_routes(log, ["^/(a)$", "^/(b.c)$"]), "route_id") == [(None,), (0,), (1,)]


def test_the_ungreedy_flag_is_refused():
    for pattern in ("(?U)^/(a+)", "(?iU:^/(a+))"):
        with pytest.raises(ValueError, match="ungreedy"):
            Routes([pattern])
    assert len(Routes([r"^/\(?U(x)", "(?i)^/(u)", r"(?:U)(x)"])) == 3


def test_routes_from_table(spark):
    table = spark.createDataFrame([(2, "/b(x)"), (1, "/a(x)")], "route_id int, pattern string")
    assert [r.text for r in Routes.from_table(table).routes] == ["/a(x)", "/b(x)"]


@pytest.mark.parametrize(
    "condition, kept",
    [
        ("", [0, 1, 2, 3]),
        ("method = 'GET' AND contains(uri, 'users')", [0, 1, 3]),
        ("status >= 500 OR set_new_uid", [0, 2, 3]),
        ("time >= TIMESTAMP '2023-01-01T03:00:02Z' AND uid IN ('b')", [2, 3]),
        ("req RLIKE 'posts'", [1]),
        (lambda: F.col("status") == 500, [3]),
    ],
)
def test_filter(entries, condition, kept):
    condition = condition() if callable(condition) else condition
    assert [o for (o,) in rows(filter_entries(entries(LOG), condition), "ord")] == kept


def test_filter_sees_the_route_pattern(entries):
    df = apply_routes(entries(LOG), ["/users/([0-9]+)$"])
    assert [o for (o,) in rows(filter_entries(df, "uri = '/users/([0-9]+)$'"), "ord")] == [0, 3]


def test_filter_has_to_be_boolean(entries):
    with pytest.raises(Exception, match="(?i)boolean|FILTER"):
        filter_entries(entries(LOG), "method").collect()


@pytest.mark.parametrize(
    ("pattern", "path", "found"),
    [
        ("^/([[:^alpha:]]+)$", "/12", True),
        ("^/([[:^alpha:]]+)$", "/1a", False),
        ("^/([[:^alpha:]x]+)$", "/1x", True),
        ("^/([^[:alpha:]]+)$", "/1a", False),
        ("^/([a[b]+)$", "/a[b", True),
        ("^/([a&&b]+)$", "/a&b", True),
    ],
)
def test_classes_mean_the_same(spark, pattern, path, found):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(Routes([pattern]).routes[0].java)).first()
    assert row[0] is found


def test_long_tables_are_for_the_index(spark):
    table = lambda n: spark.createDataFrame([(n - i, f"^/r{n - i}/([0-9]+)") for i in range(n)], "route_id int, pattern string")
    assert [r.text for r in Routes.from_table(table(12)).routes] == [f"^/r{i}/([0-9]+)" for i in range(1, 13)]
    with pytest.raises(ValueError, match="write_route_index"):
        Routes.from_table(table(501))
