import pytest

from hitpath.functions.request import computed_once, with_request_parts

# Request line, then method, path and query.
CASES = [
    ("GET / HTTP/2.0", "GET", "/", ""),
    ("POST /initialize HTTP/2.0", "POST", "/initialize", ""),
    ("GET /a?b=c&d HTTP/1.1", "GET", "/a", "b=c&d"),
    ("GET /a?b=c?d=e#f?g HTTP/1.1", "GET", "/a", "b=c?d=e"),
    ("GET /a#b?c=d HTTP/1.1", "GET", "/a", ""),
    ("GET /a? HTTP/1.1", "GET", "/a", ""),
    ("GET /caf%C3%A9/a%20b+c?q=%20 HTTP/1.1", "GET", "/café/a b+c", "q=%20"),
    ("GET /100%25 HTTP/1.1", "GET", "/100%", ""),
    ("GET /bad%zz HTTP/1.1", "", "", ""),
    ("GET /bad% HTTP/1.1", "", "", ""),
    ("GET /a#bad% HTTP/1.1", "", "", ""),
    ("GET /a|b HTTP/1.1", "GET", "/a|b", ""),
    ("GET /a:b HTTP/1.1", "GET", "/a:b", ""),
    ("GET a:b HTTP/1.1", "GET", "", ""),
    ("GET 1a:b HTTP/1.1", "", "", ""),
    ("GET :b HTTP/1.1", "", "", ""),
    ("GET a/b:c HTTP/1.1", "GET", "a/b:c", ""),
    ("GET http://h.example/p/q?x=1 HTTP/1.1", "GET", "/p/q", "x=1"),
    ("GET http://h.example HTTP/1.1", "GET", "", ""),
    ("GET http://u:p@h.example:8080/p HTTP/1.1", "GET", "/p", ""),
    ("GET http://h.example:80x/p HTTP/1.1", "", "", ""),
    ("GET http://[::1]:80/p HTTP/1.1", "GET", "/p", ""),
    ("GET http:///p HTTP/1.1", "GET", "/p", ""),
    ("GET //h.example/p HTTP/1.1", "GET", "/p", ""),
    ("GET ///p HTTP/1.1", "GET", "///p", ""),
    ("CONNECT h.example:443 HTTP/1.1", "CONNECT", "", ""),
    ("OPTIONS * HTTP/1.1", "OPTIONS", "*", ""),
    ("GET ?a=b HTTP/1.1", "GET", "", "a=b"),
    ("GET  HTTP/1.1", "GET", "", ""),
    ("GET /no-protocol", "GET", "/no-protocol", ""),
    (" /x HTTP/1.1", "", "/x", ""),
    ("GET", "", "", ""),
    ("", "", "", ""),
    ("GET /a\x01b HTTP/1.1", "", "", ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = with_request_parts(spark.createDataFrame([(c[0],) for c in CASES], "req string"))
    return {r.req: (r.method, r.path, r.query) for r in df.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_request_parts(parsed, case):
    assert parsed[case[0]] == case[1:]


def test_predicates_stay_above_the_parsing(spark):
    df = computed_once(with_request_parts(spark.createDataFrame([("GET / HTTP/1.1",)], "req string")))
    plan = df.where("path = '/' AND method = 'GET'")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert df.where("path = '/'").count() == 1
