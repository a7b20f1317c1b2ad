import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators import trend
from hitpath.plans.reports import trend_report

THREE = [(0, "POST /initialize HTTP/2.0", "a", True), (5, "GET / HTTP/2.0", "b", True), (6, "GET / HTTP/2.0", "b")]


def test_report(entries):
    report = trend_report(entries(THREE), 5)
    assert report.columns == ["method", "uri", "0", "5"]
    assert rows(report) == [("GET", "/", 0, 2), ("POST", "/initialize", 1, 0)]
    by_uri = trend_report(entries(THREE), 5, ["uri:desc"])
    assert rows(by_uri, "uri") == [("/initialize",), ("/",)]


def test_buckets_follow_the_first_request_even_out_of_order(entries):
    counts = trend.trend_counts(entries([THREE[2], THREE[0], THREE[1]]), 5)
    assert sorted(rows(counts, "endpoint", "step", "count")) == [("GET /", 1, 2), ("POST /initialize", 0, 1)]


@pytest.mark.parametrize("interval", [0, -5])
def test_interval_must_be_positive(entries, interval):
    for query in (trend.trend_counts, trend.trend_wide, trend.trend_vectors, trend.trend_signals):
        with pytest.raises(ValueError, match="positive"):
            query(entries(THREE), interval)


def _log(counts):
    """One endpoint with the given number of requests per 10-second bucket, one that spans all."""
    out = [(0, "POST / HTTP/1.1", "z", True)]
    for step, n in enumerate(counts):
        out += [(step * 10 + i % 10, "GET / HTTP/1.1", "a", True) for i in range(n)]
    return out + [(10 * len(counts) - 1, "POST / HTTP/1.1", "z")]


def test_vectors_and_order(entries):
    log = entries(_log([1, 2, 3, 4, 0]))
    vectors = trend.trend_vectors(log, 10)
    assert rows(trend.sort_trend(vectors), "endpoint", "sum", "counts") == [
        ("GET /", 10, [1, 2, 3, 4, 0]),
        ("POST /", 2, [1, 0, 0, 0, 1]),
    ]
    order = lambda *keys: [m for (m,) in rows(trend.sort_trend(vectors, keys), "method")]
    assert order("sum") == ["POST", "GET"]
    assert order("countN:desc") == ["POST", "GET"]
    assert order("count1:desc") == ["GET", "POST"]
    assert order("count0:desc", "method:desc") == ["POST", "GET"]
    assert order("nothing:desc", "sum:up") == ["GET", "POST"]


def test_count1_of_a_single_bucket_is_null(entries):
    vectors = trend.trend_vectors(entries(THREE), 3600)
    assert len(rows(trend.sort_trend(vectors, ["count1:desc"]))) == 2


def test_sort_keys():
    assert trend.parse_sort([" SUM:Desc", "uri", "x:asc", "uri:down", "countN:asc"]) == [
        ("sum", False), ("uri", True), ("countn", True),
    ]


def test_signals(entries):
    counts = [4, 7, 6, 5, 3, 0, 0, 1, 1, 0]
    flags = ["", "up", "", "", "down", "zero", "zero", "up", "", "zero"]
    log = entries(_log(counts))
    get = trend.trend_signals(log, 10).where("method = 'GET'").orderBy("step")
    assert rows(get, "step", "count", "signal") == list(zip(range(10), counts, flags))
    sparse = trend.trend_signals(log, 10, dense=False).where("method = 'GET'").orderBy("step")
    assert rows(sparse, "step", "signal") == [(s, f) for s, (c, f) in enumerate(zip(counts, flags)) if c]


def test_leading_gap_is_filled(entries):
    log = entries([(0, "GET /a HTTP/1.1", "a", True), (25, "GET /b HTTP/1.1", "a")])
    b = trend.trend_signals(log, 10).where("uri = '/b'").orderBy("step")
    assert rows(b, "step", "count", "signal") == [(0, 0, "zero"), (1, 0, "zero"), (2, 1, "up")]


def test_wide_refuses_too_many_buckets(entries, spark):
    with pytest.raises(ValueError, match="pivotMaxValues"):
        trend.trend_wide(entries(THREE), 1, steps=10_001)


def test_totals_agree(entries):
    log = entries(_log([3, 0, 5]))
    total = trend.endpoint_counts(log).agg(F.sum("count")).first()[0]
    assert trend.trend_counts(log, 7).agg(F.sum("count")).first()[0] == total == log.count()


def test_no_sort_key_means_falling_sum(spark):
    from hitpath.operators.trend import sort_trend

    rows = [("a", "GET", "/a", 1, [1]), ("b", "GET", "/b", 3, [3]), ("c", "GET", "/c", 2, [2])]
    vectors = spark.createDataFrame(rows, "endpoint string, method string, uri string, sum long, counts array<long>")
    assert [r.uri for r in sort_trend(vectors, []).collect()] == ["/b", "/c", "/a"]
