import random
from collections import Counter, defaultdict

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators import params
from hitpath.operators.routes import Routes, apply_routes
from hitpath.plans.reports import param_detail_report, param_stat_report

ROUTES = ["^/users/(?P<user_id>[0-9]+)(/posts)?$", "^/items/([a-z]+)"]


def _log(seed=3, n=240):
    rnd = random.Random(seed)
    log = []
    for i in range(n):
        path = rnd.choice([f"/users/{rnd.randrange(5)}", f"/users/{rnd.randrange(5)}/posts", "/items/abc", "/plain", "/other"])
        tokens = rnd.sample(["a=1", "a=2", "b=x", "b", "c=", "=v", "a=1=2", "a-b=3"], rnd.choice([0, 0, 1, 2, 3]))
        query = "" if path == "/other" or not tokens else "?" + "&".join(tokens)
        log.append((i, f"{rnd.choice(['GET', 'POST'])} {path}{query} HTTP/1.1", f"u{i}", True))
    return log


def gini(counts):
    counts = sorted(counts)
    n, total = len(counts), sum(counts)
    return 2 * sum(i * x for i, x in enumerate(counts, 1)) / (n * total) - (n + 1) / n


class Plain:
    """The statistics of a log, computed request by request."""

    def __init__(self, log):
        import re

        self.requests = Counter()
        self.values = defaultdict(Counter)
        self.combos = {"key": defaultdict(Counter), "value": defaultdict(Counter)}
        for _, req, *_ in log:
            method, target, _ = req.split(" ")
            path, _, query = target.partition("?")
            uri, groups = path, []
            for text in ROUTES:
                if m := re.search(text, path):
                    names = {i: n for n, i in m.re.groupindex.items()}
                    uri, groups = text, [(i, names.get(i, ""), m[i] or "") for i in range(1, m.re.groups + 1)]
                    break
            endpoint = f"{method} {uri}"
            self.requests[endpoint] += 1
            for i, name, value in groups:
                self.values[endpoint, "path", i, ":" + name if name else f"Path param({i})"][value] += 1
            if query:
                tokens = sorted(query.split("&"))
                pairs = [t.split("=", 1) for t in tokens if "=" in t]
                for key, value in pairs:
                    self.values[endpoint, "query", 0, "?" + key][value] += 1
                self.combos["key"][endpoint]["&".join(k for k, _ in pairs)] += 1
                self.combos["value"][endpoint]["&".join(tokens)] += 1


@pytest.fixture(scope="module")
def plain():
    return Plain(_log())


@pytest.fixture(scope="module")
def routed(entries):
    return apply_routes(entries(_log()), Routes(ROUTES)).cache()


def test_values(routed, plain):
    got = params.param_values(routed, ROUTES)
    label = params.parameter_label(F.col("kind"), F.col("position"), F.col("name"))
    found = {
        (f"{r.method} {r.uri}", r.kind, r.position, r.label, r.value): r["count"]
        for r in got.withColumn("label", label).collect()
    }
    assert found == {(*k, v): n for k, vs in plain.values.items() for v, n in vs.items()}


@pytest.mark.parametrize("kind", ["all", "PATH", "query"])
def test_stat(routed, plain, kind):
    want = {
        k: (sum(v.values()), sum(v.values()) / plain.requests[k[0]], len(v), gini(v.values()))
        for k, v in plain.values.items()
        if kind.lower() in ("all", k[1])
    }
    got = {
        (r.endpoint, r.type, r.position, r.parameter): (r["count"], r.rate, r.cardinality, r.gini)
        for r in params.param_stat(routed, ROUTES, kind).collect()
    }
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values)
        if key[1] == "path":
            assert got[key][1] == 1.0


def test_stat_report_order_and_format(routed, plain):
    report = rows(param_stat_report(routed, ROUTES, display=True))
    endpoints = [r[0] for r in report]
    assert endpoints == sorted(endpoints, key=lambda e: e.split(" ")[::-1])
    order = {"path": 0, "query": 1}
    assert [order[r[1]] for r in report if r[0].startswith("GET ^/users")] == sorted(
        order[r[1]] for r in report if r[0].startswith("GET ^/users")
    )
    assert {r[4] for r in report if r[1] == "path"} == {"100.00"}
    assert all(len(r[6].split(".")[1]) == 3 for r in report)


def test_corrected_gini(routed, plain):
    for r in params.param_stat(routed, ROUTES, corrected=True).collect():
        counts = plain.values[r.endpoint, r.type, r.position, r.parameter]
        n = len(counts)
        assert r.gini == pytest.approx(gini(counts.values()) * n / (n - 1) if n > 1 else 0.0)


@pytest.mark.parametrize("num", [1, 2, 50])
def test_top_values(routed, plain, num):
    got = defaultdict(list)
    for r in params.param_top_values(routed, ROUTES, num=num).orderBy("rank").collect():
        got[r.endpoint, r.type, r.position, r.parameter].append((r.value, r["count"], r.cum_count, round(r.cum_rate, 9), r.more))
    for key, counts in plain.values.items():
        best, cum, want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:num], 0, []
        base = plain.requests[key[0]] if key[1] == "path" else sum(counts.values())
        for value, n in best:
            cum += n
            want.append((value, n, cum, round(cum / base, 9), max(len(counts) - num, 0)))
        assert got.pop(key) == want
    assert not got


@pytest.mark.parametrize("kind", ["key", "value"])
def test_combos(routed, plain, kind):
    num = 2
    found = params.query_combos(routed).where(F.col("kind") == kind)
    counts = {(f"{r.method} {r.uri}", r.is_none, r.combo): r["count"] for r in found.collect()}
    stats = {f"{r.endpoint}": r for r in params.query_combo_stat(routed).where(F.col("kind") == kind).collect()}
    top = defaultdict(list)
    for r in params.query_combo_top(routed, num).where(F.col("kind") == kind).orderBy("rank").collect():
        top[r.endpoint].append((r.combo, r["count"], r.cum_count, round(r.cum_rate, 9), r.more, r.shown))
    want = {}
    for endpoint, combos in plain.combos[kind].items():
        none = plain.requests[endpoint] - sum(combos.values())
        shown = len(plain.combos["key"][endpoint]) > 1
        all_rows = [((False, c), n) for c, n in combos.items()] + ([((True, "(none)"), none)] if none else [])
        want.update({(endpoint, *key): n for key, n in all_rows})
        s = stats.pop(endpoint)
        assert (s["count"], s.cardinality, s.shown) == (plain.requests[endpoint], len(all_rows), shown)
        assert s.gini == pytest.approx(gini(combos.values()))
        cum, rows_ = 0, []
        for (_, combo), n in sorted(all_rows, key=lambda kv: (-kv[1], kv[0][1]))[:num]:
            cum += n
            rows_.append((combo, n, cum, round(cum / plain.requests[endpoint], 9), max(len(all_rows) - num, 0), shown))
        assert top.pop(endpoint) == rows_
    assert counts == want and not stats and not top


@pytest.mark.parametrize("error", [None, 0.02])
def test_cardinality(routed, plain, error):
    found = params.param_cardinality(routed, ROUTES, error=error)
    got = {(r.endpoint, r.type, r.position, r.parameter): r.cardinality for r in found.collect()}
    assert got == {k: len(v) for k, v in plain.values.items()}


def test_tokens(entries):
    df = params.query_tokens(entries([(0, "GET /?b=2&a&a=1&B=3 HTTP/1.1", "u", True), (1, "GET / HTTP/1.1", "u")]))
    assert rows(df.orderBy("position"), "ord", "position", "key", "value") == [(0, 0, "B", "3"), (0, 2, "a", "1"), (0, 3, "b", "2")]


def test_keys(routed, plain):
    got = {(f"{m} {u}", "?" + k): n for m, u, k, n in rows(params.query_key_counts(routed), "method", "uri", "key", "count")}
    assert got == {(k[0], k[3]): sum(v.values()) for k, v in plain.values.items() if k[1] == "query"}


def test_detail_report(routed):
    values, combos = param_detail_report(routed, ROUTES, num=3)
    assert values.count() > 0 and set(rows(combos, "shown")) == {(True,)}
    assert param_detail_report(routed, ROUTES, "path")[1].count() == 0


def test_options_are_checked(routed):
    with pytest.raises(ValueError, match="unknown kind"):
        params.param_stat(routed, ROUTES, "body")
    with pytest.raises(ValueError, match="num"):
        params.param_top_values(routed, ROUTES, num=-1)


def test_gini_needs_no_large_window(spark):
    counts = spark.range(50_000).select(F.lit("k").alias("g"), (F.col("id") % 7 + 1).alias("count"))
    terms = params._gini_terms(counts, ["g"])
    assert terms.count() == 7
    got = params.distribution(counts, ["g"]).first()
    assert got.gini == pytest.approx(gini([i % 7 + 1 for i in range(50_000)])) and got.cardinality == 50_000
