import random
from collections import Counter

import pytest
from helpers import rows

from hitpath.operators import graph, ordering, trend
from hitpath.operators.transition import transition_edges, transition_matrix
from hitpath.plans.reports import transition_matrix_report

FIVE = [
    (0, "POST /initialize HTTP/2.0", "A", True),
    (5, "GET / HTTP/2.0", "B", True),
    (6, "GET / HTTP/2.0", "B"),
    (7, "GET / HTTP/2.0", "C", True),
    (7, "GET / HTTP/2.0", "D", True),
]
THREE = [FIVE[0], FIVE[1], FIVE[2]]


def test_edges(entries):
    assert sorted(rows(transition_edges(entries(FIVE)))) == [
        ("", "GET /", 3),
        ("", "POST /initialize", 1),
        ("GET /", "", 3),
        ("GET /", "GET /", 1),
        ("POST /initialize", "", 1),
    ]


def test_matrix(entries):
    matrix = transition_matrix_report(entries(THREE))
    assert matrix.columns == ["source", "", "GET /", "POST /initialize"]
    assert rows(matrix) == [("", 0, 1, 1), ("GET /", 1, 1, 0), ("POST /initialize", 1, 0, 0)]
    named = transition_matrix(transition_edges(entries(THREE)), ["GET /"])
    assert named.columns == ["source", "GET /"]


def test_nodes_and_edges_of_the_graph(entries):
    log = entries(THREE)
    nodes = {r.endpoint: r for r in graph.transition_nodes(trend.endpoint_counts(log)).collect()}
    assert (nodes["GET /"].percent, nodes["POST /initialize"].percent) == (66.66, 33.33)
    assert nodes["POST /initialize"].font_size == 8.0
    edges = {(r.source, r.target): r for r in graph.transition_graph_edges(transition_edges(log)).collect()}
    assert edges["GET /", "GET /"].dir == "back" and edges["start", "GET /"].dir == "forward"
    assert edges["GET /", "end"].weight == 1.0 and edges["GET /", "end"].pen_width == 1.0


def _random_log(seed, users=6, n=300, hot=0.4, seconds=40):
    rnd = random.Random(seed)
    log, seen = [], set()
    for second in sorted(rnd.randrange(seconds) for _ in range(n)):
        uid = "hot" if rnd.random() < hot else f"u{rnd.randrange(users)}"
        log.append((second, f"GET /{rnd.choice('abc')} HTTP/1.1", uid, uid not in seen))
        seen.add(uid)
    return log


def _expected_edges(log):
    last, edges = {}, Counter()
    for _, req, uid, _new in log:
        here = "GET " + req.split(" ")[1]
        edges[last.get(uid, ""), here] += 1
        last[uid] = here
    edges.update((e, "") for e in last.values())
    return edges


@pytest.mark.parametrize("slice_s", [1, 7, 60, 10**6])
def test_slices_change_nothing(entries, slice_s):
    log = _random_log(7)
    got = {(s, t): c for s, t, c in rows(transition_edges(entries(log), slice_s))}
    assert got == dict(_expected_edges(log))


@pytest.mark.parametrize("slice_s", [1, 7, 60, 10**6])
def test_positions(entries, slice_s):
    log = _random_log(8, n=120)
    df = ordering.with_position(entries(log).select("uid", "time", "ord"), slice_s=slice_s)
    seen, want = Counter(), []
    for i, (_, _, uid, _) in enumerate(log):
        want.append((i, seen[uid]))
        seen[uid] += 1
    assert sorted(rows(df, "ord", "position")) == want


def test_partitioning_changes_nothing(entries, spark):
    log = _random_log(9, n=200)
    want = dict(_expected_edges(log))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entries(log).repartition(int(n), "ord")
            assert {(s, t): c for s, t, c in rows(transition_edges(df, 30))} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_flow_is_conserved(entries):
    edges = rows(transition_edges(entries(_random_log(10))))
    into, out = Counter(), Counter()
    for source, target, count in edges:
        out[source] += count
        into[target] += count
    assert into == out and out[""] == 7


@pytest.mark.parametrize("slice_s", [1, 7, 10**6])
def test_positions_since_the_last_marked_row(entries, slice_s):
    log = _random_log(12, n=150)
    log = [(second, req, uid, new or i % 13 == 0) for i, (second, req, uid, new) in enumerate(log)]
    df = entries(log)
    sequence = {}
    for i, (_, _, uid, new) in enumerate(log):
        if new:
            sequence[uid] = []
        if uid in sequence:
            sequence[uid].append(i)
    want = sorted((i, n) for found in sequence.values() for n, i in enumerate(found))
    got = ordering.with_position(df.select("uid", "time", "ord", "set_new_uid"), "set_new_uid", slice_s)
    assert sorted(rows(got, "ord", "position")) == want


def test_slices_need_a_length(entries):
    with pytest.raises(ValueError, match="positive"):
        transition_edges(entries(_random_log(11)), 0)
