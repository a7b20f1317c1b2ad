import random
from collections import defaultdict

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_fold import GOLDENS, plain_fold
from test_transition import FIVE, THREE, _random_log

from hitpath.functions.fold import nests, pattern_text
from hitpath.operators import graph, scenario
from hitpath.plans.reports import scenario_report


def _shift(log, by=1):
    return [(second + by, *rest) for second, *rest in log]


def test_five_rows(entries):
    assert rows(scenario_report(entries(FIVE))) == [(0, 0, 1, "POST /initialize"), (5000, 6000, 1, "(GET /)*")]


def test_three_rows(entries):
    log = [(1, *THREE[0][1:]), (2, *THREE[1][1:]), (3, *THREE[2][1:])]
    assert rows(scenario_report(entries(log), share=1.0)) == [
        (0, 0, 1, "POST /initialize"),
        (1000, 2000, 1, "(GET /)*"),
    ]
    # The default share of the period leaves 1900 ms, so both users are in time.
    assert len(rows(scenario_report(entries(log)))) == 2


def _steps(uid, sequence, start=0):
    return [(start + i, f"GET /{leaf} HTTP/1.1", uid, i == 0) for i, leaf in enumerate(sequence)]


def _text(pattern):
    return "".join("GET /" + c if c.isalpha() else c for c in pattern)


def test_goldens_through_spark(entries):
    log = [step for i, (seq, _) in enumerate(GOLDENS) for step in _steps(f"u{i}", seq.split())]
    got = dict(rows(scenario.user_patterns(entries(log)), "uid", "pattern"))
    assert got == {f"u{i}": _text(pattern) for i, (seq, pattern) in enumerate(GOLDENS) if seq}


def test_new_id_restarts_and_orphans_are_left_out(entries):
    log = [
        (0, "GET /early HTTP/1.1", "a"),
        (1, "GET /x HTTP/1.1", "a", True),
        (2, "GET /y HTTP/1.1", "a"),
        (3, "GET /z HTTP/1.1", "a", True),
        (4, "GET /z HTTP/1.1", "orphan"),
        (60, "GET /w HTTP/1.1", "a"),
    ]
    df = entries(log)
    assert rows(scenario_report(df)) == [(3000, 60000, 1, "GET /z -> GET /w")]
    assert rows(scenario.user_window(df)) == [("a", 3000, 60000)]
    assert rows(scenario.orphan_users(df)) == [("orphan", 1)]
    assert rows(scenario.sequences(df).orderBy("position")) == [("a", 0, "GET /z"), ("a", 1, "GET /w")]


def test_late_users_are_cut_exactly(entries):
    at = lambda second, uid: (second, "GET / HTTP/1.1", uid, True)
    df = entries([at(0, "a"), at(95, "b"), at(96, "c"), at(100, "d")])
    assert sorted(rows(scenario.user_window(df), "uid")) == [("a",), ("b",)]
    assert sorted(rows(scenario.user_window(df, share=0.5), "uid")) == [("a",)]


def test_order_of_the_report(entries):
    log = _steps("a", "BC") + _steps("b", "AC") + _steps("c", "AC") + _steps("d", "X", 1) + [(99, "GET /A HTTP/1.1", "e", True)]
    assert rows(scenario_report(entries(log)), "pattern") == [
        ("GET /A -> GET /C",), ("GET /B -> GET /C",), ("GET /X",),
    ]


def test_compatible_patterns_merge(entries):
    log = _steps("a", "ABBC") + _steps("b", "AABC") + _steps("c", "ABCABC") + _steps("d", "ABC") + _steps("e", "ABD")
    merged = {r.pattern: (r["count"], r.first_req_ms, r.last_req_ms) for r in scenario_report(entries(log)).collect()}
    assert merged == {_text("((A)* -> (B)* -> C)*"): (4, 0, 5000), _text("A -> B -> D"): (1, 0, 2000)}


def test_crossing_patterns_stay_apart(entries):
    # (A -> B)* -> C and A -> (B -> C)* have the same leaves but cannot be one tree.
    log = _steps("a", "ABABC") + _steps("b", "ABCBC") + _steps("c", "ABC") + _steps("d", "ABBC")
    got = {r.pattern: r["count"] for r in scenario_report(entries(log)).collect()}
    # By falling pattern text: C, then D and B join it, then A does not fit.
    assert got == {_text("A -> ((B)* -> C)*"): 3, _text("(A -> B)* -> C"): 1}


def _plain_scenarios(log):
    first, last, sequences = {}, {}, defaultdict(list)
    for second, req, uid, new in log:
        if new:
            sequences[uid], first[uid] = [], second * 1000
        sequences[uid].append("GET " + req.split(" ")[1])
        last[uid] = second * 1000
    origin, end = log[0][0] * 1000, log[-1][0] * 1000
    patterns = {}
    for uid, sequence in sequences.items():
        if first[uid] - origin > int((end - origin) * 0.95):
            continue
        leaves, loops = plain_fold(sequence)
        text = pattern_text(leaves, loops)
        old = patterns.get(text, (leaves, loops, 0, 10**9, 0))
        patterns[text] = (leaves, loops, old[2] + 1, min(old[3], first[uid] - origin), max(old[4], last[uid] - origin))
    kept = []
    for text in sorted(patterns, reverse=True):
        leaves, loops, count, lo, hi = patterns[text]
        for k in kept:
            if k[0] == leaves and nests(set(loops) | k[1]):
                k[1] |= set(loops)
                k[2:] = [k[2] + count, min(k[3], lo), max(k[4], hi)]
                break
        else:
            kept.append([leaves, set(loops), count, lo, hi])
    return sorted((lo, hi, count, pattern_text(leaves, loops)) for leaves, loops, count, lo, hi in kept)


def test_against_a_plain_program(entries):
    rnd = random.Random(5)
    log = _random_log(21, users=40, n=260, hot=0.3, seconds=50)
    extra = [s for i in range(30) for s in _steps(f"s{i}", rnd.choice(["AB", "ABAB", "AAB", "ABB", "ABC", "ABCBC", "ABABC"]), rnd.randrange(30))]
    log = sorted(log + extra, key=lambda row: row[0])
    got = scenario.scenarios(entries(log))
    assert sorted(rows(got, "first_req_ms", "last_req_ms", "count", "pattern")) == _plain_scenarios(log)


def test_long_runs_of_a_hot_user_are_thinned(entries):
    log = [(i // 50, "GET /ping HTTP/1.1", "bot", i == 0) for i in range(400)] + [(9, "GET /done HTTP/1.1", "bot", False)]
    df = scenario._visits(entries(log))
    thin = scenario.without_long_runs(df, "endpoint", "set_new_uid")
    assert thin.count() == 4
    assert rows(scenario.user_patterns(entries(log)), "pattern") == [("(GET /ping)* -> GET /done",)]


def _restarting_log(n=600):
    rnd = random.Random(9)
    log = []
    for i in range(n):
        uid = rnd.choice(["hot", "hot", "hot", "a", "b", "c", "orphan"])
        new = uid != "orphan" and (i < 10 or rnd.random() < 0.004)
        log.append((i // 9, f"GET /{rnd.choice('ABBBC')} HTTP/1.1", uid, new))
    return log


@pytest.mark.parametrize("chunk_rows, slice_s", [(1, 60), (7, 5), (50, 1), (10_000, 60)])
def test_chunks_change_no_pattern(entries, chunk_rows, slice_s):
    log = _restarting_log()
    sequences, first = defaultdict(list), {}
    for second, req, uid, new in log:
        if new:
            sequences[uid], first[uid] = [], second
        if uid in first:
            sequences[uid].append("GET " + req.split(" ")[1])
    got = scenario.user_patterns(entries(log[: 60 if chunk_rows == 1 else None]), chunk_rows, slice_s)
    if chunk_rows == 1:
        want = scenario.user_patterns(entries(log[:60]))
        assert sorted(rows(got, "uid", "pattern", "first_us", "last_us")) == sorted(rows(want, "uid", "pattern", "first_us", "last_us"))
    else:
        want = {uid: pattern_text(*plain_fold(sequence)) for uid, sequence in sequences.items() if uid in first}
        assert dict(rows(got, "uid", "pattern")) == want
    with pytest.raises(ValueError, match="chunk"):
        scenario.user_patterns(entries(log), 0)


def test_a_hot_user_is_folded_chunk_by_chunk(entries):
    """With a third of the log, no fold gets more of one user than a chunk, and rows are shuffled by slice before."""
    log = [(i, f"GET /{(i * i) % 7}{i % 5} HTTP/1.1", "hot" if i % 3 == 0 else f"u{i % 50}", i < 60) for i in range(1800)]
    seen = []
    inner = scenario._folded

    def spy(frame):
        most = frame.where("endpoint IS NOT NULL").groupBy("uid").count().agg({"count": "max"}).first()[0]
        seen.append(most or 0)
        return inner(frame)

    scenario._folded = spy
    try:
        got = scenario.user_patterns(entries(log), chunk_rows=100)
    finally:
        scenario._folded = inner
    assert max(seen) <= 100 and len(seen) == 6
    assert sorted(rows(got, "uid", "pattern")) == sorted(rows(scenario.user_patterns(entries(log)), "uid", "pattern"))
    plan = scenario._ordered_visits(entries(log), 60)._jdf.queryExecution().executedPlan().toString()
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "hashpartitioning(uid#" in line and "slice#" not in line.split("hashpartitioning")[1]:
            assert "_rows" in below, below


def test_graph_tables(entries):
    found = scenario.scenarios(entries(_steps("a", "ABBCABC") + _steps("b", "XX") + _steps("c", "XX")), share=1.0)
    edges = graph.scenario_edges(found)
    assert sorted(rows(edges.where(f"scenario = '{_text('(X)*')}'"), "source", "target", "weight", "in_reference")) == [
        ("0", "0", 1.0, True), ("0", "end", 1000.0, True), ("start", "0", 1000.0, True),
    ]
    other = edges.where("scenario LIKE '%B%'")
    assert sorted(rows(other, "source", "target", "in_reference")) == [
        ("0", "1", True), ("1", "1", True), ("1", "2", True), ("2", "0", True), ("2", "end", True), ("start", "0", True),
    ]
    assert {round(p, 6) for (p,) in rows(other, "pen_width")} == {round(10 / 3 + 1, 6)}
    nodes = graph.scenario_nodes(found)
    assert sorted(rows(nodes.where("scenario LIKE '%B%' AND position IS NOT NULL"), "position", "label")) == [
        (0, "GET /A"), (1, "GET /B"), (2, "GET /C"),
    ]
    assert nodes.where("position IS NULL").count() == 4


def test_loop_at_the_start_is_flagged(entries):
    edges = graph.scenario_edges(scenario.scenarios(entries(_steps("a", "ABABC")), share=1.0))
    assert rows(edges.where("weight = 1.0"), "source", "target", "in_reference") == [("1", "0", False)]


def _merged_plainly(patterns):
    """Each pattern, by descending text, joins the first class whose loops it nests with."""
    kept = []
    for text, leaves, loops, count, first, last in sorted(patterns, reverse=True):
        for k in kept:
            if k[0] == leaves and nests(set(loops) | k[1]):
                k[1] |= set(loops)
                k[2:] = [k[2] + count, min(k[3], first), max(k[4], last)]
                break
        else:
            kept.append([leaves, set(loops), count, first, last])
    return sorted((first, last, count, pattern_text(leaves, sorted(loops))) for leaves, loops, count, first, last in kept)


_COUNTED = "pattern string, leaves array<string>, loops array<struct<lo:int,hi:int>>, count bigint, first_req_ms bigint, last_req_ms bigint"


def test_crossing_and_nesting_groups(spark):
    rnd = random.Random(4)
    found = {}
    for _ in range(1500):
        leaves = tuple(rnd.choice(["ABCDE", "ABCDF", "AB", "ABCDEFGH", "C"]))
        loops = set()
        for _ in range(rnd.randrange(4)):
            lo = rnd.randrange(len(leaves))
            new = loops | {(lo, rnd.randrange(lo, len(leaves)))}
            # The groups of EFGH nest as a whole, as their loops come from one family.
            if nests(new) and (len(leaves) != 8 or nests(new | {(0, 3), (4, 7), (1, 2)}) and new <= {(0, 3), (4, 7), (1, 2), (5, 5)}):
                loops = new
        text = pattern_text(leaves, sorted(loops))
        found[text] = (text, list(leaves), sorted(loops), rnd.randrange(1, 9), rnd.randrange(99), rnd.randrange(100, 199))
    got = scenario.merge_patterns(spark.createDataFrame(list(found.values()), _COUNTED))
    assert sorted(rows(got, "first_req_ms", "last_req_ms", "count", "pattern")) == _merged_plainly(found.values())
    for leaves, loops, text in rows(got, "leaves", "loops", "pattern"):
        assert pattern_text(leaves, [tuple(loop) for loop in loops]) == text


def test_a_crowded_group_is_summed_up(spark):
    """A hundred thousand patterns of the same leaves, which all nest, are never in one task."""
    n = 100_000
    bits = [F.when(F.col("id").bitwiseAND(1 << i) != 0, F.struct(F.lit(i).alias("lo"), F.lit(i).alias("hi"))) for i in range(17)]
    leaves = F.array(*(F.lit(f"L{i}") for i in range(17)))
    made = spark.range(n).select(
        F.col("id").cast("string").alias("pattern"), leaves.alias("leaves"), F.array_compact(F.array(*bits)).alias("loops"),
        F.lit(2).cast("bigint").alias("count"), F.col("id").alias("first_req_ms"), (F.col("id") + 5).alias("last_req_ms"),
    )
    got = scenario.merge_patterns(made)
    want = " -> ".join(f"(L{i})*" for i in range(17))
    assert rows(got, "first_req_ms", "last_req_ms", "count", "pattern") == [(0, n + 4, 2 * n, want)]


def test_a_crowded_crossing_group():
    """Bits, not pairs of intervals, tell whether patterns nest: tens of thousands in seconds."""
    import pyarrow as pa

    rnd = random.Random(2)
    family = [[(i, i + 5)] for i in range(30)] + [[(i, i + 2), (i + 10, i + 11)] for i in range(20)]
    rows_ = []
    for i in range(30_000):
        loops = rnd.choice(family)
        rows_.append({
            "pattern": f"{i:06d}", "leaves": ["x"] * 40, "loops": [{"lo": lo, "hi": hi} for lo, hi in loops],
            "count": 1, "first_req_ms": i, "last_req_ms": i,
        })
    batches = [pa.RecordBatch.from_pylist(rows_[i : i + 5000]) for i in range(0, len(rows_), 5000)]
    out = [r for b in scenario._merge_compatible(iter(batches)) for r in b.to_pylist()]
    assert sum(r["count"] for r in out) == 30_000 and len(out) < 50
    assert all(nests({(x["lo"], x["hi"]) for x in r["loops"]}) for r in out)
