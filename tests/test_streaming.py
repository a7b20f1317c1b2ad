import os
from collections import Counter

import pytest
from helpers import log_line, rows
from test_transition import _expected_edges, _random_log

from hitpath.sources.ltsv import parse_lines, stream_ltsv
from hitpath.streaming import counts, transitions
from hitpath.streaming.trend import run_append, windowed_counts


@pytest.fixture(autouse=True)
def rocksdb(spark):
    transitions.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture
def folder(tmp_path, spark):
    """A folder of log files, one per ten seconds of the log."""
    log = _random_log(31, n=150, seconds=50)
    source = tmp_path / "logs"
    source.mkdir()
    for i in range(5):
        part = [log_line(*row) for row in log if row[0] // 10 == i]
        file = source / f"{i}.log"
        file.write_text("\n".join(part) + "\n")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # Streams take files by age.
    return log, str(source), tmp_path


def stream(spark, path):
    return stream_ltsv(spark, path, max_files_per_trigger=1)


def test_windows_before_the_watermark(folder, spark):
    log, source, tmp = folder
    found = windowed_counts(stream(spark, source), 10, "5 seconds")
    out = run_append(found, str(tmp / "out"), str(tmp / "ck"))
    got = {(r.endpoint, r.window_start.second // 10): r["count"] for r in out.collect()}
    latest = max(second for second, *_ in log)
    want = Counter()
    for second, req, *_ in log:
        if second // 10 * 10 + 10 <= latest - 5:
            want["GET " + req.split(" ")[1], second // 10] += 1
    assert got == dict(want)
    with pytest.raises(ValueError, match="positive"):
        windowed_counts(stream(spark, source), 0, "5 seconds")


def test_steps_carry_over_batches(spark, tmp_path):
    log = _random_log(32, n=120, seconds=60)
    schema = "second int, value string, ord bigint"
    for i in range(4):
        part = [(row[0], log_line(*row), n) for n, row in enumerate(log) if row[0] // 15 == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_append(transitions.steps(parse_lines(source)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = Counter((s, t) for s, t in rows(out, "source", "target"))
    assert got == Counter({k: v for k, v in _expected_edges(log).items() if k[1]})


def test_steps_of_log_files_follow_the_lines(folder, spark):
    """Five files, ten seconds each, thirty lines in them: most lines share their second."""
    log, source, tmp = folder
    out = run_append(transitions.steps(stream(spark, source)), str(tmp / "out"), str(tmp / "ck"))
    got = Counter(rows(out, "source", "target"))
    assert got == Counter({k: v for k, v in _expected_edges(log).items() if k[1]})


def test_steps_of_one_second_in_one_file(spark, tmp_path):
    log = [(0, f"GET /{i % 7}{i % 11} HTTP/1.1", f"u{i % 3}", i < 3) for i in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.log").write_text("\n".join(log_line(*row) for row in log) + "\n")
    out = run_append(transitions.steps(stream(spark, str(tmp_path / "in"))), str(tmp_path / "o"), str(tmp_path / "c"))
    assert Counter(rows(out, "source", "target")) == Counter({k: v for k, v in _expected_edges(log).items() if k[1]})


def test_steps_leave_the_session_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="use_rocksdb"):
        transitions.steps(stream(spark, str(tmp_path / "in")))


def test_idle_users_leave(spark, tmp_path):
    schema = "value string, ord bigint"
    parts = [[(0, "a"), (5, "b")], [(100, "b")], [(200, "b")]]
    for n, part in enumerate(parts):
        lines = [(log_line(second, "GET /x HTTP/1.1", uid, True), n * 10 + second) for second, uid in part]
        spark.createDataFrame(lines, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = transitions.steps(parse_lines(source), idle_ms=30_000)
    out = run_append(found, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = Counter(rows(out))
    assert got == Counter(
        [("a", "", "GET /x"), ("a", "GET /x", "")]
        + [("b", "", "GET /x")] * 3
        + [("b", "GET /x", "")] * 2
    )


def test_patterns_go_on_over_batches(folder, spark):
    """Five micro-batches, and new user ids in the middle of them."""
    from hitpath.operators import scenario
    from hitpath.streaming import scenarios

    log, source, tmp = folder
    found = scenarios.user_patterns(stream(spark, source))
    out = counts.run_update(found, ["uid"], str(tmp / "out"), str(tmp / "ck"))
    want = scenario.user_patterns(stream_batch(spark, source))
    columns = ["uid", "first_us", "last_us", "pattern", "leaves"]
    assert out.columns == columns
    assert sorted(rows(out, *columns)) == sorted(rows(want, *columns)) and len({u for u, *_ in rows(want)}) > 1
    assert spark.read.parquet(str(tmp / "out")).select("batch").distinct().count() >= 3


def stream_batch(spark, source):
    from hitpath.sources.ltsv import read_ltsv

    return read_ltsv(spark, source)


def test_no_batches(spark, tmp_path):
    from hitpath.streaming import scenarios

    (tmp_path / "in").mkdir()
    out = counts.run_update(scenarios.user_patterns(stream(spark, str(tmp_path / "in"))), ["uid"], str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(out) == []


def test_combinations_of_a_stream(folder, spark):
    from hitpath.operators import params

    log, source, tmp = folder
    table = counts.run_complete(counts.combo_counts(stream(spark, source)), str(tmp / "a"), str(tmp / "b"))
    got = params.of_queried_endpoints(table)
    want = params.query_combos(stream_batch(spark, source))
    assert sorted(rows(got, *want.columns)) == sorted(rows(want))


def test_running_counts(folder, spark):
    log, source, tmp = folder
    out = counts.run_complete(counts.endpoint_counts(stream(spark, source)), str(tmp / "a"), str(tmp / "b"))
    assert dict(rows(out, "endpoint", "count")) == dict(Counter("GET " + req.split(" ")[1] for _, req, *_ in log))
    again = counts.run_complete(counts.query_value_counts(stream(spark, source)), str(tmp / "c"), str(tmp / "d"))
    assert rows(again) == []


def test_scratch_follows_the_session(tmp_path):
    from types import SimpleNamespace

    from hitpath.sources.scratch import scratch_dir

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)))

    assert scratch_dir(session(spark_checkpoint_dir=str(tmp_path)), "x").startswith(f"{tmp_path}/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(), "x")
