"""Flags of a streamed trend against the batch ones, for the buckets that are closed."""

import os

import pytest
from helpers import log_line, rows

from hitpath.operators import trend
from hitpath.sources.ltsv import read_ltsv, stream_ltsv
from hitpath.streaming import transitions
from hitpath.streaming import trend as stream_trend


@pytest.fixture(autouse=True)
def rocksdb(spark):
    transitions.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_empty_buckets_come_out_by_timers(spark, tmp_path):
    """An endpoint that falls silent, one that begins late, one with gaps, over four micro-batches."""
    (tmp_path / "in").mkdir()
    parts = [
        [(3, "a"), (4, "a"), (14, "a"), (14, "b")],
        [(25, "b"), (61, "b"), (62, "b"), (63, "c")],
        [(95, "b"), (99, "c"), (99, "c"), (99, "c")],
        [(131, "c"), (140, "c")],
    ]
    for i, part in enumerate(parts):
        file = tmp_path / "in" / f"{i}.log"
        file.write_text("\n".join(log_line(s, f"GET /{leaf} HTTP/1.1", "u", True) for s, leaf in part) + "\n")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    batch = read_ltsv(spark, str(tmp_path / "in"))
    first = batch.selectExpr("min(unix_micros(time))").first()[0]
    stream = stream_ltsv(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    found = stream_trend.signals(stream, 10, first, "5 seconds")
    out = stream_trend.run_append(found, str(tmp_path / "out"), str(tmp_path / "ck"))
    columns = ["endpoint", "step", "count", "signal"]
    # The latest request is 137 seconds after the first, the watermark 132: thirteen buckets are closed.
    want = trend.trend_signals(batch, 10).where("step < 13")
    assert sorted(rows(out, *columns)) == sorted(rows(want, *columns))
    assert {signal for *_, signal in rows(out, *columns)} == {"", "up", "zero", "down"}
    with pytest.raises(ValueError, match="positive"):
        stream_trend.signals(stream, 0, first, "5 seconds")


def test_requests_before_the_origin_are_left_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.log").write_text("\n".join(log_line(s, "GET /a HTTP/1.1", "u", True) for s in (0, 9, 10, 11, 50)) + "\n")
    first = read_ltsv(spark, str(tmp_path / "in")).selectExpr("min(unix_micros(time))").first()[0] + 9_500_000
    found = stream_trend.signals(stream_ltsv(spark, str(tmp_path / "in")), 10, first, "0 seconds")
    out = stream_trend.run_append(found, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(rows(out, "step", "count", "signal")) == [(0, 2, ""), (1, 0, "zero"), (2, 0, "zero"), (3, 0, "zero")]
