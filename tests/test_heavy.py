"""Top values by bounded summaries, against counts of all values."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.operators import heavy, params

COLUMNS = ["endpoint", "type", "parameter", "rank", "value", "count", "cum_count", "cum_rate"]


@pytest.fixture(scope="module")
def log(entries):
    rnd = random.Random(1)
    made = []
    for i in range(3000):
        # A few values stand out of /a?k, none of /a?j and /b?k; /c?k has two values in all.
        k = rnd.choice(["hot", "warm", "mild", str(rnd.randrange(900))]) if i % 3 else str(rnd.randrange(900))
        path = rnd.choice([f"/a?k={k}&j={i}", f"/b?k={rnd.randrange(400)}", f"/c?k={i % 2}"])
        made.append((i // 10, f"GET {path} HTTP/1.1", "u", i == 0))
    return entries(made).repartition(4, "ord")


@pytest.mark.parametrize("width, num", [(1, 3), (5, 1), (40, 3), (300, 1), (300, 7), (100_000, 3)])
def test_same_as_the_full_count(spark, log, width, num):
    got = heavy.param_heavy_values(log, num=num, width=width)
    assert sorted(rows(got, *COLUMNS)) == sorted(rows(params.param_top_values(log, num=num), *COLUMNS))


def test_only_candidates_are_shuffled_where_values_stand_out(spark, entries):
    """A hundred thousand values that occur once, and five that do not: the recount shuffles a few rows a task."""
    base = entries([(0, "GET /x HTTP/1.1", "u", True)])
    value = F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id"))
    log = spark.range(0, 100_000, 1, 4).join(F.broadcast(base), F.col("id") >= 0).withColumn("query", F.concat(F.lit("k="), value.cast("string")))
    got = heavy.param_heavy_values(log, num=5, width=1000)
    assert rows(got.orderBy("rank"), "value", "count") == [(str(v), 10_000) for v in (0, 2, 4, 6, 8)]
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    from pathlib import Path

    latest = max(Path(scratch).glob("heavy-*"), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(f"{latest}/summaries").count() <= 4 * 1001
    assert spark.read.parquet(f"{latest}/candidates").count() < 10
    assert spark.read.parquet(f"{latest}/summaries").agg(F.sum("lost")).first()[0] > 0


def test_nothing_and_wrong_numbers(spark, log):
    assert rows(heavy.param_heavy_values(log.where("false"))) == []
    for bad in ({"num": 0}, {"width": 0}):
        with pytest.raises(ValueError, match="positive"):
            heavy.param_heavy_values(log, **bad)
