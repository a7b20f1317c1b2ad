import pytest
from helpers import rows
from pyspark.sql import functions as F

from hitpath.functions import scores


@pytest.mark.parametrize(
    "num, src, target, value",
    [
        (1000, 1000000, 6, 3), (32, 1024, 10, 5), (20, 1000000, 6, 1.30102999566), (1, 1024, 10, 0),
        (0, 1024, 10, 0), (-1, 1024, 10, 0), (5, 1, 10, 0), (5, 0, 10, 0), (5, 10, 0, 0),
    ],
)
def test_log_norm(spark, num, src, target, value):
    (got,) = rows(spark.range(1).select(scores.log_norm(F.lit(num), F.lit(src), target)))[0]
    assert got == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("part, whole, value", [(2, 3, 66.66), (1, 3, 33.33), (29, 100, 29.0), (1, 1, 100.0), (1, 10**6, 0.0)])
def test_truncated_percent(spark, part, whole, value):
    assert rows(spark.range(1).select(scores.percent_truncated(F.lit(part), F.lit(whole)))) == [(value,)]


@pytest.mark.parametrize("level, value", [(0, 0.0), (20, 0.0), (50, 0.5), (80, 1.0), (100, 1.0)])
def test_intensity(spark, level, value):
    (got,) = rows(spark.range(1).select(scores.intensity(F.lit(level), F.lit(100))))[0]
    assert got == pytest.approx(value)


def test_labels_and_formats(spark):
    one = spark.range(1)
    label = lambda *a: rows(one.select(scores.parameter_label(*map(F.lit, a))))[0][0]
    assert [label("path", 1, ""), label("path", 2, "id"), label("query", 0, "page")] == ["Path param(1)", ":id", "?page"]
    assert rows(one.select(scores.thousands(F.lit(1234567)), scores.percent_text(F.lit(1), F.lit(3)))) == [("1,234,567", "33.33")]
