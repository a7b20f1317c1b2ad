import pytest
from helpers import log_line, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hitpath.sources.ltsv import parse_lines, read_ltsv
from hitpath.sources.store import read_entries, write_entries, write_report

GOOD = "status:200\ttime:29/Feb/2024:23:59:58 -0330\tuidset:sid=k7\tuidgot:-\treq:PUT /orders/new HTTP/1.1"


def parse(spark, lines, **options):
    return parse_lines(spark.createDataFrame(list(zip(lines, range(len(lines)))), "value string, ord int"), **options)


def test_fields(spark):
    row = parse(spark, [GOOD]).withColumn("s", F.unix_seconds("time")).first()
    assert (row.method, row.uri, row.path, row.query, row.status, row.uid, row.set_new_uid, row.s) == (
        "PUT", "/orders/new", "/orders/new", "", 200, "k7", True, 1709263798,
    )
    assert row.req == "PUT /orders/new HTTP/1.1" and row.route_id is None


def test_other_labels_and_blank_lines_are_ignored(spark):
    df = parse(spark, ["", "xreq:no\tuid:no\t" + GOOD + "\treqtime:1\tstatus2:5", ""])
    assert rows(df, "uri", "status") == [("/orders/new", 200)]


@pytest.mark.parametrize(
    "cookies, uid, new",
    [
        ("uidset:uid=A\tuidgot:-", "A", True),
        ("uidset:-\tuidgot:uid=B", "B", False),
        ("uidset:\tuidgot:B", "B", False),
        ("uidset:uid=A\tuidgot:uid=B", "B", True),
        ("uidgot:uid=B\tuidset:uid=A", "A", True),
        ("uidset:uid=A\tuidset:-", "A", True),
        ("uidset:uid=A\tuidset:uid=C\tuidgot:-", "C", True),
        ("uidgot:a=b=c", "b=c", False),
        ("uidgot:--", "--", False),
    ],
)
def test_user_id(spark, cookies, uid, new):
    line = f"time:29/Feb/2024:23:59:58 -0330\treq:GET / HTTP/1.1\tstatus:200\t{cookies}"
    assert rows(parse(spark, [line]), "uid", "set_new_uid") == [(uid, new)]


@pytest.mark.parametrize(
    "head, tail, error",
    [
        ("", "\tstatus:404\tstatus:201", None),
        ("status:2x\t", "", "bad status"),
        ("", "\tstatus:2x\tstatus:200", "bad status"),
        ("time:yesterday\t", "", "bad time"),
        ("xstatus:2x\tstatus2:y\t", "", None),
    ],
)
def test_each_of_repeated_labels_is_checked(spark, head, tail, error):
    df = parse(spark, [head + GOOD + tail], mode="permissive")
    assert rows(df, "error") == [(error,)]


def test_last_of_repeated_labels_wins(spark):
    df = parse(spark, [GOOD + "\tstatus:404\treq:GET /x HTTP/1.1"])
    assert rows(df, "method", "uri", "status") == [("GET", "/x", 404)]


@pytest.mark.parametrize(
    "line, error",
    [
        (GOOD + "\tagent=none", "field without a label"),
        (GOOD + "\t", "field without a label"),
        (GOOD.replace("status:200", "status: 200"), "bad status"),
        (GOOD.replace("status:200", "status:2x"), "bad status"),
        (GOOD.replace("status:200", "status:"), "bad status"),
        (GOOD.replace("29/Feb", "2024-02"), "bad time"),
        (GOOD.replace("time:29/Feb/2024:23:59:58 -0330\t", ""), "missing time"),
        (GOOD.replace("req:", "request:"), "missing req"),
        (GOOD.replace("status:200\t", ""), "missing status"),
        (GOOD.replace("status:200", "status:0"), "missing status"),
        (GOOD.replace("sid=k7", "-"), "missing uid"),
        (GOOD.replace("sid=k7", "sid="), "missing uid"),
        (GOOD.replace("status:200", "status:+200"), None),
    ],
)
def test_validation(spark, line, error):
    assert rows(parse(spark, [line], mode="permissive"), "error") == [(error,)]
    assert parse(spark, [line, GOOD], mode="dropmalformed").count() == (1 if error else 2)
    strict = parse(spark, [GOOD, line])
    if error is None:
        assert strict.count() == 2
    else:
        # Also when none of the checked columns is asked for.
        for query in (strict.select("ord"), strict.groupBy().count()):
            with pytest.raises(PySparkException, match=error):
                query.collect()


def test_wrong_time_format_and_mode(spark):
    with pytest.raises(PySparkException, match="bad time"):
        parse(spark, [GOOD], time_format="dd/MM/yyyy:HH:mm:ss Z").collect()
    other = GOOD.replace("29/Feb/2024:23:59:58 -0330", "2024-03-01T03:29:58Z")
    df = parse(spark, [other], time_format="yyyy-MM-dd'T'HH:mm:ssX")
    assert rows(df.select(F.unix_seconds("time"))) == [(1709263798,)]
    with pytest.raises(ValueError, match="mode"):
        parse(spark, [GOOD], mode="lenient")


def test_labels(spark):
    line = GOOD.replace("req:", "r.q:").replace("uidset:", "set:")
    df = parse(spark, [line], labels={"req": "r.q", "uidset": "set", "nothing": "x"})
    assert rows(df, "uri", "uid", "set_new_uid") == [("/orders/new", "k7", True)]


def test_files_keep_line_order_across_splits(spark, tmp_path):
    for name, start in (("a.log", 0), ("b.log", 5000)):
        lines = [log_line(i % 3, f"GET /{i} HTTP/1.1", "u", True) for i in range(start, start + 2000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_ltsv(spark, str(tmp_path / "*.log"))
        assert df.rdd.getNumPartitions() > 4
        got = [int(u[1:]) for (u,) in rows(df.orderBy("ord"), "uri")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(2000)) + list(range(5000, 7000))


@pytest.mark.parametrize("split_bytes, open_bytes", [("128m", "4m"), ("20000", "0"), ("1000", "0")])
def test_line_numbers_of_files(spark, tmp_path, split_bytes, open_bytes):
    """Blank lines count; one split, several, and some two hundred."""
    want = []
    for name, n in (("a.log", 1500), ("b.log", 40), ("c.log", 0)):
        lines = []
        for i in range(1, n + 1):
            lines.append("" if i % 9 == 0 else log_line(i % 3, f"GET /{name[0]}{i} HTTP/1.1", "u", True))
            if lines[-1]:
                want.append((name, i, f"/{name[0]}{i}"))
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name == "a.log"))
    before = [spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", open_bytes)
    try:
        df = read_ltsv(spark, str(tmp_path / "*.log"), line_numbers=True)
        got = rows(df.select(F.element_at(F.split("ord.file", "/"), -1), "ord.line", "uri"))
        if split_bytes == "1000":
            assert df.rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got) == sorted(want)


def test_missing_file_is_named(spark):
    with pytest.raises(PySparkException, match="not_exists.log"):
        read_ltsv(spark, "./not_exists.log")


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(log_line(i, f"GET /{i % 7}?a={i} HTTP/1.1", f"u{i % 3}", i < 3) for i in range(50)))
    parsed = read_ltsv(spark, str(tmp_path / "a.log"))
    write_entries(parsed, str(tmp_path / "entries"))
    stored = read_entries(spark, str(tmp_path / "entries"))
    assert sorted(rows(stored.select(*parsed.columns))) == sorted(rows(parsed))
    plan = stored.where("status = 200").select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,200)" in plan and "query" not in plan.split("ReadSchema")[1]


def test_times_rule_out_days(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(log_line(i * 3600, f"GET /{i} HTTP/1.1", "u", i == 0) for i in range(18)))
    day = F.expr("make_interval(0, 0, 0, 1)")
    parsed = read_ltsv(spark, str(tmp_path / "a.log"))
    for i in range(6):
        write_entries(parsed.withColumn("time", F.col("time") + day * i), str(tmp_path / "entries"), mode="append")
    whole = read_entries(spark, str(tmp_path / "entries"))
    cut = read_entries(spark, str(tmp_path / "entries"), "2024-03-09 12:30:00Z", "2024-03-10 11:00:00Z")
    want = whole.where("time >= TIMESTAMP '2024-03-09 12:30:00Z' AND time < TIMESTAMP '2024-03-10 11:00:00Z'")
    assert sorted(rows(cut, "time", "uri")) == sorted(rows(want, "time", "uri")) and want.count() > 0
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan.split("PartitionFilters")[1]
    days = {f.split("date=")[1][:10] for f in cut.inputFiles()}
    assert len({r[0] for r in whole.select("date").distinct().collect()}) > len(rows(cut.select("date").distinct()))
    assert days


@pytest.mark.parametrize("format, sep", [("csv", ","), ("tsv", "\t")])
def test_report_files(spark, tmp_path, format, sep):
    table = spark.createDataFrame([("GET", "/", 1234)], "Method string, Uri string, `0` int").coalesce(1)
    write_report(table, str(tmp_path / "r"), format)
    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert text.splitlines() == [sep.join(["Method", "Uri", "0"]), sep.join(["GET", "/", "1234"])]
    with pytest.raises(ValueError, match="format"):
        write_report(spark.range(1), str(tmp_path / "x"), "xml")
