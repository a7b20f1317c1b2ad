"""The Merkle manifest: against a plain tree built in Python, and against SQL."""

import hashlib
import random
import zlib

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from hitpath.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def siblings(levels, at, arity):
    found = []
    for level in levels[:-1]:
        start = at // arity * arity
        run = level[start : start + arity]
        found.append((run[: at - start], run[at - start + 1 :]))
        at //= arity
    return found


def plain(rows, arity=8):
    """The expected rows of the query for (doc_id, source, lang, n_chars, text) tuples."""
    least = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees, order = {}, sorted(groups, key=least)
    for lang in order:
        groups[lang].sort(key=lambda r: (least(r[0]), leaf_of(r)))
        trees[lang] = build([leaf_of(r) for r in groups[lang]], arity)
    top = build([trees[lang][-1][0] for lang in order], arity)
    found = []
    for at, lang in enumerate(order):
        for i, row in enumerate(groups[lang]):
            path = siblings(trees[lang], i, arity) + siblings(top, at, arity)
            seen = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                seen[4] = row[4].translate({c: c + 32 for c in range(65, 91)})
            now = leaf_of(seen)
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in path))
            found.append((row[0], leaf_of(row), trees[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return found


def check(docs):
    got = merkle.verified_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain([tuple(r) for r in docs.select(*COLUMNS).collect()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return want


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_op12(request, table):
    want = check(request.getfixturevalue(table))
    if table == "documents":
        assert {row[-1] for row in want} == {True, False}


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    langs = [None, "", "a", "é", "z", "日"] + [f"l{i}" for i in range(20)]
    rows = [
        (rng.choice([None, 1, 2, -3, 10, 9, *range(100, 150)]), rng.choice([None, "", "s"]), lang, rng.choice([None, 0, 5]), rng.choice([None, "", "Ab", "c"]))
        for lang in langs for _ in range(rng.choice([1, 2, 8, 9, 65]))
    ]
    rows += [(7, "s", "a", 1, "Same")] * 30
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "idx", "n", "digest", "_order", "path", "part")})
    check(docs.repartition(5))


@pytest.mark.parametrize("arity, n", [(8, 0), (8, 1), (8, 8), (8, 9), (8, 65), (3, 3), (3, 10), (2, 2), (2, 3), (2, 9)])
def test_levels_of_one_tree(spark, arity, n):
    docs = spark.createDataFrame([(i, None, "x", i, str(i)) for i in range(n)], SCHEMA)
    made = merkle.Manifest(docs, arity=arity)
    want = build([leaf_of((i, None, "x", i, str(i))) for i in range(n)], arity) if n else []
    got = made.nodes().where("not upper").select("level", "idx", merkle.hexed(F.col("digest")).alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [(k, i, d) for k, level in enumerate(want) for i, d in enumerate(level)]
    rows = made.proofs().select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), merkle.hexed(F.col("root")).alias("r")).collect()
    assert len(rows) == n and all(r.f == r.r == want[-1][0] for r in rows)


def test_sql(spark, con):
    assert spark_rows(queries.op12_merkle(spark, "/root/testdata/sf0.001")) == duck_rows(con, queries.oracle_sql()["op12_merkle"])


def test_joins_are_equijoins(documents):
    plan = merkle.verified_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
