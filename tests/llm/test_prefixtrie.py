"""The prefix trie: against a plain trie built in Python, and against SQL."""

import hashlib
import random
import zlib

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from hitpath.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    """The turns of each conversation, with the first ones of its hundred."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


def plain(made):
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, totals = {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node in members:
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            was = totals.get(node[:d], (0, 0))
            totals[node[:d]] = was[0] + (node not in children), was[1] + saved
    return [
        (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children.get(node, 0), *totals[node],
            sha(",".join(map(str, sorted(ends.get(node, []))))),
        )
        for node, cs in members.items()
    ]


def check(conversations):
    got = prefixtrie.shared_prefixes(conversations)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
    made = rebuilt([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    want = plain(made)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return want


def test_whole_table(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert max(row[3] for row in want if row[1] == 1) > 1


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-250, 450), 120):
        start = rng.choice([0, 0, 3])
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 40])):
            rows.append((conv, start + turn, rng.choice(["u", "a", None]), rng.choice(["x", "yé", "", None, "😀z"])))
    rows += [(7, None, "u", "no turn"), (7, None, None, None), (7, 3, "u", "tie"), (7, 3, "u", "tie"), (None, 0, "u", "no id")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("idx", "depth", "n", "tree", "symbol")})
    check(table.repartition(3))


def test_copies_and_a_long_conversation(spark):
    """A third of all conversations are the same; one has most of the turns; one ends where others go on."""
    rows = [(c, t, "u", f"t{t}") for c in range(0, 900, 100) for t in range(4)]
    rows += [(c, t, "u", f"t{t}") for c in range(1, 40) for t in range(4)]
    rows += [(1000, t, "a", f"long {t % 50}") for t in range(300)] + [(1100, t, "a", f"long {t % 50}") for t in range(200)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_one_turnless_conversation_and_none(spark):
    # Its hundred has no first conversation, and its only turn is among the first h.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert check(spark.createDataFrame([(lone, 0, "u", "x")], SCHEMA)) == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]
    assert check(spark.createDataFrame([], SCHEMA)) == []
    assert check(spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)) == []


def test_runs_of_ids(spark, monkeypatch):
    """Hashes of more ids than a run holds."""
    monkeypatch.setattr(prefixtrie, "RUN", 7)
    members = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("whole"), F.col("id").alias("conv_id"))
    got = {bytes(r.whole): r.ends_sha256 for r in prefixtrie._hash_ends(members).collect()}
    assert got == {
        b"a": sha(",".join(str(i) for i in range(1000) if i % 3)), b"b": sha(",".join(str(i) for i in range(0, 1000, 3))),
    }


def test_sql(spark, con):
    assert spark_rows(queries.op13_prefixes(spark, "/root/testdata/sf0.001")) == duck_rows(con, queries.oracle_sql()["op13_prefixes"])
