"""Helpers shared by the operators: the shared folder, ranges of ids, connected components, cached word encoding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWEST = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent, as in tests, a temporary one is made.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="hitpath-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def training(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether a document is in the training part: crc32 of its id as text, by remainder.

    A null id counts as the empty text.
    """
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(modulus)) != held_out


def id_bounds(ids: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` ids that cut the column into ranges of about equal size.

    They are ids that occur, strictly ascending and above the smallest; a null
    id counts as the lowest long. Only the id column is read.
    """
    key = F.coalesce(F.col(column), F.lit(LOWEST))
    shares = [i / n for i in range(1, n)] or [0.5]
    row = ids.agg(
        F.min(key).alias("low"), F.percentile_approx(key, shares, max(10_000, 20 * n)).alias("cuts")
    ).first()
    return sorted({x for x in row["cuts"] or [] if x > row["low"]})


def range_of(column: str, bounds: list[int]) -> Column:
    """The number of the range of ``id_bounds`` that an id falls into."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    return find(F.coalesce(F.col(column), F.lit(LOWEST)))


def in_order(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``idx``, the rank of a row within its ``tree`` by ``order``, and ``n``, the rows of the tree.

    Rows are sorted by ranges of all of these columns and take their place from
    the place in their partition and one count per tree and partition, so a
    tree spreads over as many tasks as its rows need.
    """
    part = F.shiftright("_at", 33)
    sort = ["tree", *order]
    placed = written(
        rows.repartitionByRange(partitions(rows.sparkSession), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()),
        f"{name}-placed",
    )
    trees = Window.partitionBy("tree")
    ahead = trees.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("tree").alias("tree"), part.alias("part")).agg(
        F.count("*").alias("rows"), F.min("_at").alias("low")
    )
    offsets = written(
        counts.select(
            F.col("tree").alias("_tree"), F.col("part").alias("_part"),
            (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - F.col("low")).alias("_shift"),
            F.sum("rows").over(trees).alias("n"),
        ),
        f"{name}-offsets",
    )
    return placed.join(offsets, F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part"))).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n"
    )


#: Entries of 64 row numbers each that may be broadcast, some 50 bytes an entry.
MOST_MASKS = 1_000_000


def picked(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``number`` is among those of ``wanted``, without shuffling rows while that can be helped.

    Numbers that follow one another, 64 at a time, are the bits of one long, so
    that tens of millions of rows fit into a table that may be broadcast. Its
    size is counted; beyond ``MOST_MASKS`` entries the rows are joined by number.
    """
    key, mask = free_name(rows.columns, "_at"), free_name(rows.columns, "_mask")
    low = F.expr(f"cast(`{number}` & 63 as int)")
    masks = written(
        wanted.groupBy(F.shiftright(number, 6).alias(key)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low)).alias(mask)),
        "masks",
    )
    if masks.count() > MOST_MASKS:
        return rows.join(wanted.select(number), number, "left_semi")
    bit = F.call_function("shiftrightunsigned", F.col(mask), low).bitwiseAND(F.lit(1).cast("long"))
    return rows.withColumn(key, F.shiftright(number, 6)).join(F.broadcast(masks), key).where(bit == 1).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``, as ``(node, component)`` with the smallest node as name.

    Alternates large-star and small-star steps until the edges no longer
    change. Each step groups to a minimum and joins, so that a node with very
    many links is pre-aggregated and its join can be split. Nodes without
    links, and those that name a component, are not returned.
    """
    found = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(found)
    while before[0]:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = checkpointed(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = digest(found)
        if now == before:
            break
        before = now
    return found.select(F.col("u").alias("node"), F.col("v").alias("component"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indices by the links ``a[i], b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordCache:
    """Ids of words, remembered between the batches and tasks of a worker.

    Texts repeat most of their words, so ``encode`` (words to one flat array of
    ids, with lengths) is asked once for each of the first ``most`` different
    words, which hold the frequent ones; it is asked again for others. Results
    don't depend on what is remembered.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.codes: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _append(self, words: list[str]) -> int:
        """Put the ids of words behind those known; returns how much of the pool is then used."""
        flat, lengths = self.encode(words)
        first, used = len(self.codes), self.used + len(flat)
        while used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while first + len(words) > len(self.start):
            self.start = np.resize(self.start, 2 * len(self.start))
            self.length = np.resize(self.length, 2 * len(self.length))
        self.pool[self.used : used] = flat
        self.start[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(words)] = lengths
        return used

    def ids(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents one after the other, and how many each has."""
        counts = np.fromiter(map(len, documents), np.int64, len(documents))
        words = list(chain.from_iterable(documents))
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            unknown = list(map(words.__getitem__, missing))
            new = dict(zip(dict.fromkeys(unknown), count(len(self.codes))))
            used = self._append(list(new))
            codes[missing] = list(map(new.__getitem__, unknown))
        lengths = self.length[codes].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        found = self.pool[ranges(self.start[codes], lengths)]
        if missing and len(self.codes) + len(new) <= self.most:
            self.codes.update(new)
            self.used = used
        return found, total[ends] - total[ends - counts]


def portions(sizes: Iterable[int], most: int) -> list[tuple[int, int]]:
    """Cut a sequence of sizes into slices of at most about ``most`` each."""
    cuts, total, start = [], 0, 0
    i = -1
    for i, size in enumerate(sizes):
        if total and total + size > most:
            cuts.append((start, i))
            start, total = i, 0
        total += size
    if i >= start:
        cuts.append((start, i + 1))
    return cuts


def slices(batch: pa.RecordBatch, field: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about ``most`` bytes, as Python and Spark each hold a whole batch at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(field)), 0).to_pylist()
    for i, j in portions(sizes, most):
        yield batch.slice(i, j - i)
