"""Near copies by the similarity of shingle sets: candidates from fingerprints, each confirmed exactly.

Candidates are texts whose SimHash fingerprints are close or that agree in one
of ``BANDS`` keys of ``WIDTH`` minimum hashes: at a similarity of 0.8 a pair
shares a key with probability 1 - (1 - 0.8^8)^32 = 0.997. Whatever candidates
connect is gathered, and there every pair is compared by its sets of shingles,
so that only pairs of the wanted similarity are linked. Groups too large for
one task are cut into slices by hash, and pairs of slices are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from hitpath.llm.common import components, free_name, partitions, picked, slices, written
from hitpath.llm.simhash import links, majority, shingle_hashes

BANDS, WIDTH = 32, 8
SIMILARITY = 0.8
SLICE, SLICE_SHINGLES = 64, 2_000_000
_STEP = 2048
_SEEDS = np.random.default_rng(7).integers(0, 2**64, (2, BANDS * WIDTH, 1), np.uint64)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * WIDTH, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _STEP):
        low = np.minimum(low, ((shingles[None, i : i + _STEP] ^ _XOR) * _TIMES).min(axis=1))
    data, n = low.tobytes(), 8 * WIDTH
    keys = [xxhash.xxh64_intdigest(data[n * b : n * b + n], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def _prepared(docs: DataFrame, words: int) -> tuple[DataFrame, list[str]]:
    """The rows with a number, the hash of their shingle set, its size, fingerprint and keys, and those columns' names."""
    names: list[str] = []
    for name in ("_row", "_set", "_size", "_fp", "_keys"):
        names.append(free_name([*docs.columns, *names], name))
    kinds = [LongType()] * 4 + [ArrayType(LongType())]
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds))])
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 36
        for batch in chain.from_iterable(slices(b, text, 500_000) for b in batches):
            found = [[], [], [], []]
            for t in batch.column(text):
                hashes = shingle_hashes(t.as_py(), words)
                own = np.unique(hashes)
                row = (xxhash.xxh64_intdigest(own.tobytes()), len(own), majority(hashes), band_keys(own))
                for column, x in zip(found, row):
                    column.append(x)
            longs = [np.array(c, np.uint64).view(np.int64) for c in found[:3]]
            keys = pa.array(found[3], pa.list_(pa.int64()))
            numbers = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers), *map(pa.array, longs), keys], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(work, schema), names


def _candidates(points: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` between sets ``(set, fp, keys)`` that connect all that share a key or have close fingerprints."""
    # Equal sets have equal keys, so one row of each is enough; it is written, as two uses would each make it anew.
    one = written(points.groupBy("set").agg(F.first("keys").alias("keys")), "near-copies-keys")
    keys = one.select("set", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("set").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_fp = points.groupBy("fp").agg(F.min("set").alias("rep"))
    return (
        keys.join(shared, "key").select(F.col("set").alias("a"), F.col("first").alias("b"))
        .unionByName(points.select("fp", "set").distinct().join(by_fp, "fp").select(F.col("set").alias("a"), F.col("rep").alias("b")))
        .unionByName(links(by_fp, radius))
        .where("a <> b")
    )


def _dealt(found: DataFrame, points: DataFrame) -> DataFrame:
    """Connected candidates ``(row, set, tiles)``: one row of each set and the tiles in which all pairs meet."""
    nodes = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    one = points.groupBy("set").agg(F.min("row").alias("row"), F.min("size").alias("size"))
    members = nodes.join(one, F.col("node") == F.col("set")).select("set", "row", "size", "component")
    slices = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all")).select(
        "component",
        F.ceil(
            F.greatest(F.col("n") / F.greatest(F.lit(SLICE), F.least(F.lit(1024), F.col("n") / 16)), F.col("all") / SLICE_SHINGLES)
        ).cast("int").alias("k"),
    )
    own = F.pmod(F.xxhash64("set"), F.col("k")).cast("int")

    def pair(j: Column) -> Column:
        return F.xxhash64("component", F.least(own, j), F.greatest(own, j))

    # Two slices that meet also compare each with itself.
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: (j != own) | (F.col("k") == 1))
    return members.join(slices, "component").select("row", "set", F.transform(others, pair).alias("tiles"))


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first that it is connected with by pairs of at least the similarity."""
    sizes = np.array(list(map(len, sets)), np.int64)
    starts = np.cumsum(sizes) - sizes
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    least, name, present = round(1000 * similarity), np.arange(len(sets)), np.zeros(len(values), np.int64)
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        apart = name != name[i]
        if not apart.any():
            break
        present[codes[a : a + n]] = 1
        both = np.add.reduceat(present[codes], starts)
        present[codes[a : a + n]] = 0
        joined = np.unique(name[apart & (1000 * both >= least * (n + sizes - both))])
        if len(joined):
            joined = np.append(joined, name[i])
            name[np.isin(name, joined)] = joined.min()
    return name


def _confirmed(dealt: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between sets of at least the similarity."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["set", "tiles", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list) -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                nodes = np.array([x[0] for x in held])
                name = similar([np.frombuffer(x[1], np.uint64) for x in held], similarity)
                at = np.flatnonzero(name != np.arange(len(name)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[name[at]])], names=["a", "b"])

        tile, held = None, []
        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tile:
                    yield from links(held)
                    tile, held = t, []
                held.append(row)
        yield from links(held)

    sets = dealt.join(texts, "row").select("set", "tiles", "text").mapInArrow(
        gather, "set long, tiles array<long>, shingles binary"
    )
    return (
        sets.select(F.explode("tiles").alias("tile"), "set", "shingles")
        .repartition(partitions(dealt.sparkSession), "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(compare, "a long, b long")
    )


def deduplicated(docs: DataFrame, words: int = 5, radius: int = 6, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of rows that pairs of at least the similarity connect.

    It is the row of the smallest id, then of the smallest hash of its text and
    other columns; null ids come last. Equal sets are similar, empty ones too.
    """
    prepared, names = _prepared(docs, words)
    rows = written(prepared, "near-copies")
    number, set_, size, fp, keys = names
    every = rows.select(
        F.col(number).alias("row"), F.col(set_).alias("set"), F.col(size).alias("size"), F.col(fp).alias("fp"), F.col(keys).alias("keys")
    )
    points = every.where("size > 0")
    near = components(_candidates(points, radius))
    texts = rows.select(F.col(number).alias("row"), "text")
    dealt = written(_dealt(near, points), "near-copies-dealt")
    found = components(_confirmed(dealt, picked(texts, "row", dealt.select("row")), words, similarity))
    order = rows.select(
        F.col(set_).alias("node"), F.col("doc_id").isNull().alias("nameless"), "doc_id",
        F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("all"), F.col(number).alias("row"),
    )
    kept = (
        order.join(found, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("group"))
        .agg(F.min(F.struct("nameless", "doc_id", "text", "all", "row")).alias("least"))
        .select(F.col("least.row").alias(number))
    )
    return picked(rows, number, kept).select(*docs.columns)
