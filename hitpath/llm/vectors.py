"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors are quantised to int8. The product of two quantised vectors
differs from their cosine by no more than a bound that follows from the two
quantisation errors, so only pairs whose product comes within that bound of the
threshold are computed in double precision. Vectors are dealt to blocks around
pivots, and a vector is sent only to blocks that the triangle inequality does
not rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import components, local_roots, partitions, written

THRESHOLD = 0.95
BLOCK = 8192
MOST_PIVOTS = 1024
_SIDE = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64, without copies of other columns."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps tiny and huge vectors exact.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, and the length of what rounding has taken from each."""
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(unit - small * scale[:, None], axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; float32 holds sums of up to 1000 of them exactly."""
    total = np.zeros((len(a), len(b)), np.float32)
    if a.shape[1] <= 1000:
        return a.astype(np.float32) @ b.astype(np.float32).T
    total = total.astype(np.float64)
    for i in range(0, a.shape[1], 1000):
        total += a[:, i : i + 1000].astype(np.float32) @ b[:, i : i + 1000].astype(np.float32).T
    return total


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of two blocks, or of one with itself, tile by tile.

    For unit u = û + e with |e| = ε the cosine u·v differs from û·v̂ by at most
    ε_u + ε_v + ε_u ε_v, as |û| <= 1 + ε_u.
    """
    ua = _unit(a)
    qa, sa, ea = quantised(ua)
    ub, qb, sb, eb = (ua, qa, sa, ea) if b is None else (_unit(b), *quantised(_unit(b)))
    for i in range(0, len(ua), _SIDE):
        si, ei = sa[i : i + _SIDE], ea[i : i + _SIDE]
        for j in range(i if b is None else 0, len(ub), _SIDE):
            sj, ej = sb[j : j + _SIDE], eb[j : j + _SIDE]
            # One comparison per pair with the tile's largest scale and error, then the pair's own bound.
            lowest = threshold - (ei + ej.max() + ei * ej.max()) - 1e-9
            raw = _product(qa[i : i + _SIDE], qb[j : j + _SIDE])
            limit = np.where(lowest > 0, lowest / (si * sj.max()), -np.inf) * (1 - 1e-6)
            x, y = np.nonzero(raw >= limit[:, None])
            near = raw[x, y] * si[x] * sj[y] >= threshold - (ei[x] + ej[y] + ei[x] * ej[y]) - 1e-9
            x, y = x[near] + i, y[near] + j
            if b is None:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
                yield p[exact], q[exact]


def _points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the hash of their vector, and one row per different valid vector."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding")).alias("v"))
    keyed = rows.withColumns(
        {"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))}
    )
    points = (
        keyed.where("v IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return keyed.select("vec_id", "h1", "h2"), points


class _Cells:
    """Pivots, the blocks of each cell, and which cells a vector's partners can be in."""

    def __init__(self, pivots: np.ndarray, threshold: float, block: int):
        self.pivots, self.block = pivots, block
        self.sine = math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else math.inf
        self.angle = math.acos(max(-1.0, min(1.0, threshold)))
        apart = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
        self.apart = np.where(apart > 0, apart, np.inf)
        self.radius = np.full(len(pivots), np.pi)
        self.count = np.ones(len(pivots), np.int64)

    def home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = unit @ self.pivots.T
        home = near.argmax(axis=1)
        return home, near

    def reach(self, home: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Cells in which a partner can be: by the plane between two pivots and by the cell's radius."""
        rows = np.arange(len(home))
        lead = (near[rows, home][:, None] - near) / self.apart[home]
        far = np.arccos(np.clip(near, -1, 1)) - self.radius[None, :]
        able = (lead <= self.sine + 1e-9) & (far <= self.angle + 1e-7)
        able[rows, home] = True
        return able


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links and component of every vector, by ``vec_id``.

    Equal vectors are one point with a number of copies, which all link with
    each other. Vectors that are null, zero or not finite link with nothing.
    A point goes to a task for every pair of blocks it can have partners in, so
    a task holds two blocks at most. Tasks return, for every point with links,
    how many it has and one link of a spanning forest. Vectors of different
    lengths are never compared. Rows that repeat an id are vectors of their own,
    and so are rows with a null id, which takes no part in naming components: a
    component of null ids only has none.
    """
    spark = vectors.sparkSession
    keyed, found = _points(vectors)
    keyed, points = written(keyed, "vectors"), written(found, "points")
    parts = partitions(spark)
    sizes = [(r["d"], r["n"]) for r in points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]
    empty = spark.createDataFrame([], "a long, b long, n long")
    pairs = empty
    for dim, n in sizes:
        pairs = pairs.unionByName(_pairs(points.where(F.size("v") == dim), n, threshold, block, parts))
    pairs = written(pairs, "vector-links")
    linked = pairs.groupBy("a").agg(F.sum("n").alias("linked"))
    groups = components(pairs.select("a", "b"))
    # Points are named by number, as ids may repeat; the number is written with them and stays.
    named = (
        points.select("h1", "h2", "node", "rep", "n")
        .join(linked.withColumnRenamed("a", "node"), "node", "left")
        .join(groups, "node", "left")
        .select(
            "h1", "h2", "rep",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(names, "component").select("h1", "h2", "n_links", "component_id")
    own = F.coalesce("component_id", "vec_id")
    return keyed.join(classes, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )


def _pairs(points: DataFrame, n: int, threshold: float, block: int, parts: int) -> DataFrame:
    """``(a, b, n)``: point ``a`` has ``n`` links found in one task, and ``b`` is one it reaches there."""
    k = max(1, min(MOST_PIVOTS, math.ceil(n / block)))
    picked = points.orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
    cells = _Cells(_unit(np.array([r["v"] for r in picked], np.float64)), threshold, block)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius = np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                home, near = cells.home(_unit(_matrix(batch.column(0))))
                count += np.bincount(home, minlength=k)
                np.maximum.at(radius, home, np.arccos(np.clip(near[np.arange(len(home)), home], -1, 1)))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k), "n": count, "radius": radius})

    for r in (
        points.select("v").mapInArrow(measure, "cell long, n long, radius double")
        .groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    ):
        cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"]
    blocks = np.maximum(1, -(-cells.count // block))
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every pair of its own block and a block it can have partners in."""
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                home, near = cells.home(_unit(_matrix(part.column(2))))
                spread = part.column(3).to_numpy() % blocks[home]
                own = first[home] + spread
                row, cell = np.nonzero(cells.reach(home, near))
                times = blocks[cell]
                row = np.repeat(row, times)
                other = np.repeat(first[cell], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                low, high = np.minimum(own[row], other), np.maximum(own[row], other)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low * total + high), pa.array(own[row]), *taken.columns[:3]],
                    names=["pair", "block", "node", "n", "v"],
                )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = divmod(key[0].as_py(), total)
        table = table.combine_chunks()
        node, copies = table["node"].to_numpy(), table["n"].to_numpy()
        x, own = _matrix(table["v"].combine_chunks()), table["block"].to_numpy()
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        degree, root = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(one) and len(two):
            for p, q in tile_links(x[one], None if low == high else x[two], threshold):
                p, q = one[p], two[q]
                np.add.at(degree, p, copies[q])
                np.add.at(degree, q, copies[p])
                if len(p):
                    root = _joined(root, p, q)
        at = np.flatnonzero(degree)
        return pa.table({"a": node[at], "b": node[root[at]], "n": degree[at]})

    spread = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30))
    vector = points.schema["v"].dataType.simpleString()
    return (
        points.select("node", "n", "v", spread.alias("spread"))
        .mapInArrow(deal, f"pair long, block long, node long, n long, v {vector}")
        .repartition(parts, "pair")
        .groupBy("pair")
        .applyInArrow(compare, "a long, b long, n long")
    )


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after more links."""
    return local_roots(len(root), root[a], root[b])[root]
