"""SimHash near-duplicates by tiled exact comparison.

Each document has a 64-bit fingerprint of its word shingles. Two fingerprints
within ``radius`` bits agree in at least one of ``radius + 1`` pieces, so
fingerprints are gathered by piece value, which loses no link. What shares a
value is compared in tiles ordered by population count, by exclusive-or and bit
counts; tile pairs whose counts differ by more than the radius are skipped. A
value that very many fingerprints have is cut by population count and hash into
several tiles, and pairs of those are dealt out one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import components, free_name, local_roots, partitions, written

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 1024
_STEP = 1 << 16


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hash of each shingle in order; none for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(len(found) - words + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = hashes[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The bits set in over half of the shingles' hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def _pieces(radius: int) -> list[tuple[int, int]]:
    """Shift and mask of each piece of 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _tiles(points: DataFrame, radius: int, tile: int) -> DataFrame:
    """Points ``(fp, rep)`` dealt to tiles in which all linked pairs meet."""
    band = F.call_function("div", F.bit_count("fp"), F.lit(radius + 1)).cast("int")
    shares = [
        F.struct(F.lit(i).alias("piece"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(mask)).alias("part"))
        for i, (a, mask) in enumerate(_pieces(radius))
    ]
    parts = points.select("fp", "rep", band.alias("band"), F.inline(F.array(*shares)))
    number = F.ceil(F.col("n") / tile).cast("int")
    crowded = (
        parts.groupBy("piece", "part", "band").agg(F.count("*").alias("n"))
        .groupBy("piece", "part")
        .agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", number))).alias("cuts"))
        .where(F.col("all") > tile)
        .drop("all")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")[F.col("band")])

    def with_band(shift: int, pair) -> Column:
        other = F.try_element_at("cuts", F.col("band") + shift)
        several = F.transform(F.sequence(F.lit(0), other - 1), lambda j: F.xxhash64("piece", "part", *pair(j)))
        return F.coalesce(several, F.array().cast("array<bigint>"))

    i = own.cast("int")
    dealt = F.array_distinct(
        F.concat(
            with_band(0, lambda j: (F.col("band"), F.least(i, j), F.col("band"), F.greatest(i, j))),
            with_band(1, lambda j: (F.col("band"), i, F.col("band") + 1, j)),
            with_band(-1, lambda j: (F.col("band") - 1, j, F.col("band"), i)),
        )
    )
    one = F.array(F.xxhash64("piece", "part"))
    joined = parts.join(crowded, ["piece", "part"], "left")
    return joined.select(
        F.explode(F.when(F.col("cuts").isNull(), one).otherwise(dealt)).alias("tile"), "fp", "rep"
    )


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _links_small(tile: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small tiles at once: each row against the row ``d`` places on."""
    left, right = [], []
    for d in range(1, len(tile)):
        at = np.flatnonzero(tile[d:] == tile[:-d])
        if not len(at):
            break
        at = at[pop[at + d] - pop[at] <= radius]
        at = at[_near(fp[at], fp[at + d], radius)]
        left.append(at)
        right.append(at + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links_large(pop: np.ndarray, fp: np.ndarray, radius: int, side: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one tile in blocks; blocks too far apart in population count are skipped."""
    for i in range(0, len(fp), side):
        a = fp[i : i + side]
        for j in range(i, len(fp), side):
            if pop[j] - pop[min(i + side, len(fp)) - 1] > radius:
                break
            x, y = np.nonzero(_near(a[:, None], fp[None, j : j + side], radius))
            keep = x + i < y + j
            yield x[keep] + i, y[keep] + j


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        """The links as a forest, each row with the first row it reaches."""
        if not len(a):
            return None
        root = local_roots(len(rep), a, b)
        at = np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root[at]])], schema=schema)

    def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tile, pop, fp, rep = columns
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.append(starts, len(tile)))
        small = np.repeat(sizes <= 64, sizes)
        found = [star(rep[small], *_links_small(tile[small], pop[small], fp[small], radius))]
        for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            pairs = list(_links_large(pop[s : s + n], fp[s : s + n], radius))
            found.append(star(rep[s : s + n], *(np.concatenate(x) for x in zip(*pairs))))
        yield from (b for b in found if b is not None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, pop, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append([tile, pop.astype(np.int16), fp.view(np.uint64), rep])
            if sum(len(h[0]) for h in held) >= 100_000 and tile[-1] != held[0][0][0]:
                columns = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                yield from whole([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
        if held:
            yield from whole([np.concatenate(x) for x in zip(*held)])

    return work


def links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A forest of links ``(a, b)`` that connects the same points ``(fp, rep)`` as all links within the radius."""
    return (
        _tiles(points, radius, tile)
        .select("tile", F.bit_count("fp").alias("pop"), "fp", "rep")
        .repartition(partitions(points.sparkSession), "tile")
        .sortWithinPartitions("tile", "pop")
        .mapInArrow(_compare(radius), "a long, b long")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Fingerprint and component of every row.

    Equal fingerprints are one point, however many documents have them. Rows
    that repeat an id are each fingerprinted and belong together only if their
    fingerprints do. A null id takes no part in naming components: a component
    of null ids only has none. A null text is one without words. Texts are read
    whole, however long; an empty table gives an empty one; columns other than
    id and text are not read, whatever they are called.
    """
    rows = written(with_fingerprints(docs, words), "simhash")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # Points are named by fingerprint, as ids may repeat.
    found = components(links(points.select("fp", F.col("fp").alias("rep")), radius, tile))
    named = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(names, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component.

    It is the row of the smallest id, then of the smallest hash of its text and
    other columns; null ids come last.
    """
    number = free_name(docs.columns, "_row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), words, radius)
    order = rows.select(
        F.col(number).alias("row"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("all"),
    )
    kept = (
        found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
        .join(order, "row")
        .groupBy("group")
        .agg(F.min(F.struct("nameless", "id", "text", "all", "row")).alias("least"))
        .select(F.col("least.row").alias(number))
    )
    return rows.join(kept, number, "left_semi").select(*docs.columns)
