"""A Merkle manifest of a table: one tree per group of rows, and a tree over the roots of the groups.

Nodes are rows ``(tree, idx, n, digest)``: the place of a node on its level and
the number of nodes there. On each level every node computes the indices of its
siblings (by exclusive-or in a binary tree, by the offsets of the other slots
otherwise) and fetches their digests by an equijoin on ``(tree, idx)``; the
nodes in slot zero then emit the parents. Keys are as many as nodes, so a group
that holds most rows is spread like any other, and no step gathers more than
the siblings of one node. The levels, each written once, hold all that proofs
need: paths are joined from the root down, and folded where the rows are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import in_order, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: Sequence[Column]) -> Column:
    """The SHA-256 of the fields of a row, one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def parent_digest(children: Column) -> Column:
    """The digest of a node from its children's digests in hexadecimal, one after the other."""
    return F.unhex(F.sha2(children, 256))


def sibling_indices(arity: int) -> Column:
    """The indices of the other children of a node's parent, those that exist."""
    idx, n = F.col("idx"), F.col("n")
    if arity == 2:
        others = F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = idx % arity
        others = F.transform(
            F.filter(F.sequence(F.lit(0).cast("long"), F.lit(arity - 1).cast("long")), lambda s: s != slot),
            lambda s: idx - slot + s,
        )
    return F.filter(others, lambda i: i < n)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``, the digests of their siblings before and behind them, concatenated."""
    asked = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.explode(sibling_indices(arity)).alias("_sib"))
    held = nodes.select("tree", "idx", "digest")
    met = asked.join(held, F.col("_tree").eqNullSafe(F.col("tree")) & (F.col("_sib") == F.col("idx")))
    found = met.groupBy("_tree", "_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_found"))

    def side(keep) -> Column:
        digests = F.transform(F.filter("_found", keep), lambda s: F.hex(s["digest"]))
        return F.coalesce(F.unhex(F.array_join(digests, "")), F.unhex(F.lit("")))

    here = F.col("_idx")
    sides = found.select(
        "_tree", "_idx", side(lambda s: s["idx"] < here).alias("left"), side(lambda s: s["idx"] > here).alias("right")
    )
    none = F.unhex(F.lit(""))
    return nodes.join(
        sides, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("idx") == F.col("_idx")), "left"
    ).select(*nodes.columns, F.coalesce("left", none).alias("left"), F.coalesce("right", none).alias("right"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level, emitted by the nodes in slot zero, which know all digests of their run."""
    return level.where(F.col("idx") % arity == 0).select(
        "tree",
        F.expr(f"idx div {arity}").alias("idx"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        parent_digest(F.concat(hexed(F.col("digest")), hexed(F.col("right")))).alias("digest"),
    )


class Trees:
    """The levels of all trees over ``leaves`` ``(tree, idx, n, digest, ...)``, from the leaves up.

    ``levels[k]`` holds the nodes of level k of the trees that have several
    there, with their siblings; ``tops[k]`` the roots of trees that end there.
    """

    def __init__(self, leaves: DataFrame, arity: int, name: str):
        if arity < 2:
            raise ValueError(f"a node needs two children at least, not {arity}")
        self.arity, self.leaves = arity, leaves
        self.levels: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        most = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        while True:
            self.tops.append(nodes.where("n = 1"))
            if most <= 1:
                break
            level = written(with_siblings(nodes.where("n > 1"), arity), f"{name}-level{len(self.levels)}")
            self.levels.append(level)
            nodes = parents(level, arity)
            most = -(-most // arity)

    def roots(self) -> DataFrame:
        """``(tree, digest)`` of every tree."""
        found = [top.select("tree", "digest") for top in self.tops]
        for other in found[1:]:
            found[0] = found[0].unionByName(other)
        return found[0]

    def nodes(self) -> DataFrame:
        """Every node as ``(tree, level, idx, digest)``."""
        found = [
            rows.select("tree", F.lit(k).alias("level"), "idx", "digest")
            for some in (self.levels, self.tops) for k, rows in enumerate(some)
        ]
        for other in found[1:]:
            found[0] = found[0].unionByName(other)
        return found[0]

    def paths(self, start: DataFrame) -> DataFrame:
        """The leaves with ``path``, the siblings level by level, and the columns of ``start``.

        ``start`` has one row per tree: ``tree``, the ``path`` that continues
        above its root, and other columns that its leaves are given.
        """
        given = [c for c in start.columns if c not in ("tree", "path")]
        begin = start.withColumnRenamed("tree", "_tree")
        ends = [top.join(begin, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree") for top in self.tops]
        above = ends[-1]
        for k in reversed(range(len(self.levels))):
            upper = above.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "path", *given)
            here = self.levels[k].join(
                upper,
                F.col("tree").eqNullSafe(F.col("_tree")) & (F.expr(f"idx div {self.arity}") == F.col("_idx")),
            )
            step = F.array(F.struct("left", "right"))
            above = here.withColumn("path", F.concat(step, "path")).drop("_tree", "_idx", "left", "right")
            above = above.unionByName(ends[k].select(*above.columns))
        return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give, as hexadecimal text."""
    return F.aggregate(path, hexed(leaf), lambda h, s: F.sha2(F.concat(hexed(s["left"]), h, hexed(s["right"])), 256))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level and from left to right, as hexadecimal text."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


class Manifest:
    """The Merkle tree of a table, and the proofs of its rows.

    A leaf is the digest of ``fields`` of a row; leaves of one value of
    ``tree`` ascend by ``order`` and become a tree of ``arity``; the roots of
    these, ordered by value, become the upper tree. ``also`` are columns to be
    kept with the leaves.

    Any column may be null: a null is hashed as ``-``, a null ``tree`` is a
    group of its own and comes first, as does a null ``order`` in its group.
    Rows of equal ``order`` follow by their digest, so rows that repeat are
    leaves of their own and results don't depend on how rows are dealt. A
    group of one row has its leaf as root, a table of one group the group's
    root. An empty table has no nodes, and its root is null. Columns other
    than those named are not read, whatever they are called; texts are hashed
    whole.
    """

    def __init__(
        self, docs: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id", tree: str = "lang",
        arity: int = ARITY, also: Mapping[str, Column] | None = None,
    ):
        rows = docs.select(
            F.col(tree).cast("string").alias("tree"), F.col(order).alias("_order"),
            digest([F.col(name) for name in fields]).alias("digest"),
            *(value.alias(f"also_{name}") for name, value in (also or {}).items()),
            # Splits rows that are the same in all else.
            F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
        )
        leaves = in_order(written(rows, "merkle-leaves"), ["_order", "digest", "_salt"], "merkle")
        self.trees = Trees(leaves.drop("_salt"), arity, "merkle")
        subroots = self.trees.roots().select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("_key"), "digest")
        self.upper = Trees(in_order(written(subroots, "merkle-subroots"), ["_key"], "merkle-upper"), arity, "merkle-upper")
        self._order, self._tree, self._also = order, tree, list(also or {})

    def root(self) -> Column:
        """The digest of the whole table, to be used in a query."""
        return self.upper.roots().select("digest").scalar()

    def nodes(self) -> DataFrame:
        """Every node as ``(tree, level, idx, digest)``; those above the groups have ``upper`` set."""
        return (
            self.trees.nodes().withColumn("upper", F.lit(False))
            .unionByName(self.upper.nodes().withColumn("upper", F.lit(True)))
        )

    def proofs(self) -> DataFrame:
        """One row per leaf: its order and tree values, ``leaf``, ``subroot``, ``root``, ``path``, and what ``also`` names."""
        none = F.lit(None).cast("string")
        top = self.upper.roots().select(none.alias("tree"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
        start = self.upper.paths(top).select(F.col("_key").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
        rows = self.trees.paths(start)
        return rows.select(
            F.col("_order").alias(self._order), F.col("tree").alias(self._tree), F.col("digest").alias("leaf"),
            "subroot", "root", "path", *(F.col(f"also_{name}").alias(name) for name in self._also),
        )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def verified_documents(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of ``documents``, and whether each row, some of them tampered with, still verifies.

    Where 3 divides the crc32 of the decimal ``doc_id``, the text that is
    checked has its A-Z lower-cased; a null id has no decimal and is left alone.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    seen = digest([text if name == "text" else F.col(name) for name in FIELDS])
    proofs = Manifest(docs, also={"seen": seen}).proofs()
    return proofs.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("seen"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
