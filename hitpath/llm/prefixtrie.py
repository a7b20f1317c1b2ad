"""The trie of all conversations by their common first turns, in a van Emde Boas recursion over depths.

Blocks of 2^k depths are cut at half: the prefixes that end at the cut are
named, the upper halves become tries of their own, and so do the lower halves
below each name. All halves of one size, upper and lower, are one job, so a trie
of depth D takes log D rounds, however its conversations branch.

A name is the digest of the name at the start of the block and of the block's
first half, so every row derives it where it is; no join by a name is needed
that many conversations share. Totals of subtrees are grafted upward from small
blocks to large: what the lower tries below a cut sum up to is added to the
nodes of the upper one on the path to the cut, which the least member of the
cut's node knows. Each conversation is followed once, its copies only counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import in_order, partitions, written

#: Members of a node are hashed in runs of so many ids; blocks of so many turns share a row of their conversation.
RUN, BLOCK = 4096, 1024
#: A node with more than this share of all nodes as children is joined to them by broadcast: there are fewer than 1 / share.
HOT = 0.001
_NONE = hashlib.sha256(b"").hexdigest()


def _short(value: Column) -> Column:
    """128 bits of the SHA-256 of a value."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _empty() -> Column:
    return F.unhex(F.lit(""))


def numbered(conversations: DataFrame) -> DataFrame:
    """The turns of each conversation in order: ``(conv_id, idx, n, symbol, size)``.

    ``idx`` counts from 0, ``n`` is the number of turns, ``symbol`` the digest
    of role and text, ``size`` the code points of the text. Turns of equal
    number follow by their symbol.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("tree"),
        F.col("turn").alias("_turn"),
        _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("symbol"),
        F.length(text).cast("long").alias("size"),
        # Splits turns that are the same in all else.
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    placed = in_order(written(turns, "trie-turns"), ["_turn", "symbol", "_salt"], "trie")
    return placed.select(F.col("tree").alias("conv_id"), "idx", "n", "symbol", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns with the first of their hundred, as ``(turns, conversations)``.

    Of ``numbered`` turns, conversation c takes the first h of conversation
    c - c % 100 and goes on with its own after its first h, where h is the
    remainder of the crc32 of its decimal by 6. Returned are ``(conv_id, depth,
    symbol, size)`` and ``(conv_id, length)``, in which turnless ones are, too.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = turns.where("idx = 0").select(
        "conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    )
    bases = turns.where("conv_id % 100 = 0 AND idx < 5")
    sizes = bases.where("idx = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(
        convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
            "conv_id", "base", "n", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
        ),
        "trie-conversations",
    )
    first = convs.join(bases.select(F.col("conv_id").alias("base"), "idx", "symbol", "size"), "base").where("idx < h")
    # A long conversation has a row for each block of its turns, so that no key of the join has more than a block.
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}")))).select(
        "conv_id", "block", "h", "taken"
    )
    own = turns.withColumn("block", F.expr(f"idx div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("idx >= h")
    made = first.select("conv_id", (F.col("idx") + 1).alias("depth"), "symbol", "size").unionByName(
        own.select("conv_id", (F.col("idx") - F.col("h") + F.col("taken") + 1).alias("depth"), "symbol", "size")
    )
    return written(made, "trie-rebuilt"), convs.select("conv_id", "length")


def _block_digests(turns: DataFrame, height: int) -> list[DataFrame]:
    """For k from 1 to ``height``, the blocks of 2^k depths: ``(conv_id, j, left, right, whole)``, digests of halves and whole.

    Missing right halves are null. A block's digest tells how far it is filled.
    """
    below = turns.select("conv_id", (F.col("depth") - 1).alias("j"), F.col("symbol").alias("whole"))
    levels = []
    for k in range(1, height + 1):
        halves = below.groupBy("conv_id", F.shiftright("j", 1).alias("up")).agg(
            F.max(F.when(F.col("j") % 2 == 0, F.col("whole"))).alias("left"),
            F.max(F.when(F.col("j") % 2 == 1, F.col("whole"))).alias("right"),
        )
        blocks = halves.withColumn("whole", _short(F.concat("left", F.coalesce("right", _empty())))).withColumnRenamed("up", "j")
        levels.append(written(blocks, f"trie-blocks{k}"))
        below = levels[-1].select("conv_id", "j", "whole")
    return levels


def _named(sequences: DataFrame, levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Names on the way of each of ``sequences`` ``(conv_id, copies)``: ``(conv_id, depth, name, parent, size, copies)``.

    From the whole down, every block is cut at half; the name of the cut is the
    start of the right half and the end of the left one.
    """
    rows = sequences.select(
        "conv_id", F.lit(0).cast("long").alias("j"), "copies", _empty().alias("start"), F.lit(None).cast("binary").alias("end")
    )
    for blocks in reversed(levels):
        cut = rows.join(blocks.drop("whole"), ["conv_id", "j"]).withColumn("cut", _short(F.concat("start", "left")))
        half = lambda j, start, end: F.struct(j.alias("j"), F.col(start).alias("start"), F.col(end).alias("end"))
        upper = half(2 * F.col("j"), "start", "cut")
        lower = F.when(F.col("right").isNotNull(), half(2 * F.col("j") + 1, "cut", "end"))
        rows = cut.select("conv_id", "copies", F.inline(F.array_compact(F.array(upper, lower))))
    named = rows.select(
        "conv_id", (F.col("j") + 1).alias("depth"), F.col("end").alias("name"), F.col("start").alias("parent"), "copies"
    )
    return named.join(turns.select("conv_id", "depth", "size"), ["conv_id", "depth"])


def _hash_ends(members: DataFrame) -> DataFrame:
    """Per ``whole`` the SHA-256 of its conv_ids, ascending and joined by commas: ``(whole, ends_sha256)``.

    A hash is sequential, so one task must see each sequence's ids. It gets
    them as runs of up to ``RUN`` ids joined where a sort by ranges left them,
    and holds a hash and one run.
    """
    n = partitions(members.sparkSession)

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, first, ids = None, None, []

        def row(found: list) -> None:
            found.append({"whole": whole, "first": first, "ids": ",".join(ids)})

        schema = pa.schema([("whole", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            found: list[dict] = []
            for w, c in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and (w != whole or len(ids) == RUN):
                    row(found)
                    ids = []
                if not ids:
                    whole, first = w, c
                ids.append(str(c))
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if ids:
            found = []
            row(found)
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, state = None, None
        schema = pa.schema([("whole", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            found = []
            for w, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if w != whole or state is None:
                    if state is not None:
                        found.append({"whole": whole, "ends_sha256": state.hexdigest()})
                    whole, state = w, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"whole": whole, "ends_sha256": state.hexdigest()}], schema=schema)

    runs = (
        members.select("whole", "conv_id").repartitionByRange(n, "whole", "conv_id")
        .sortWithinPartitions("whole", "conv_id").mapInArrow(join_runs, "whole binary, first long, ids string")
    )
    together = runs.repartition(n, "whole").sortWithinPartitions("whole", "first")
    return together.mapInArrow(hash_runs, "whole binary, ends_sha256 string")


def _with_parents(nodes: DataFrame, total: int) -> DataFrame:
    """Add ``parent_conv_id``, the least member of the parent; the first turns have the root's, which is set later.

    The few nodes with very many children are sent to all tasks, the others are
    joined by name.
    """
    known = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > total * HOT
    hot, others = known.where(many).drop("n_children"), known.where(~many).drop("n_children")
    below = nodes.where("depth > 1").join(F.broadcast(hot), ["depth", "parent"], "left")
    found = below.where("parent_conv_id IS NOT NULL")
    rest = below.where("parent_conv_id IS NULL").drop("parent_conv_id").join(others, ["depth", "parent"])
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return top.unionByName(found).unionByName(rest)


def _grafts(nodes: DataFrame, path: DataFrame, deepest: int) -> list[DataFrame]:
    """Parts of ``(depth, name, parent, n_leaves, saved_tokens)`` whose sums are the totals of subtrees.

    At round k the blocks of 2^k depths are put together: each node at a cut
    sums what its children have by then in their half, and the nodes on the
    path from the block's start to the cut each get that sum.
    """
    values = ["n_leaves", "saved_tokens"]
    parts = [nodes.select("depth", "name", "parent", *values)]
    k = 1
    while 2 ** (k - 1) < deepest:
        half = 2 ** (k - 1)
        below = None
        for part in parts:
            rows = part.where((F.col("depth") - 1) % (2 * half) == half)
            below = rows if below is None else below.unionByName(rows)
        cuts = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(*(F.sum(v).alias(v) for v in values))
        known = nodes.where(F.col("depth") % (2 * half) == half).select("depth", "name", "conv_id")
        ways = cuts.join(known, ["depth", "name"]).select(
            "conv_id", F.explode(F.sequence(F.col("depth") - half + 1, F.col("depth"))).alias("depth"), *values
        )
        grown = ways.join(path.select("conv_id", "depth", "name", "parent"), ["conv_id", "depth"])
        parts.append(written(grown.groupBy("depth", "name", "parent").agg(*(F.sum(v).alias(v) for v in values)), f"trie-graft{k}"))
        k += 1
    return parts


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    ``turns`` are ``(conv_id, depth, symbol, size)`` with depths from 1 without
    gaps, ``conversations`` ``(conv_id, length)``, each once. A node has the
    conversations that begin with its sequence as members; it is named by the
    least of them and its depth. ``saved_tokens`` is the size a cache of
    prefixes saves below it: that of each node's last turn for all members but
    one. Without conversations there is no node, not even the root.
    """
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    levels = _block_digests(turns, max(1, int(deepest).bit_length()))
    wholes = levels[-1].select("conv_id", "whole")
    members = written(
        conversations.join(wholes, "conv_id", "left").select("conv_id", "length", F.coalesce("whole", _empty()).alias("whole")),
        "trie-members",
    )
    sequences = written(
        members.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.max("length").alias("length"))
        .join(_hash_ends(members), "whole"),
        "trie-sequences",
    )
    path = written(_named(sequences.where("length > 0"), levels, turns), "trie-path")
    first = path.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max("size").alias("size"), F.max("parent").alias("parent")
    )
    first = written(first, "trie-names")
    children = first.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    counted = first.join(children, ["depth", "name"], "left").fillna(0, ["n_children"])
    nodes = written(
        counted.withColumns(
            {
                "n_leaves": (F.col("n_children") == 0).cast("long"),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("size"),
            }
        ),
        "trie-nodes",
    )
    total = nodes.count()
    parts = _grafts(nodes, path, deepest)
    summed = parts[0]
    for part in parts[1:]:
        summed = summed.unionByName(part)
    totals = written(
        summed.groupBy("depth", "name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")),
        "trie-totals",
    )
    ended = sequences.where("length > 0").select("conv_id", F.col("length").alias("depth"), "ends_sha256")
    ends = ended.join(path.select("conv_id", "depth", "name"), ["conv_id", "depth"]).select("depth", "name", "ends_sha256")
    least = conversations.agg(F.min("conv_id")).first()[0]
    below = (
        _with_parents(nodes.drop("n_leaves", "saved_tokens"), total)
        .join(totals, ["depth", "name"])
        .join(ends, ["depth", "name"], "left")
        .select(
            "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(least).cast("long")).alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        )
    )

    # The root sums up conversations, first turns and those that have none.
    nothing = F.lit(None).cast("long")
    facts = (
        conversations.select("conv_id", F.lit(1).cast("long").alias("n_convs"), nothing.alias("child"), nothing.alias("leaves"), nothing.alias("saved"), F.lit(None).cast("string").alias("ends"))
        .unionByName(totals.where("depth = 1").select(nothing.alias("conv_id"), nothing.alias("n_convs"), F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends")))
        .unionByName(sequences.where("length = 0").select(nothing.alias("conv_id"), nothing.alias("n_convs"), nothing.alias("child"), nothing.alias("leaves"), nothing.alias("saved"), F.col("ends_sha256").alias("ends")))
    )
    root = facts.agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("child").alias("n_children"),
        F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(_NONE)).alias("ends_sha256"),
    ).where("conv_id IS NOT NULL")
    root = root.withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", nothing)
    return root.select(*below.columns).unionByName(below)


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt ``conversations``, with the digest of the members that end at each node.

    Rows are ordered by ``turn``, a null one first, equal ones by the digest of
    role and text; a null role or text is empty. Rows that repeat are turns of
    their own. A row without a ``conv_id`` belongs to no conversation and takes
    no part. An empty table gives no rows. Other columns are not read,
    whatever they are called, and texts enter whole, as digests and sizes.
    """
    return prefix_trie(*rebuilt(numbered(conversations)))
