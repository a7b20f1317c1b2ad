"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words, and each of its documents a number
of copies to be expected: documents of at least ``LONG_WORDS`` words twice as
many as shorter ones, which are more often fragments, up to the most copies.
Whole copies are certain. What is left over is the document's inclusion
probability in a sample: documents are ranked by their random odds divided by
their inclusion odds, and the first ones are taken until the source has its
size. The unit of that size is the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitpath.llm.common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
LONG_WORDS, LONG_WEIGHT = 100, 2
BUCKETS = 4096
_SLACK = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_odds(doc_id: str, seed: int) -> Column:
    """Odds of a uniform number made from 52 bits of a hash of the id, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return u / (1 - u)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """Target words of each source from ``(source, source_size)``.

    Sources in code-point order, null last, have the weights in turn and share
    all words by weight. A target stops at ``cap`` times the source's size; the
    excess is shared among the others until none is above. In order of size per
    weight the stopped sources come first, so running sums find them. The table
    has a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.array(*(F.lit(w) for w in weights))
    given = sizes.select(
        "source", "source_size", F.get(choice, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).alias("w")
    ).withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    tried = given.withColumn(
        "share",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), zero))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)),
    ).withColumn("stopped", F.col("most") < F.col("w") * F.col("share"))
    level = F.min_by(F.when(~F.col("stopped"), F.col("share")), F.when(~F.col("stopped"), F.col("most") / F.col("w")))
    return tried.withColumn("level", level.over(everything)).select(
        "source",
        "source_size",
        F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"),
    )


def _is_long() -> Column:
    return F.col("size") >= LONG_WORDS


def _expected(sources: DataFrame, cap: int) -> DataFrame:
    """Whole copies and the probability of one more, for the long and the short documents of each source.

    Long documents count ``LONG_WEIGHT`` times until they have the most
    copies; short ones share the words that are left.
    """
    short = F.col("source_size") - F.col("long_size")
    weighted = LONG_WEIGHT * F.col("long_size") + short
    long_ = F.when(
        F.col("source_size") > 0, F.least(F.lit(float(cap)), LONG_WEIGHT * (F.col("target") / weighted))
    ).otherwise(F.lit(0.0))
    sources = sources.withColumn("long", long_)
    rest = F.when(
        short > 0, F.least(F.lit(float(cap)), (F.col("target") - F.col("long") * F.col("long_size")) / short)
    ).otherwise(F.lit(0.0))
    sources = sources.withColumn("short", rest)
    for name in ("long", "short"):
        sources = sources.withColumn(f"whole_{name}", F.floor(F.col(name) + _SLACK).cast("int"))
        over = F.col(name) - F.col(f"whole_{name}")
        sources = sources.withColumn(f"left_{name}", F.when(over > _SLACK, over).otherwise(F.lit(0.0)))
    sure = F.col("whole_long") * F.col("long_size") + F.col("whole_short") * short
    return sources.withColumn("wanted", F.col("target") - sure).drop("long", "short")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """One row per source: target, whole copies, probabilities of one more, and where the ranking is cut.

    The cut of a source is found without bringing its documents together:
    words are summed by source and bucket of the rank, running sums find the
    bucket in which the source becomes full, and only that bucket's documents
    are ordered. Equal ranks are taken together. The cut is the one nearest to
    the target.
    """
    rows = written(
        docs.select("source", word_count().alias("size"), random_odds("doc_id", seed).alias("odds")), "mixing"
    )
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.when(_is_long(), F.col("size")).otherwise(F.lit(0))).alias("long_size")
    )
    aimed = targets(sizes.select("source", "source_size"), weights, cap).withColumnRenamed("source", "s")
    sources = written(
        _expected(
            aimed.join(sizes.select("source", "long_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), cap
        ),
        "mixing-sources",
    )
    open_ = sources.where("left_long > 0 OR left_short > 0").select(
        F.col("source").alias("s"), "left_long", "left_short", "wanted"
    )
    left = F.when(_is_long(), F.col("left_long")).otherwise(F.col("left_short"))
    ranked = rows.join(open_, F.col("source").eqNullSafe(F.col("s"))).where(left > 0).select(
        "source", "size", "wanted", rank(F.col("odds"), left).alias("rank")
    ).withColumn("bucket", bucket(F.col("rank")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    full = (
        ranked.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
        .withColumn("upto", F.sum("words").over(running))
        .where("upto >= wanted AND upto - words < wanted")
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("upto") - F.col("words")).alias("had"))
    )
    inside = ranked.join(full, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    upto = F.col("had") + F.sum("size").over(
        Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    )
    cuts = (
        inside.withColumn("off", F.abs(upto - F.col("wanted")))
        .groupBy("source")
        .agg(
            F.min(F.struct("off", "rank")).alias("best"),
            F.first("bucket").alias("bucket"),
            F.first(F.abs(F.col("had") - F.col("wanted"))).alias("none"),
        )
        .select(
            F.col("source").alias("s"),
            F.col("bucket").alias("cut_bucket"),
            F.when(F.col("best.off") < F.col("none"), F.col("best.rank")).otherwise(F.lit(-1.0)).alias("cut_rank"),
        )
    )
    return written(
        sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mixing-plan"
    )


def rank(odds: Column, left: Column) -> Column:
    """Random odds by inclusion odds; null where nothing is left to be drawn."""
    return F.try_divide(odds, left / (1 - left))


def bucket(value: Column) -> Column:
    return F.floor(value / (1 + value) * BUCKETS).cast("int")


def copies(planned: DataFrame, odds: Column, size: Column) -> Column:
    """How often a document joined with its source's plan is taken."""
    whole, left = (
        F.when(size >= LONG_WORDS, planned[f"{name}_long"]).otherwise(planned[f"{name}_short"]) for name in ("whole", "left")
    )
    value = rank(odds, left)
    first = (bucket(value) < planned["cut_bucket"]) | (
        (bucket(value) == planned["cut_bucket"]) & (value <= planned["cut_rank"])
    )
    return whole + F.when((left > 0) & F.coalesce(first, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """Every row with its size, its source's size and target, and the words the mix takes of it.

    A null text has size 0 and a null source is a source. Rows that repeat an
    id share its random number and are taken alike. The plan has one row per
    source and is joined by source, so a hot source is no hot key of a shuffle
    while the plan is small, and of a join that can be split beyond.
    """
    p = plan(docs, weights, cap, seed)
    rows = docs.select(
        "doc_id", F.col("source").alias("_source"), word_count().alias("size"), random_odds("doc_id", seed).alias("odds")
    )
    joined = rows.join(p, F.col("_source").eqNullSafe(p["source"]))
    return joined.withColumn("copies", copies(p, F.col("odds"), F.col("size"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with the columns of ``docs``.

    Nulls, repeated ids and names are treated as by :func:`mix`; an empty table
    gives an empty mix, and all columns of the rows stay, whatever they are called.
    """
    p = plan(docs, weights, cap, seed)
    p = p.select(*(F.col(c).alias(f"_mix_{c}") for c in p.columns))
    named = {c.removeprefix("_mix_"): p[c] for c in p.columns}
    # Counted below the join, so once a text.
    size, number = (free_name(docs.columns, name) for name in ("_words", "_copy"))
    sized = docs.withColumn(size, word_count())
    joined = sized.join(p, sized["source"].eqNullSafe(named["source"]))
    times = F.array_repeat(F.lit(0), copies(named, random_odds("doc_id", seed), sized[size]))
    return joined.select(*(sized[c] for c in docs.columns), F.explode(times).alias(number)).drop(number)
