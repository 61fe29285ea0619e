"""Mixing sources to target weights by hash-threshold histograms, with Spark expressions only.

A document's size is its number of words. Each source gets a target: its weight's share of all words, but at most
``MAX_REPEAT`` times its own; what is above is shared again by weight. A source takes every document as often as the target
holds its whole size, and once more those whose hash is below a threshold. The threshold is found without sorting
documents: sizes are summed by source and hash bucket, the bucket in which the budget ends is cut into finer buckets,
three times over, and the last one is taken or left, whichever is nearer. A smaller budget takes a part
of what a larger one takes.

Edge cases: null texts have size 0; a null source is a source of its own, last in order; rows equal in id and text share a hash and
are taken or left together, rows without an id only if their texts are equal; an empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.shared import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Bits of the hash that each of the three histograms looks at.
STEP_BITS = 12
WORDS = r"[^\x20\x09-\x0D]+"


def key_hash(key: Column) -> Column:
    """36 bits of the MD5 of a string key; a null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def source_key() -> Column:
    """A key of the source that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def row_key() -> Column:
    """A key of id and text: rows without an id are told apart by their texts."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))


def word_sizes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, source, skey, size, h) per row; h is the hash of ``key`` (``row_key`` if it is not given)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        source_key().alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        key_hash(row_key() if key is None else key).alias("h"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(skey, source_size long, target double, copies long, budget double): one row per source.

    Sources by ascending cap per weight: the level at which each would fill rises while sources are capped and falls
    after that, so its maximum is the level that holds.
    """
    totals = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    ranked = totals.withColumn("weight", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least("cap", F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        filled.withColumn("target", target)
        .withColumn("copies", copies)
        .select("skey", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    )


def hash_thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(skey, threshold long): documents with h below it hold about ``budget`` words (budgets: skey, budget double)."""
    found = budgets.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for step in range(3):
        shift = 36 - STEP_BITS * (step + 1)
        inside = sizes if step == 0 else sizes.join(found.select("skey", "prefix"), "skey").filter(
            F.shiftright("h", shift + STEP_BITS) == F.col("prefix")
        )
        sums = inside.groupBy("skey", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("skey").orderBy("cell")
        cells = sums.join(found, "skey").withColumn("upto", F.col("below") + F.sum("words").over(running))
        # the first bucket in which the budget is passed; the last one if it never is
        best = F.min_by(F.struct("budget", "cell", "words", "upto"), F.struct(F.col("upto") <= F.col("budget"), F.when(F.col("upto") > F.col("budget"), F.col("cell")).otherwise(-F.col("cell"))))
        found = cells.groupBy("skey").agg(best.alias("b")).select(
            "skey", "b.budget", F.col("b.cell").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("below"), F.col("b.upto").alias("upto")
        )
    nearer = F.abs(F.col("upto") - F.col("budget")) < F.abs(F.col("budget") - F.col("below"))
    return found.select("skey", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def source_limits(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(skey, source_size, target, copies, budget, threshold): one row per source."""
    targets = materialize(source_targets(sizes, weights, max_repeat), "mix-targets")
    return targets.join(hash_thresholds(sizes, targets.select("skey", "budget")), "skey")


def times_taken() -> Column:
    """How often a row with hash h is taken, beside the limits of its source."""
    return F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken."""
    sizes = materialize(word_sizes(docs), "mix-sizes")
    return sizes.join(source_limits(sizes, weights, max_repeat), "skey").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"), times_taken().alias("times")
    )


def repeat_rows(docs: DataFrame, key: Column, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, text, ...) as often as the mix takes it; rows are chosen by the hash of ``key``."""
    limits = materialize(source_limits(materialize(word_sizes(docs, key), "mix-sizes"), weights, max_repeat), "mix-limits")
    # the row as one value, so that no column of it meets the names used here
    held = docs.select(F.struct("*").alias("row"), source_key().alias("skey"), key_hash(key).alias("h")).join(limits.select("skey", "copies", "threshold"), "skey")
    return held.select("row", F.explode(F.array_repeat(F.lit(1), times_taken().cast("int")))).select("row.*")
