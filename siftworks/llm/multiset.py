"""Homomorphic multiset fingerprints with Spark expressions only.

A text is a multiset of paragraph parts (runs of up to eight words of a line). Each part is hashed to a wide vector, and the
fingerprint is the sum of the vectors modulo powers of two, so it depends neither on the order of the parts nor on
the order in which they are added, and a part can be inserted or deleted by adding or subtracting its vector:

- the number of parts and eight lanes modulo 2**32, to which every part adds: these tell multisets apart;
- ``LEVELS`` x ``LANES`` lanes modulo 2**8, of which a part adds to one. Its level is taken by every second part of those
  left, so that lanes that differ between two fingerprints tell how many parts differ, for short and long texts alike.

Likeness is the estimated share of common parts: (all - different) / (all + different).

Edge cases: a null text counts as empty; texts without a word have the zero fingerprint; a document's next one is the
following row by doc_id (nulls last, ties by text), the last one's is the first; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.shared import shuffle_partitions

PART_WORDS = 8
PARTS = rf"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){{1,{PART_WORDS}}}"
DENSE = 8
#: As many as the hash bits that choose a level; differences of tens of millions of parts still leave one usable.
LEVELS = 20
LANES = 32
#: A level with more differing lanes than this tells too little and is left to the next.
FULL = 24
RANGES_PER_PARTITION = 2
_LOW = 0xFFFFFFFF


def _vector_columns(part: Column) -> list[Column]:
    """slot int (which small lane), small long (what it adds), d0..d7 long: what one part adds."""
    h = [F.xxhash64(part, F.lit(salt)) for salt in range(DENSE // 2)]
    first = F.xxhash64(part)
    level = F.least(F.bit_count(first.bitwiseAND(-(first.bitwiseAND(F.lit((1 << LEVELS) - 1)))).bitwiseAND(F.lit((1 << LEVELS) - 1)) - 1), F.lit(LEVELS - 1))
    lane = F.pmod(F.shiftrightunsigned(first, 24), F.lit(LANES))
    small = F.shiftrightunsigned(first, 40).bitwiseAND(F.lit(255)).bitwiseOR(F.lit(1))
    dense = [x for v in h for x in (v.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(v, 32))]
    return [(level * LANES + lane).cast("int").alias("slot"), small.cast("long").alias("small"), *(d.alias(f"d{i}") for i, d in enumerate(dense))]


def parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))


def fingerprint_columns(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """``keys`` and, for each array<string> column of parts, a struct (n long, dense array<long>, cells array<int>).

    cells are the small lanes that aren't zero, ascending: 256 times the lane's number, and its value.

    ``rows`` must be dealt by a part of ``keys`` already, or they are shuffled: one row per part and lane at most.
    """
    def tag(i: int, a: str) -> Column:
        return F.transform(a, lambda p: F.struct(F.lit(i).alias("which"), p.alias("part")))

    tagged = F.flatten(F.array(*[tag(i, a) for i, a in enumerate(arrays)]))
    exploded = rows.select(*keys, F.explode_outer(tagged).alias("p")).select(*keys, "p.which", *_vector_columns(F.col("p.part")), F.col("p.part").isNotNull().alias("real"))
    dense = [f"d{i}" for i in range(DENSE)]
    by_slot = exploded.groupBy(*keys, "which", "slot").agg(F.count_if("real").alias("n"), F.sum("small").alias("small"), *[F.sum(d).alias(d) for d in dense])
    of = lambda i, c: F.coalesce(F.sum(F.when(F.col("which") == i, F.col(c))), F.lit(0))
    cells = lambda i: F.array_sort(F.collect_list(F.when((F.col("which") == i) & (F.col("small") % 256 != 0), (F.col("slot") * 256 + F.col("small") % 256).cast("int"))))
    return by_slot.groupBy(*keys).agg(
        *[F.struct(of(i, "n").alias("n"), F.array(*[of(i, d) % (1 << 32) for d in dense]).alias("dense"), cells(i).alias("cells")).alias(a) for i, a in enumerate(arrays)]
    )


def to_hex(fp: Column) -> Column:
    word = lambda x, digits: F.lower(F.lpad(F.hex(x), digits, "0"))
    return F.concat(
        word(fp["n"].bitwiseAND(F.lit(_LOW)), 8),
        F.array_join(F.transform(fp["dense"], lambda x: word(x, 8)), ""),
        F.array_join(F.transform(fp["cells"], lambda x: word(x.cast("long"), 5)), ""),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common parts of two fingerprints, 0 to 1; 1 only for equal fingerprints."""
    lanes = F.array_distinct(F.transform(F.concat(F.array_except(a["cells"], b["cells"]), F.array_except(b["cells"], a["cells"])), lambda x: F.shiftright(x, 8)))
    # in an array of one, so that the differing lanes are found once
    per_level = F.element_at(
        F.transform(F.array(lanes), lambda x: F.transform(F.sequence(F.lit(LEVELS - 1), F.lit(0)), lambda j: F.size(F.filter(x, lambda k: F.floor(k / LANES) == j)))), 1
    )
    start = F.struct(F.lit(True).alias("open"), F.lit(0.0).alias("sum"), F.lit(float(1 << LEVELS)).alias("times"))

    def add(acc: Column, d: Column) -> Column:
        usable = acc["open"] & (d <= FULL)
        more = -LANES * F.log(1 - F.least(d, F.lit(LANES - 1)) / LANES)
        return F.struct(
            usable.alias("open"), F.when(usable, acc["sum"] + more).otherwise(acc["sum"]).alias("sum"), F.when(usable, acc["times"] / 2).otherwise(acc["times"]).alias("times")
        )

    found = F.aggregate(per_level, start, add)
    total = (a["n"] + b["n"]).cast("double")
    nothing = found["times"] == float(1 << LEVELS)
    different = F.when(nothing, total).otherwise(F.greatest(found["sum"] * found["times"], F.lit(1.0)))
    same = (a["n"] == b["n"]) & (a["dense"] == b["dense"])
    return F.when(same, F.lit(1.0)).otherwise(F.greatest((total - different) / (total + different), F.lit(0.0)))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, rn, doc_id, text, next_text, guard) per row of ``docs``; one exchange of the texts.

    Rows are dealt into ranges of doc_id whose first ids are known (a few per shuffle partition, found by approximate
    quantiles: the only values that reach the driver). The first row of a range is dealt to the range before it
    too, as a guard, and the very first row to the last range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, RANGES_PER_PARTITION * shuffle_partitions(docs.sparkSession))
    marks = [i / n for i in range(1, n)] or [0.5]
    found = rows.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", marks, 100 * n).alias("edges")).first()
    least = found["least"]
    edges = sorted({e for e in found["edges"] or [] if e > least})
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= F.col("doc_id"))), F.lit(len(edges))) if edges else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(bucket)
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(0).alias("guard"))
    before = F.struct((bucket - 1).cast("int").alias("bucket"), F.lit(1).alias("guard"))
    last = F.struct(F.lit(len(edges)).cast("int").alias("bucket"), F.lit(1).alias("guard"))
    first_of_all = F.col("doc_id") == F.lit(least).cast("long") if least is not None else F.col("doc_id").isNull()
    copies = F.when(first_of_all, F.array(own, last)).when(F.col("doc_id").isin(edges), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.select(F.explode(copies).alias("to"), "doc_id", "text").select("to.bucket", "to.guard", "doc_id", "text")
    w = Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and both likenesses.

    The edited text has the last quarter (rounded down) of the code points replaced by as many first ones of the next document.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - k), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    texts = rows.select("bucket", "guard", "rn", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    cut = texts.select("bucket", "guard", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), parts(F.col("text")).alias("own"), parts(F.col("edited")).alias("other"))
    prints = fingerprint_columns(cut, ["bucket", "guard", "rn", "doc_id", "n_chars", "edited_sha256"], ["own", "other"])
    near = Window.partitionBy("bucket").orderBy("rn")
    out = prints.withColumn("following", F.lead("own").over(near)).filter("guard = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("own")).alias("fingerprint"), to_hex(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
