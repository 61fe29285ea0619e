"""Idempotent loads: first record wins within a batch, stored rows are never overwritten, keyed rows are replaced whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.operators.cleaning import record_to_row


#: The table of applicants.
ROW_SCHEMA = (
    "p_id int, program string, comments string, date_added date, url string, status string, term string, us_or_international string, "
    "gpa double, gre double, gre_v double, gre_aw double, degree string, llm_generated_program string, llm_generated_university string"
)


def dedupe_first(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of rows with one key the one with the smallest ``sequence``. Rows with a null key all stay."""
    return first_of_key(batch, key, sequence).unionByName(batch.filter(F.col(key).isNull()))


def first_of_key(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of rows with one key the one with the smallest ``sequence``. Rows with a null key go."""
    # an aggregate before the shuffle keeps a hot key small
    keyed = batch.filter(F.col(key).isNotNull())
    columns = [c for c in batch.columns if c != key]
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*columns), sequence).alias("_row"))
    return first.select(key, "_row.*").select(*batch.columns)


def insert_new(stored: DataFrame, batch: DataFrame, key: str = "p_id") -> DataFrame:
    """The rows of ``batch`` whose key isn't stored."""
    return batch.join(stored.select(key), key, "left_anti")


def upsert_keyed(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``changes`` (one per key) in place of those with the same key."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes)


@dataclass(frozen=True)
class Load:
    """New rows of a batch, and one row of counts: inserted, present, unusable."""

    rows: DataFrame
    counts: DataFrame


def load_records(stored: DataFrame, records: DataFrame, sequence: str) -> Load:
    """Records to rows, the first of each id by ``sequence``, without those stored.

    An id beyond 32 bits fails the load when it runs.
    """
    staged = record_to_row(records, sequence)
    usable = dedupe_first(staged.filter("p_id is not null"), "p_id", sequence).drop(sequence)
    marked = usable.join(stored.select("p_id", F.lit(True).alias("_stored")).distinct(), "p_id", "left")
    seen = marked.select(F.col("_stored").isNull().alias("new"), F.lit(False).alias("bad"))
    unusable = staged.filter("p_id is null").select(F.lit(False).alias("new"), F.lit(True).alias("bad"))
    counts = seen.unionByName(unusable).agg(
        F.count_if("new").alias("inserted"), F.count_if(~F.col("new") & ~F.col("bad")).alias("present"), F.count_if("bad").alias("unusable")
    )
    return Load(marked.filter("_stored is null").drop("_stored"), counts)
