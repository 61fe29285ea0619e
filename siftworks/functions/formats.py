"""Answers as text: counts, percents, averages and signed differences, with fixed texts for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.operators import analysis
from siftworks.shared import materialize

MISSING = "N/A"


def count_text(c: Column) -> Column:
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("0"))


def average_text(c: Column) -> Column:
    """Two places, rounded half-up, no thousands separators."""
    return F.coalesce(F.round(c.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string"), F.lit(MISSING))


def percent_text(c: Column) -> Column:
    return F.when(c.isNull(), MISSING).otherwise(F.concat(average_text(c), F.lit("%")))


def average_with_count(c: Column, n: Column) -> Column:
    return F.concat(average_text(c), F.lit(" (n = "), count_text(n), F.lit(")"))


def long_time(c: Column) -> Column:
    """A time as "October 05, 2026 at 06:00:00 PM UTC"."""
    return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "MMMM dd, yyyy 'at' hh:mm:ss a"), F.lit(" UTC"))


def difference_text(c: Column) -> Column:
    n = F.coalesce(c.cast("long"), F.lit(0))
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def format_answers(t: DataFrame) -> DataFrame:
    """(number, label, value) of every scalar answer, from one scan."""
    return analysis.scalar_answers(t).select(F.inline(_lines()))


def _lines() -> Column:
    """Every scalar answer of a row of ``analysis.scalar_answers``, in order."""
    c = F.col
    lines = [
        (1, "Fall 2026 entries", count_text(c("q01_fall_2026_entries"))),
        (2, "Percent international", percent_text(c("q02_percent_international"))),
        (2, "International entries", count_text(c("q02_international_entries"))),
        (2, "Classified entries", count_text(c("q02_classified_entries"))),
        (3, "Average GPA", average_with_count(c("q03_avg_gpa"), c("q03_gpa_n"))),
        (3, "Average GRE Quantitative", average_with_count(c("q03_avg_gre_quant"), c("q03_gre_quant_n"))),
        (3, "Average GRE Verbal", average_with_count(c("q03_avg_gre_verbal"), c("q03_gre_verbal_n"))),
        (3, "Average GRE Analytical Writing", average_with_count(c("q03_avg_gre_aw"), c("q03_gre_aw_n"))),
        (4, "Average GPA, American, Fall 2026", average_with_count(c("q04_avg_gpa"), c("q04_applicants_with_gpa"))),
        (5, "Fall 2025 acceptances", percent_text(c("q05_acceptance_percent"))),
        (6, "Average GPA, accepted, Fall 2026", average_with_count(c("q06_avg_gpa"), c("q06_applicants_with_gpa"))),
        (7, "Johns Hopkins computer science masters entries", count_text(c("q07_jhu_cs_masters_entries"))),
        (8, "Accepted computer science PhD entries", count_text(c("q08_accepted_cs_phd_entries"))),
        (9, "Count on standardized fields", count_text(c("q09_llm_field_count"))),
        (9, "Difference", difference_text(c("q09_difference"))),
    ]
    return F.array(*[F.struct(F.lit(n).alias("number"), F.lit(label).alias("label"), v.alias("value")) for n, label, v in lines])


def snapshot_payload(t: DataFrame) -> DataFrame:
    """One row: payload, a JSON text of the summary and of all answers: number, lines (label, value), columns and table, lists of texts (nulls as the missing text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    # written down: the rows are read once
    scalars, *tables = analysis.answers_of_cells(materialize(analysis.answer_cells(t), "answers"))
    scalars = scalars.select("total_entries", "newest_entry", _lines().alias("said"))
    lines = lambda n: F.transform(F.filter("said", lambda x: x["number"] == n), lambda x: F.array(x["label"], x["value"]))
    answer = lambda n, lines, columns, table: F.struct(F.lit(n).alias("number"), lines.alias("lines"), columns.alias("columns"), table.alias("table"))
    none, no_rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    whole = scalars.select("total_entries", "newest_entry", *[answer(n, lines(n), none, no_rows).alias(f"a{n}") for n in range(1, 10)])
    for n, df in zip((10, 11), tables, strict=True):  # few rows, in order
        table = df.select(F.array(*map(text, df.columns)).alias("cells")).agg(F.collect_list("cells").alias("table"))
        whole = whole.crossJoin(table.select(answer(n, no_rows, F.array(*map(F.lit, df.columns)), F.col("table")).alias(f"a{n}")))  # one row each
    summary = F.struct("total_entries", F.col("newest_entry").cast("string").alias("newest_entry"))
    return whole.select(F.to_json(F.struct(summary.alias("summary"), F.array(*[f"a{n}" for n in range(1, 12)]).alias("answers"))).alias("payload"))
