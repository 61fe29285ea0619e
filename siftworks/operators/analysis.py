"""The eleven analysis questions, the summary and the data notes. Each is one aggregate over the applicants table.

Rounded averages and percents are decimals rounded half-up, cast to double. An empty table gives counts of 0 and null
averages and percents; grouped questions then have no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.operators import predicates as p

MIN_DEGREE_ENTRIES = 100
TOP_UNIVERSITIES = 10
RESULT_LIMIT = 100


def rounded(c: Column) -> Column:
    return F.round(c.cast("decimal(38,10)"), 2).cast("double")


def mean(c: str, where: Column | None = None) -> Column:
    return rounded(F.avg(c if where is None else F.when(where, F.col(c))))


def percent(n: Column, of: Column) -> Column:
    return F.round(F.lit(100).cast("decimal(28,10)") * n / F.nullif(of, F.lit(0)), 2).cast("double")


def fall(year: int) -> Column:
    return p.equals("term", f"fall {year}")


def q01(t: DataFrame) -> DataFrame:
    return t.filter(fall(2026)).agg(F.count("*").alias("fall_2026_entries"))


def q02(t: DataFrame) -> DataFrame:
    n = F.count_if(p.equals("us_or_international", "international"))
    return t.filter(p.one_of("us_or_international", p.NATIONALITIES)).agg(
        n.alias("international_entries"), F.count("*").alias("classified_entries"), percent(n, F.count("*")).alias("percent_international")
    )


_METRICS = (
    ("gpa", "avg_gpa", "gpa_n", p.valid_gpa),
    ("gre", "avg_gre_quant", "gre_quant_n", lambda: p.valid_section("gre")),
    ("gre_v", "avg_gre_verbal", "gre_verbal_n", lambda: p.valid_section("gre_v")),
    ("gre_aw", "avg_gre_aw", "gre_aw_n", p.valid_writing),
)


def q03(t: DataFrame) -> DataFrame:
    return t.agg(*[x for c, avg, n, ok in _METRICS for x in (mean(c, ok()).alias(avg), F.count(F.when(ok(), F.col(c))).alias(n))])


def _gpa_of(t: DataFrame, where: Column) -> DataFrame:
    return t.filter(where & p.valid_gpa()).agg(mean("gpa").alias("avg_gpa"), F.count("gpa").alias("applicants_with_gpa"))


def q04(t: DataFrame) -> DataFrame:
    return _gpa_of(t, fall(2026) & p.equals("us_or_international", "american"))


def q05(t: DataFrame) -> DataFrame:
    n = F.count_if(p.accepted())
    return t.filter(fall(2025)).agg(n.alias("accepted_entries"), F.count("*").alias("fall_2025_entries"), percent(n, F.count("*")).alias("acceptance_percent"))


def q06(t: DataFrame) -> DataFrame:
    return _gpa_of(t, fall(2026) & p.accepted())


def q07(t: DataFrame) -> DataFrame:
    where = p.matches("program", p.JHU) & p.matches("program", p.COMPUTER_SCIENCE) & p.matches("degree", p.MASTERS)
    return t.filter(where).agg(F.count("*").alias("jhu_cs_masters_entries"))


def _accepted_phd() -> Column:
    return fall(2026) & p.accepted() & p.matches("degree", p.PHD)


def _cs_at_target(program: str, university: str) -> Column:
    return p.matches(program, p.COMPUTER_SCIENCE) & p.at_target_school(university)


def q08(t: DataFrame) -> DataFrame:
    return t.filter(_accepted_phd() & _cs_at_target("program", "program")).agg(F.count("*").alias("accepted_cs_phd_entries"))


def q09(t: DataFrame) -> DataFrame:
    original = F.count_if(_cs_at_target("program", "program"))
    standard = F.count_if(_cs_at_target("llm_generated_program", "llm_generated_university"))
    return t.filter(_accepted_phd()).agg(original.alias("original_field_count"), standard.alias("llm_field_count"), (standard - original).alias("difference"))


def q10(t: DataFrame) -> DataFrame:
    n = F.count_if(p.accepted())
    return (
        t.filter(fall(2026) & F.col("degree").isNotNull())
        .groupBy("degree")
        .agg(
            F.count("*").alias("entries"), n.alias("acceptances"), percent(n, F.count("*")).alias("acceptance_percent"),
            mean("gpa", p.accepted() & p.valid_gpa()).alias("avg_accepted_gpa"),
        )
        .filter(F.col("entries") >= MIN_DEGREE_ENTRIES)
        .orderBy(F.desc("entries"), "degree")
        .limit(RESULT_LIMIT)
    )


def q11(t: DataFrame) -> DataFrame:
    n = F.count_if(p.accepted())
    name = F.col("llm_generated_university")
    return (
        t.filter(fall(2026) & name.isNotNull() & (name != "Unknown"))
        .groupBy(name.alias("university"))
        .agg(F.count("*").alias("entries"), n.alias("acceptances"), percent(n, F.count("*")).alias("acceptance_percent"))
        .orderBy(F.desc("entries"), "university")
        .limit(TOP_UNIVERSITIES)
    )


QUESTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "q01": q01, "q02": q02, "q03": q03, "q04": q04, "q05": q05, "q06": q06, "q07": q07, "q08": q08, "q09": q09, "q10": q10, "q11": q11,
}


def scalar_answers(t: DataFrame) -> DataFrame:
    """q01 to q09 from one scan: one row, the questions' columns prefixed by their key."""
    count_where = lambda w: F.count_if(w)
    f26, f25, acc = fall(2026), fall(2025), p.accepted()
    classified = p.one_of("us_or_international", p.NATIONALITIES)
    phd, gpa = _accepted_phd(), p.valid_gpa()
    american = f26 & p.equals("us_or_international", "american") & gpa
    inter, n2 = count_where(p.equals("us_or_international", "international")), count_where(classified)
    n5, d5 = count_where(f25 & acc), count_where(f25)
    jhu = p.matches("program", p.JHU) & p.matches("program", p.COMPUTER_SCIENCE) & p.matches("degree", p.MASTERS)
    original, standard = phd & _cs_at_target("program", "program"), phd & _cs_at_target("llm_generated_program", "llm_generated_university")
    metrics = [x for c, avg, n, ok in _METRICS for x in (mean(c, ok()).alias(f"q03_{avg}"), F.count(F.when(ok(), F.col(c))).alias(f"q03_{n}"))]
    return t.agg(
        count_where(f26).alias("q01_fall_2026_entries"),
        inter.alias("q02_international_entries"), n2.alias("q02_classified_entries"), percent(inter, n2).alias("q02_percent_international"),
        *metrics,
        mean("gpa", american).alias("q04_avg_gpa"), count_where(american).alias("q04_applicants_with_gpa"),
        n5.alias("q05_accepted_entries"), d5.alias("q05_fall_2025_entries"), percent(n5, d5).alias("q05_acceptance_percent"),
        mean("gpa", f26 & acc & gpa).alias("q06_avg_gpa"), count_where(f26 & acc & gpa).alias("q06_applicants_with_gpa"),
        count_where(jhu).alias("q07_jhu_cs_masters_entries"),
        count_where(original).alias("q08_accepted_cs_phd_entries"),
        count_where(original).alias("q09_original_field_count"), count_where(standard).alias("q09_llm_field_count"),
        (count_where(standard) - count_where(original)).alias("q09_difference"),
    )


def summary(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("total_entries"), F.max("date_added").alias("newest_entry"))


def data_notes(t: DataFrame) -> DataFrame:
    """How many stored scores are off the official scales, and the dates covered."""
    off = lambda c, ok: F.count_if(F.col(c).isNotNull() & ~ok)
    return t.agg(
        F.count("*").alias("entries"),
        off("gpa", p.valid_gpa()).alias("gpa_off_scale"),
        off("gre", p.valid_section("gre")).alias("gre_off_scale"),
        F.count_if(F.col("gre").between(260, 340)).alias("gre_totals"),
        off("gre_v", p.valid_section("gre_v")).alias("gre_v_off_scale"),
        off("gre_aw", p.valid_writing()).alias("gre_aw_off_scale"),
        mean("gre").alias("naive_gre_average"),
        F.min("date_added").alias("oldest_entry"),
        F.max("date_added").alias("newest_entry"),
    )


def status_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("status").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), F.asc_nulls_last("status"))


def answer_cells(t: DataFrame) -> DataFrame:
    """Counts and sums of all questions by degree and standardized university: what every answer and the summary can be added up from, in one scan."""
    f26, f25, acc, gpa = fall(2026), fall(2025), p.accepted(), p.valid_gpa()
    phd, american = _accepted_phd(), fall(2026) & p.equals("us_or_international", "american") & p.valid_gpa()
    jhu = p.matches("program", p.JHU) & p.matches("program", p.COMPUTER_SCIENCE) & p.matches("degree", p.MASTERS)
    counts = {
        "f26": f26, "f26_acc": f26 & acc, "f25": f25, "f25_acc": f25 & acc, "international": p.equals("us_or_international", "international"),
        "classified": p.one_of("us_or_international", p.NATIONALITIES), "jhu": jhu, "original": phd & _cs_at_target("program", "program"),
        "standard": phd & _cs_at_target("llm_generated_program", "llm_generated_university"), "total": F.lit(True),
    }
    means = {avg: (c, ok()) for c, avg, _, ok in _METRICS} | {"american": ("gpa", american), "accepted": ("gpa", f26 & acc & gpa)}
    sums = [x for name, (c, where) in means.items() for x in (F.sum(F.when(where, F.col(c))).alias(f"{name}_sum"), F.count(F.when(where, F.col(c))).alias(f"{name}_n"))]
    return t.groupBy("degree", "llm_generated_university").agg(*[F.count_if(w).alias(n) for n, w in counts.items()], *sums, F.max("date_added").alias("newest"))


def answers_of_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``answer_cells``: scalar_answers with the summary's columns, q10 and q11."""
    n = lambda name: F.coalesce(F.sum(name), F.lit(0))
    avg = lambda name: rounded(F.sum(f"{name}_sum") / F.nullif(n(f"{name}_n"), F.lit(0)))
    values = {
        "q01_fall_2026_entries": n("f26"), "q02_international_entries": n("international"), "q02_classified_entries": n("classified"), "q02_percent_international": percent(n("international"), n("classified")),
        **{k: v for _, name, count, _ in _METRICS for k, v in ((f"q03_{name}", avg(name)), (f"q03_{count}", n(f"{name}_n")))},
        "q04_avg_gpa": avg("american"), "q04_applicants_with_gpa": n("american_n"), "q05_accepted_entries": n("f25_acc"), "q05_fall_2025_entries": n("f25"), "q05_acceptance_percent": percent(n("f25_acc"), n("f25")),
        "q06_avg_gpa": avg("accepted"), "q06_applicants_with_gpa": n("accepted_n"), "q07_jhu_cs_masters_entries": n("jhu"), "q08_accepted_cs_phd_entries": n("original"),
        "q09_original_field_count": n("original"), "q09_llm_field_count": n("standard"), "q09_difference": n("standard") - n("original"), "total_entries": n("total"), "newest_entry": F.max("newest"),
    }

    def by(column: str, name: str, *more: Column) -> DataFrame:
        grouped = cells.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(name))
        return grouped.agg(F.sum("f26").alias("entries"), F.sum("f26_acc").alias("acceptances"), percent(F.sum("f26_acc"), F.sum("f26")).alias("acceptance_percent"), *more)

    degrees = by("degree", "degree", avg("accepted").alias("avg_accepted_gpa")).filter(F.col("entries") >= MIN_DEGREE_ENTRIES)
    schools = by("llm_generated_university", "university").filter((F.col("university") != "Unknown") & (F.col("entries") > 0))
    top = lambda df, key, limit: df.orderBy(F.desc("entries"), key).limit(limit)
    return cells.agg(*[v.alias(k) for k, v in values.items()]), top(degrees, "degree", RESULT_LIMIT), top(schools, "university", TOP_UNIVERSITIES)
