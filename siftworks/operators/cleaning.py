"""Raw listing entries to cleaned records, and cleaned records to table rows: one select each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions import text as t


def clean_records(entries: DataFrame) -> DataFrame:
    """Cleaned records of raw entries, newest id first (a missing id counts as 0)."""
    # sorted before anything is computed: the sort's sample then reads ids alone, and the selects keep the order
    return clean_entries(entries.orderBy(F.coalesce("result_id", F.lit(0)).desc()))


def clean_entries(entries: DataFrame, *keep: str) -> DataFrame:
    """Cleaned records of raw entries in any order, and the columns ``keep``. Works on streams and tables.

    listing_json is a JSON text or null; damaged JSON counts as null. Badges win over the page's JSON record.
    """
    c = F.col
    page = lambda key: F.try_element_at(c("_page"), F.lit(key))
    # each step's results are columns: an expression that later ones use often would be computed by each of them
    seen = {"school": "school_text", "program": "program_text", "degree": "degree_text", "added": "date_added_text", "decision": "decision_text"}
    entries = entries.select(
        "*", F.from_json("listing_json", "map<string,string>").alias("_page"), t.tag_kinds(c("tags_text")).alias("_kinds"),
        *[t.collapse(c(text)).alias(f"_seen_{n}") for n, text in seen.items()], t.collapse_lines(c("comment_text")).alias("_seen_comment"),
    )
    payload = {"gre_aw": "grew", "gre_v": "grev", "gre": "greq", "gpa": "ugpa"}
    chosen = lambda n, key: F.coalesce(f"_seen_{n}", t.collapse(page(key)))
    entries = entries.select(
        "*", chosen("school", "school").alias("_university"), chosen("program", "program").alias("_program"), chosen("added", "added_on_label").alias("_added_text"),
        chosen("decision", "decision_label").alias("_decision"), t.iso_date(page("created_at")).alias("_created"), t.iso_date(page("date_of_notification")).alias("_exact"),
        *[tag.alias(f"_tag_{n}") for n, tag in t.last_tags(c("_kinds")).items()],
    )
    status, badge_date = t.split_decision(c("_decision"))
    entries = entries.select(
        "*", F.coalesce(t.parse_date(c("_added_text")), "_created").alias("_added"), status.alias("_status"), badge_date.alias("_badge_date"),
        *[t.read_number(c(f"_tag_{n}")).alias(f"_badge_{n}") for n in t.NUMBERS],
    )
    # a page's number counts where there is no badge's
    number = {n: t.finite(c(f"_badge_{n}")) for n in t.NUMBERS}
    entries = entries.select("*", t.month_day(c("_badge_date")).alias("_day"), *[F.when(number[n].isNull(), t.read_number(page(key))).alias(f"_page_{n}") for n, key in payload.items()])
    entries = entries.select("*", t.decision_date(c("_badge_date"), c("_added"), c("_day")).alias("_inferred"))
    number = {n: F.coalesce(number[n], F.nullif(t.finite(c(f"_page_{n}")), F.lit(0.0))) for n in t.NUMBERS}
    season = t.parse_term(F.concat_ws(" ", t.collapse(page("season")), t.collapse(page("year"))))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    cleaned = entries.select(
        "result_id",
        "url",
        F.when(c("_program").isNotNull() & c("_university").isNotNull(), F.concat_ws(", ", "_program", "_university")).alias("program"),
        c("_program").alias("program_name"),
        c("_university").alias("university"),
        chosen("degree", "level").alias("degree"),
        iso(c("_added")).alias("date_added"),
        F.coalesce("_status", t.normalize_status(t.collapse(page("decision")))).alias("status"),
        iso(F.coalesce("_exact", "_inferred")).alias("decision_date"),
        F.when(c("_exact").isNotNull(), "site_json").when(c("_inferred").isNotNull(), "badge_year_inferred").alias("decision_date_source"),
        F.coalesce(t.parse_term(c("_tag_term")), t.parse_term(t.collapse(page("season"))), season).alias("term"),
        F.coalesce(t.parse_citizenship(c("_tag_us_or_international")), t.parse_citizenship(t.collapse(page("status")))).alias("us_or_international"),
        *[number[n].alias(n) for n in ("gpa", "gre", "gre_v", "gre_aw")],
        F.coalesce("_seen_comment", t.collapse_lines(page("notes"))).alias("comments"),
        t.other_tags(c("_kinds")).alias("other_tags"),
        F.struct(
            c("school_text").alias("school"), c("program_text").alias("program"), c("degree_text").alias("degree"),
            c("date_added_text").alias("date_added"), c("decision_text").alias("decision"),
            F.coalesce("tags_text", F.array().cast("array<string>")).alias("tags"), c("comment_text").alias("comment"),
            page("date_of_notification").alias("date_of_notification"), c("scraped_at").alias("scraped_at"),
        ).alias("raw"),
        *keep,
    )
    return cleaned


def plain_text(c: Column) -> Column:
    """Without NUL characters and outer white space; nothing left gives null."""
    return t.blank_to_null(F.regexp_replace(F.replace(c.cast("string"), F.lit("\0"), F.lit("")), r"(?U)^\s+|\s+$", ""))


def _column(columns: set[str], name: str) -> Column:
    return F.col(f"`{name}`") if name in columns else F.lit(None)


def record_key(columns: set[str], url: Column) -> Column:
    """p_id, else result_id, else the number that ends the url, of a record with these columns. An id beyond 32 bits is an error."""
    whole = lambda c: F.when(F.trim(c.cast("string")).rlike(r"^[+-]?\d+$"), F.trim(c.cast("string")).cast("long"))
    tail = F.nullif(F.regexp_extract(url, r"(?:^|/)(\d+)/*$", 1), F.lit("")).cast("long")
    return F.coalesce(whole(_column(columns, "p_id")), whole(_column(columns, "result_id")), tail).cast("int")


def entry_key() -> Column:
    """The p_id that an entry's row will have: cleaning leaves result_id and url as they are."""
    return record_key({"result_id"}, plain_text(F.col("url")))


def record_to_row(records: DataFrame, *keep: str) -> DataFrame:
    """Cleaned records as table rows, and the columns ``keep``; p_id is null in an unusable one.

    The key is p_id, else result_id, else the number that ends the url. An id beyond 32 bits fails the whole load.
    """
    have = set(records.columns)
    col = lambda n: _column(have, n)
    # used several times: computed once
    records = records.select(
        "*", plain_text(col("url")).alias("_plain_url"), plain_text(col("date_added")).alias("_plain_added"), plain_text(col("program")).alias("_plain_program"),
        *[t.read_number(col(n).cast("string")).alias(f"_read_{n}") for n in t.NUMBERS],
    )
    url = F.col("_plain_url")
    # the hyphenated spelling, where the column exists, even if its value is null
    standard = lambda n: plain_text(col(n.replace("_", "-") if n.replace("_", "-") in have else n))
    return records.select(
        record_key(have, url).alias("p_id"),
        F.coalesce("_plain_program", plain_text(col("university"))).alias("program"),
        plain_text(col("comments")).alias("comments"),
        t.iso_date(F.col("_plain_added")).alias("date_added"),
        url.alias("url"),
        *[plain_text(col(n)).alias(n) for n in ("status", "term", "us_or_international")],
        *[t.finite(F.col(f"_read_{n}")).alias(n) for n in ("gpa", "gre", "gre_v", "gre_aw")],
        plain_text(col("degree")).alias("degree"),
        standard("llm_generated_program").alias("llm_generated_program"),
        standard("llm_generated_university").alias("llm_generated_university"),
        *keep,
    )
