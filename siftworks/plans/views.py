"""The applicants table derived from orders, customer and nation, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.operators.loading import ROW_SCHEMA

APPLICANTS = """
select cast(o_orderkey as int) as p_id,
  case o_orderkey % 5 when 0 then 'Computer Science' when 1 then 'computer  science' when 2 then 'EECS' when 3 then 'Physics' else 'History' end
    || ', ' ||
    case o_custkey % 7 when 0 then 'Johns Hopkins University' when 1 then 'MIT' when 2 then 'Stanford University'
      when 3 then case when o_orderkey % 4 = 1 then 'Carnegie-Mellon' else 'CMU' end
      when 4 then 'Georgetown University' when 5 then 'Summit University' else 'JHU' end as program,
  case when o_orderkey % 2 = 0 then 'c' || cast(o_orderkey as varchar(20)) end as comments,
  cast(o_orderdate as date) as date_added,
  'https://example.com/result/' || cast(o_orderkey as varchar(20)) as url,
  case o_orderstatus when 'F' then ' Accepted' when 'O' then 'Rejected' else 'Wait listed' end as status,
  case o_orderkey % 4 when 0 then 'Fall 2025' when 1 then ' fall 2026 ' when 2 then 'Fall 2026' else 'Spring 2027' end as term,
  case n_regionkey when 0 then 'American' when 1 then 'International' when 2 then ' international' when 3 then 'Other' end as us_or_international,
  case when o_orderkey % 6 <> 0 then round(c_acctbal / 2000, 2) + 0.0 end as gpa,
  cast(case when o_orderkey % 9 = 0 then 320 when o_orderkey % 3 = 0 then 130 + o_orderkey % 41 end as double) as gre,
  cast(case when o_orderkey % 3 = 1 then 125 + o_orderkey % 50 end as double) as gre_v,
  case when o_orderkey % 4 = 1 then cast(o_orderkey % 14 as double) / 2 end as gre_aw,
  case substr(o_orderpriority, 1, 1) when '1' then 'PhD' when '2' then 'Masters' when '3' then 'Ph.D.' when '4' then 'MFA' end as degree,
  case o_orderkey % 5 when 3 then 'Physics' when 4 then 'History' else 'Computer Science' end as llm_generated_program,
  case o_custkey % 7 when 0 then 'Johns Hopkins University' when 1 then 'Massachusetts Institute of Technology' when 2 then 'Stanford University'
    when 3 then 'Carnegie Mellon University' when 4 then 'Georgetown University' when 5 then 'Unknown' else 'Johns Hopkins University' end as llm_generated_university
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

COLUMNS = [
    "p_id", "program", "comments", "date_added", "url", "status", "term", "us_or_international",
    "gpa", "gre", "gre_v", "gre_aw", "degree", "llm_generated_program", "llm_generated_university",
]
SCHEMA = ROW_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    query = APPLICANTS.replace("from orders", "from {orders}").replace("join customer on", "join {customer} on").replace("join nation on", "join {nation} on")
    return spark.sql(query, **tables)


def with_sql(body: str) -> str:
    """A query over ``applicants`` for DuckDB."""
    return f"with applicants as ({APPLICANTS}) {body}"


def raw_entries(applicant_rows: DataFrame) -> DataFrame:
    """Applicants rendered as listing texts and badges: what a listing page shows (all columns text, tags an array)."""
    number = lambda c, p: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{p} "), F.col(c).cast("string")))
    return applicant_rows.select(
        F.col("p_id").alias("result_id"),
        "url",
        F.element_at(F.split("program", ", "), 2).alias("school_text"),
        F.element_at(F.split("program", ", "), 1).alias("program_text"),
        F.col("degree").alias("degree_text"),
        F.when(F.col("p_id") % 3 == 0, F.date_format("date_added", "MMM dd, yyyy"))
        .when(F.col("p_id") % 3 == 1, F.date_format("date_added", "MMMM dd, yyyy"))
        .otherwise(F.date_format("date_added", "yyyy-MM-dd"))
        .alias("date_added_text"),
        F.concat(F.trim("status"), F.lit(" on "), F.date_format("date_added", "MMM dd")).alias("decision_text"),
        F.array_compact(
            F.array(F.trim("term"), F.trim("us_or_international"), number("gpa", "GPA"), number("gre", "GRE"), number("gre_v", "GRE V"), number("gre_aw", "GRE AW"), F.lit("0"))
        ).alias("tags_text"),
        F.col("comments").alias("comment_text"),
        F.lit(None).cast("string").alias("listing_json"),
        F.lit("https://example.com/survey?page=1").alias("source_page_url"),
        F.lit("2026-09-20T12:00:00+00:00").alias("scraped_at"),
    )


def sparse_entries(entries: DataFrame) -> DataFrame:
    """Raw entries with the page's JSON record, whose values differ from the visible ones; by result_id % 11 a visible field is missing, or the record is missing (5) or damaged (6)."""
    k = F.col("result_id") % 11
    at = {0: "school_text", 1: "program_text", 2: "degree_text", 3: "date_added_text", 4: "decision_text"}
    blank = {name: F.when(k == i, F.lit("  " if i == 1 else None)).otherwise(F.col(name)) for i, name in at.items()}
    record = F.to_json(
        F.struct(
            F.col("result_id").alias("id"), F.concat(F.lit("Json  "), "school_text").alias("school"), F.concat(F.lit("Json "), "program_text").alias("program"), F.lit(" json level").alias("level"),
            F.lit("2020-01-02T10:00:00Z").alias("created_at"), F.lit("wait  listed").alias("decision"), F.lit("fall").alias("season"), F.lit(2026).alias("year"), F.lit("american").alias("status"),
            F.lit("3.80").alias("ugpa"), F.lit(165).alias("greq"), F.lit(0).alias("grev"), F.lit("").alias("grew"), F.lit("json  note\n\n two").alias("notes"),
            F.when(k == 8, "2021-03-04T00:00:00Z").otherwise("").alias("date_of_notification"),
        )
    )
    tags = F.when(k == 7, F.lit(None).cast("array<string>")).otherwise(F.col("tags_text"))
    return entries.withColumns(blank | {"tags_text": tags, "listing_json": F.when(k == 6, F.substr(record, F.lit(1), F.lit(40))).when(k != 5, record)})
