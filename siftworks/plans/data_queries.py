"""Registered queries of cleaning, loading, sources, names, pages and increments: round trips over the derived tables.

Inputs are rendered from the driver's tables by Spark, so they grow with them; the SQL selects the known columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions import text as t
from siftworks.functions.formats import long_time
from siftworks.operators import cleaning, loading
from siftworks.plans.views import applicants, raw_entries, sparse_entries, table, with_sql
from siftworks.shared import scratch_path
from siftworks.sources import json_records as js

_PROGRAM = "regexp_replace(program, ' +', ' ', 'g')"
_STATUS = "case trim(status) when 'Wait listed' then 'Waitlisted' else trim(status) end"
_TERM = "case when trim(term) = 'fall 2026' then 'Fall 2026' else term end"
_CITIZEN = "case trim(us_or_international) when 'international' then 'International' else us_or_international end"
_GPA = "case when gpa >= 0 then gpa end"
_N_TAGS = "1 + (term is not null)::int + (us_or_international is not null)::int + (gpa is not null)::int + (gre is not null)::int + (gre_v is not null)::int + (gre_aw is not null)::int"
_SCHOOL = "split_part(program, ', ', 2)"
ENTRY_SCHEMA = "result_id int, school_text string, program_text string, tags_text array<string>, comment_text string"


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.clean_records(sparse_entries(raw_entries(applicants(spark, sf_dir))))
    plain = ("result_id", "program", "university", "degree", "date_added", "status", "decision_date", "decision_date_source", "term", "us_or_international", "gpa", "gre", "gre_v", "gre_aw", "comments")
    raw = ("raw.school", "raw.degree", "raw.decision", "raw.date_of_notification")
    return out.select(*plain, F.size("other_tags").alias("n_other"), *[F.col(c).alias(c.replace(".", "_")) for c in raw], F.size("raw.tags").alias("n_raw_tags"))


_SPARSE = f"""
, k as (select *, p_id % 11 as k, p_id % 11 not in (5, 6) as has, {_SCHOOL} as school, trim(regexp_replace(split_part(program, ', ', 1), ' +', ' ', 'g')) as prog from applicants
), d as (select *, case when k = 3 then date '2020-01-02' else date_added end as added, strftime(date_added, '%m-%d') as md from k
), cleaned as (
  select p_id, case when k = 1 then 'Json ' || prog else prog end || ', ' || case when k = 0 then 'Json ' || school else school end as program,
    case when k = 0 then 'Json ' || school else school end as university,
    case when k = 2 or degree is null then case when has then 'json level' end else degree end as degree, added, strftime(added, '%Y-%m-%d') as date_added,
    case when k = 4 then 'Waitlisted' else {_STATUS} end as status,
    case when k = 8 then '2021-03-04' when k = 4 then null when k = 3 then strftime(try_cast(case when md > '01-02' then '2019-' else '2020-' end || md as date), '%Y-%m-%d')
      else strftime(date_added, '%Y-%m-%d') end as decision_date,
    case when k = 7 then 'Fall 2026' else {_TERM} end as term, case when k = 7 or us_or_international is null then case when has then 'American' end else {_CITIZEN} end as us_or_international,
    case when k = 7 or {_GPA} is null then case when has then 3.8 end else gpa end as gpa, case when k = 7 or gre is null then case when has then 165.0 end else gre end as gre,
    case when k <> 7 then gre_v end as gre_v, case when k <> 7 then gre_aw end as gre_aw, coalesce(comments, case when has then 'json note' || chr(10) || 'two' end) as comments,
    case when gpa < 0 and k <> 7 then 1 else 0 end::int as n_other, case when k <> 0 then school end as raw_school, case when k <> 2 then degree end as raw_degree,
    case when k <> 4 then trim(status) || ' on ' || strftime(date_added, '%b %d') end as raw_decision,
    case when k = 8 then '2021-03-04T00:00:00Z' when has then '' end as raw_date_of_notification, case when k = 7 then 0 else {_N_TAGS} end::int as n_raw_tags
  from d
)"""


def _with_cleaned(body: str) -> str:
    return with_sql("").rstrip() + f"{_SPARSE} {body}"


CLEAN_SQL = _with_cleaned(
    "select p_id as result_id, * exclude (p_id, added), case when raw_date_of_notification > '' then 'site_json' when decision_date is not null then 'badge_year_inferred' end as decision_date_source from cleaned"
)


def record_to_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.record_to_row(cleaning.clean_records(sparse_entries(raw_entries(applicants(spark, sf_dir)))).drop("result_id"))
    return out.select("p_id", "program", "date_added", "status", "gpa", "degree", "comments")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return loading.dedupe_first(events, "user_id", "event_id")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and a batch that overlaps them and holds repeats and rows without a key."""
    a = applicants(spark, sf_dir)
    batch = a.filter("p_id % 3 <> 0")
    twice = batch.withColumn("seq", F.lit(0)).unionByName(batch.filter("p_id % 5 = 0").withColumn("seq", F.lit(1)).withColumn("program", F.lit("second copy")))
    keyless = batch.filter("p_id % 7 = 0").withColumn("seq", F.lit(2)).withColumn("p_id", F.lit(None).cast("int")).withColumn("url", F.lit(None).cast("string"))
    return a.filter("p_id % 2 = 0"), twice.unionByName(keyless)


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _split(spark, sf_dir)
    return loading.insert_new(stored, batch.filter("seq = 0")).select("p_id", "program")


def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _split(spark, sf_dir)
    return loading.load_records(stored, batch, "seq").counts


def loaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _split(spark, sf_dir)
    return loading.load_records(stored, batch, "seq").rows.select("p_id", "program", "gpa")


def upsert_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = applicants(spark, sf_dir).select("p_id", "status")
    return loading.upsert_keyed(a.filter("p_id % 2 = 0"), a.filter("p_id % 3 = 0").withColumn("status", F.lit("changed")), "p_id")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written, appended to, and read back."""
    path = scratch_path(spark, "jsonl")
    entries = raw_entries(applicants(spark, sf_dir))
    js.write_records(entries.filter("result_id % 2 = 0"), path, gzip=True)
    js.append_jsonl(entries.filter("result_id % 2 = 1"), path)
    return js.read_jsonl_tolerant(spark, path, ENTRY_SCHEMA).rows.select("result_id", F.size("tags_text").alias("n_tags"), "comment_text")


def read_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold JSON arrays of up to 1,000 records each."""
    path = scratch_path(spark, "arrays")
    entries = raw_entries(applicants(spark, sf_dir)).select("result_id", "school_text", "comment_text")
    arrays = entries.groupBy(F.floor(F.col("result_id") / 1000).alias("file")).agg(F.to_json(F.collect_list(F.struct("result_id", "school_text", "comment_text"))).alias("value"))
    arrays.write.partitionBy("file").option("lineSep", "\n").text(path)
    return js.read_records(spark, f"{path}/*", "result_id int, school_text string, comment_text string")


def _damaged(spark: SparkSession, sf_dir: str) -> str:
    """One file per 1,000 events; line 700 of each is cut short."""
    path = scratch_path(spark, "damaged")
    line = F.to_json(F.struct("event_id", "event_type"))
    cut = table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("event_id") / 1000).alias("file"), F.when(F.col("event_id") % 1000 == 700, F.substr(line, F.lit(1), F.lit(9))).otherwise(line).alias("value")
    )
    cut.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    return path


def read_jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js.read_jsonl_tolerant(spark, f"{_damaged(spark, sf_dir)}/*", "event_id long, event_type string").counts


def read_jsonl_until_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js.read_jsonl_until_bad(spark, f"{_damaged(spark, sf_dir)}/*", "event_id long, event_type string")


def unwrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", "event_type"))).alias("j"))
    payload = F.when(F.col("user_id") % 3 == 0, F.col("j")).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"rows":'), "j", F.lit("}"))).otherwise(F.lit('"none"'))
    return js.unwrap_rows(grouped.select(payload.alias("payload")), "payload", "event_id long, event_type string")


def gated_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files as listed; then one listed with another size, one listed that is not there, files cut short, and a file of several lists: what is published, and how often it was refused."""
    folder, target = scratch_path(spark, "gated"), scratch_path(spark, "published")
    entries = raw_entries(applicants(spark, sf_dir)).select("result_id", "school_text")
    arrays = entries.groupBy(F.floor(F.col("result_id") / 1000).alias("file")).agg(F.to_json(F.collect_list(F.struct("result_id", "school_text"))).alias("value"))
    # every file holds two lists
    arrays.select(F.concat_ws("\n", "value", "value").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/several")
    size = lambda path: spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/one")
    arrays.select(F.substr("value", F.lit(1), F.char_length("value") - 2).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/cut")
    one, cut = size(f"{folder}/one"), size(f"{folder}/cut")
    schema = "result_id int, school_text string"
    refused = 0
    js.gated_ingest(spark, f"{folder}/one", one, schema, target)
    tries = [(one.withColumn("size", F.col("size") + 1), "one"), (one.unionByName(spark.createDataFrame([("missing", 1)], one.schema)), "one"), (cut, "cut"), (size(f"{folder}/several"), "several")]
    for listed, part in tries:
        try:
            js.gated_ingest(spark, f"{folder}/{part}", listed, schema, target)
        except js.GateError:
            refused += 1
    return spark.read.parquet(target).withColumn("refused", F.lit(refused))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_entries(applicants(spark, sf_dir))
    status, when = t.split_decision(F.col("decision_text"))
    added = t.parse_date(F.col("date_added_text"))
    return e.select("result_id", added.alias("added"), t.decision_date(when, added).alias("decided"), status.alias("status"))


def long_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", long_time(F.col("ts")).alias("shown"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by collapsed white space."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", t.collapse(F.col("text")).alias("flat"))


def queries() -> dict:
    fs = (
        clean_records, record_to_row, dedupe_first, insert_new, load_records, loaded_rows, upsert_keyed, json_round_trip, read_records_json, read_jsonl_tolerant,
        read_jsonl_until_bad, unwrap_rows, gated_ingest,
        parse_dates, long_times, clean_text,
    )
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    late = "select p_id, program, gpa from applicants where p_id % 3 <> 0 and p_id % 2 <> 0"
    return {
        "clean_records": CLEAN_SQL,
        "record_to_row": _with_cleaned("select p_id, program, added as date_added, status, gpa, degree, comments from cleaned"),
        "dedupe_first": "select user_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type, arg_min(value, event_id) as value from events group by 1",
        "insert_new": with_sql("select p_id, program from applicants where p_id % 3 <> 0 and p_id % 2 <> 0"),
        "load_records": with_sql(
            "select count(*) filter (where p_id % 2 <> 0) as inserted, count(*) filter (where p_id % 2 = 0) as present, count(*) filter (where p_id % 7 = 0) as unusable from applicants where p_id % 3 <> 0"
        ),
        "loaded_rows": with_sql(late),
        "upsert_keyed": with_sql("select p_id, case when p_id % 3 = 0 then 'changed' else status end as status from applicants where p_id % 2 = 0 or p_id % 3 = 0"),
        "json_round_trip": with_sql(f"select p_id as result_id, ({_N_TAGS})::int as n_tags, comments as comment_text from applicants"),
        "read_records_json": with_sql(f"select p_id as result_id, {_SCHOOL} as school_text, comments as comment_text from applicants"),
        "read_jsonl_tolerant": "select count(*) filter (where event_id % 1000 <> 700) as good, count(*) filter (where event_id % 1000 = 700) as damaged from events",
        "read_jsonl_until_bad": "select event_id, event_type from events where event_id % 1000 < 700",
        "unwrap_rows": "select event_id, event_type from events where user_id % 3 in (0, 1)",
        "gated_ingest": with_sql(f"select p_id as result_id, {_SCHOOL} as school_text, 4::int as refused from applicants"),
        "parse_dates": with_sql(f"select p_id as result_id, date_added as added, date_added as decided, {_STATUS} as status from applicants"),
        "long_times": "select event_id, strftime(ts, '%B %d, %Y at %I:%M:%S %p UTC') as shown from events",
        "clean_text": r"select doc_id, nullif(trim(regexp_replace(text, '[\s]+', ' ', 'g')), '') as flat from documents",
    }
