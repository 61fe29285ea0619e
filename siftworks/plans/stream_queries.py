"""Registered queries of bounded reads, resumed positions, messages, batches and the stored snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.plans.data_queries import _CITIZEN, _GPA, _PROGRAM
from siftworks.plans.views import applicants, raw_entries, table, with_sql
from siftworks.shared import scratch_path
from siftworks.streaming import incremental as inc


def _order_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Pages of 20 orders, newest first, and the largest id."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("result_id"))
    top = a.agg(F.max("result_id").alias("m")).first()["m"]
    return a.withColumn("page_no", (F.floor((F.lit(top) - F.col("result_id")) / 20) + 1).cast("int")), top


def bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pull: as many pages as the cap allows; ids up to 97 % of the largest are known."""
    entries, top = _order_pages(spark, sf_dir)
    return inc.bounded_read(entries, int(top * 0.97))[0].select("result_id", "page_no")


def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three saved positions and pages for one and a half of them: the rows read, and what is left over (no result_id).

    The first ends at the first known page, the second where the first began, the third isn't reached.
    """
    entries, top = _order_pages(spark, sf_dir)
    pending = spark.createDataFrame([(1, top * 3 // 200 + 1), (2, top // 200 + 1), (3, top * 2 // 200 + 1)], "position int, first int")
    rows, rest = inc.resume_ranges(entries, pending, top // 80, top * 60 // 100)
    return rows.select("result_id", "page_no", F.lit(None).cast("int").alias("position")).unionByName(rest.select(F.lit(None).cast("int").alias("result_id"), F.col("first").alias("page_no"), "position"))


RESUME_SQL = """
with p as (select cast(o_orderkey as int) as result_id, cast((m - o_orderkey) // 20 + 1 as int) as page_no, m from orders, (select max(o_orderkey) as m from orders)
), b as (select any_value(m) * 3 // 200 + 1 as f1, any_value(m) // 200 + 1 as f2, any_value(m) * 2 // 200 + 1 as f3, any_value(m) // 80 as budget, any_value(m) * 60 // 100 as mark from p
), s as (select *, (select min(page_no) from p, b where page_no >= f1 and result_id <= mark) as stop from b
), r as (select *, f2 + budget - (stop - f1 + 1) - 1 as upto from s)
select result_id, page_no, cast(null as int) as position from p, r where result_id > mark and (page_no between f1 and stop or page_no between f2 and upto)
union all select null, cast(upto + 1 as int), 2 from r union all select null, cast(f3 as int), 3 from r
"""


def route_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of all shapes through a stream: counts by kind and reject reason."""
    events = table(spark, sf_dir, "events")
    i = F.col("event_id")
    number = i.cast("string")
    bodies = [
        ('{"kind":"scrape_new_data","payload":{"since":', number, "}}"), ('{"kind":"scrape_new_data","payload":{"since":"', number, '"}}'),
        ('{"kind":"scrape_new_data","payload":{"since":', number, ".5}}"), ('{"kind":"scrape_new_data","payload":{"since":-', number, "1}}"),
        ('{"kind":"scrape_new_data","payload":{"since":', number, "0000000000}}"), ('{"kind":"scrape_new_data","payload":{"since":null}}',),
        ('{"kind":"scrape_new_data","payload":{"sinse":', number, "}}"), ('{"kind":"recompute_analytics","payload":{"since":', number, "}}"),
        ('{"kind":"recompute_analytics","ts":"x","payload":null}',), ('{"kind":"recompute_analytics","payload":[', number, "]}"), ('{"kind":"', "event_type", '","payload":', "props", "}"),
        ('{"kind":', number, "}"), ("[", number, "]"), ('{"kind":"scrape_new_data"', number), ('{"kind":"scrape_new_data","payload":{"since":true}}',), (),
    ]
    column = lambda parts: F.concat(*[x if isinstance(x, Column) else F.col(x) if x in ("event_type", "props") else F.lit(x) for x in parts]) if parts else F.lit(None).cast("string")
    body = column(bodies[0])
    for k, parts in enumerate(bodies):
        body = F.when(i % len(bodies) == k, column(parts)).otherwise(body)
    path, out, mark = (scratch_path(spark, n) for n in ("messages", "routed", "routed-mark"))
    events.select(body.alias("body")).write.parquet(path)
    stream = inc.route_messages(spark.readStream.schema("body string").parquet(path))
    stream.select("kind", "reject_reason").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("kind string, reject_reason string").parquet(out).groupBy("kind", "reject_reason").agg(F.count("*").alias("n"))


ROUTE_SQL = """
select case when k < 7 or k = 14 then 'scrape_new_data' when k < 10 then 'recompute_analytics' when k = 10 then event_type end as kind,
  case when k in (0, 5, 8) then null when k = 4 and event_id = 0 then null when k in (1, 2, 3, 4, 14) then 'since' when k in (6, 7) then 'unknown field' when k = 9 then 'payload'
    when k in (10, 11) then 'unknown kind' when k = 12 then 'not an object' when k = 13 then 'not json' else 'size' end as reject_reason, count(*) as n
from (select event_id % 16 as k, * from events) group by all
"""


def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping batches of raw entries, each read as a stream when it has arrived, cleaned and added; then the last one again."""
    source, root, mark = (scratch_path(spark, n) for n in ("batches", "store", "store-mark"))
    entries = raw_entries(applicants(spark, sf_dir))
    top = entries.agg(F.max("result_id").alias("m")).first()["m"] + 1
    for i in range(3):
        entries.filter(F.col("result_id").between(int(top * i / 4), int(top * (i + 2) / 4) - 1)).write.mode("append").parquet(source)
        store = inc.incremental_pull(spark, source, entries.schema, root, mark)
    inc.apply_batch(store, entries.withColumn("arrival", F.lit(0)), store.state()["batch"])
    rows = store.rows().select("p_id", "program", "gpa", "us_or_international", "date_added")
    return rows.withColumn("last_seen", F.lit(store.watermark()))


def refresh_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshot after each step: half of the rows, nothing new (skipped), the other half (stale until refreshed), forced."""
    store = inc.BatchStore(spark, scratch_path(spark, "snapshots"))
    a = applicants(spark, sf_dir)
    steps = [("first half", a.filter("p_id % 2 = 0"), False), ("nothing new", None, False), ("second half", a.filter("p_id % 2 = 1"), False), ("forced", None, True)]
    out, stale = None, None
    for i, (step, rows, force) in enumerate(steps):
        if rows is not None:
            store.commit(f"load-{i}", rows, None, refresh=False)
            stale = inc.snapshot_status(store).select("total_entries").first()
        done = inc.refresh_snapshot(store, force)
        # read now: later steps change what is stored
        status = inc.snapshot_status(store).select("total_entries", "newest_entry", "n_answers").first()
        shown = spark.createDataFrame([(step, done, stale[0] if stale else 0, *status)], "step string, refreshed boolean, total_before long, total_entries long, newest_entry date, n_answers int")
        out = shown if out is None else out.unionByName(shown)
    return out


REFRESH_SQL = with_sql("""
, n as (select count(*) filter (where p_id % 2 = 0) as half, count(*) as whole, max(date_added) filter (where p_id % 2 = 0) as d, max(date_added) as e from applicants)
select 'first half' as step, true as refreshed, cast(0 as bigint) as total_before, half as total_entries, d as newest_entry, 11 as n_answers from n
union all select 'nothing new', false, 0, half, d, 11 from n union all select 'second half', true, half, whole, e, 11 from n union all select 'forced', true, half, whole, e, 11 from n""").replace(") \n,", "),", 1)


def queries() -> dict:
    return {f.__name__: f for f in (bounded_read, resume_pages, route_tasks, incremental_pull, refresh_snapshot)}


def oracle_sql() -> dict[str, str]:
    return {
        "bounded_read": "select cast(o_orderkey as int) as result_id, cast((m - o_orderkey) // 20 + 1 as int) as page_no from orders, (select max(o_orderkey) as m from orders) "
        "where o_orderkey > floor(m * 0.97) and (m - o_orderkey) // 20 < 50",
        "resume_pages": RESUME_SQL,
        "route_tasks": ROUTE_SQL,
        "incremental_pull": with_sql(f"select p_id, {_PROGRAM} as program, {_GPA} as gpa, {_CITIZEN} as us_or_international, date_added, (select max(p_id) from applicants)::bigint as last_seen from applicants"),
        "refresh_snapshot": REFRESH_SQL,
    }
