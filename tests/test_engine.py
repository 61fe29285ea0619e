import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftworks.functions import formats
from siftworks.functions import text as t
from siftworks.operators import analysis, cleaning, loading, search
from siftworks.plans.views import SCHEMA
from siftworks.streaming import incremental as inc

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def rows(df):
    show = lambda v: "None" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


OWN = {k for m in entry.MODULES for k in m.oracle_sql()}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "degree"


def test_scalar_answers_agree_with_single_questions_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    fused = analysis.scalar_answers(empty).first().asDict()
    for key, f in analysis.QUESTIONS.items():
        if key < "q10":
            assert f(empty).first().asDict() == {k[4:]: v for k, v in fused.items() if k.startswith(key)}
        else:
            assert f(empty).count() == 0
    assert fused["q01_fall_2026_entries"] == 0 and fused["q04_avg_gpa"] is None
    assert formats.format_answers(empty).filter("value = 'N/A'").count() > 0
    assert formats.snapshot_payload(empty).count() == 1


@pytest.mark.parametrize(
    "text,status,date",
    [("Accepted on Sep 09", "Accepted", "Sep 09"), ("wait  listed", "Waitlisted", None), ("Interviewed on 3 Mar", "Interview", "3 Mar"), ("pending-review", "Pending-Review", None), (None, None, None)],
)
def test_split_decision(spark, text, status, date):
    assert one(spark, text, lambda c: t.split_decision(c)[0]) == status
    assert one(spark, text, lambda c: t.split_decision(c)[1]) == date


@pytest.mark.parametrize(
    "text,added,expected",
    [("Sep 09", "2026-09-20", "2026-09-09"), ("Dec 30", "2026-01-05", "2025-12-30"), ("Feb 29", "2027-03-01", None), ("29 Feb", "2028-03-01", "2028-02-29"),
     ("Sep 09, 2026", None, "2026-09-09"), ("Sep 09", None, None), ("soon", "2026-01-01", None)],
)
def test_decision_date(spark, text, added, expected):
    df = spark.createDataFrame([(text, added)], "a string, b string").select(t.decision_date(F.col("a"), F.to_date("b")).alias("r"))
    assert df.first()["r"] == (expected and dt.date.fromisoformat(expected))


@pytest.mark.parametrize("text,expected", [("3.5", 3.5), ("3.5d", None), ("nan", None), ("inf", None), (" 7 ", 7.0), ("1e400", None), ("", None), ("1_000", None)])
def test_to_number(spark, text, expected):
    assert one(spark, text, t.to_number) == expected


def test_dates_terms_text(spark):
    assert one(spark, "Sep 20, 2026", t.parse_date) == one(spark, "2026-9-20", t.parse_date) == one(spark, "20 Sep 2026", t.parse_date) == dt.date(2026, 9, 20)
    assert one(spark, "2026-09-10T08:00:00Z", t.iso_date) == dt.date(2026, 9, 10)
    assert one(spark, "2026-9-1", t.iso_date) is None and one(spark, "2026", t.iso_date) is None
    assert one(spark, "fall  2026", t.parse_term) == "Fall 2026" and one(spark, "Fall 26", t.parse_term) is None
    assert one(spark, " a   b\n", t.collapse) == "a b" and one(spark, "  ", t.collapse) is None
    assert one(spark, "a  b\r\n\n c ", t.collapse_lines) == "a b\nc"
    assert one(spark, "materials SCIENCE Of the MIT", t.smart_title) == "Materials SCIENCE of the MIT"
    assert one(spark, "A, B,C", t.source_parts) == ["A", "B", "C", "A, B", "A, B, C", "B, C"]
    assert one(spark, "University of California (UCLA)", t.expand_abbreviation) == "University of California, Los Angeles"
    assert one(spark, "Toronto (St. George)", t.expand_abbreviation) == "Toronto (St. George)"
    assert one(spark, "Hillside School (HSQR)", t.expand_abbreviation) == "Hillside School"
    assert one(spark, "Botany, McG  ", lambda c: F.array(*t.rule_split(c))) == ["Botany", "Mcgill University"]


def test_classify_tags(spark):
    tags = ["Fall 2026", "American", "GPA 3.9", "GPA 3.40", "GRE 163", "GRE V 160", "GRE AW 4.5", "0", "Accepted on Sep 09", "Visa pending"]
    df = spark.createDataFrame([(tags,), (None,), ([],)], "c array<string>")
    got = [r.asDict() for r in df.select(*[c.alias(n) for n, c in t.classify_tags(F.col("c")).items()]).collect()]
    assert got[0] == {"term": "Fall 2026", "us_or_international": "American", "gpa": 3.4, "gre": 163.0, "gre_v": 160.0, "gre_aw": 4.5, "other_tags": ["Visa pending"]}
    assert got[1]["other_tags"] == got[2]["other_tags"] == [] and got[1]["gpa"] is None


def test_page_json_fills_what_is_not_visible(spark):
    schema = "result_id int, url string, school_text string, program_text string, degree_text string, date_added_text string, decision_text string, tags_text array<string>, comment_text string, listing_json string, scraped_at string"
    page = '{"school":"Hill  College","program":"Botany","level":"PhD","created_at":"2026-03-05T10:00:00Z","decision":"wait listed","season":"Fall","year":2026,"status":"american","ugpa":"3.80","greq":165,"grev":0,"grew":"","notes":"a  b\\n\\nc","date_of_notification":"2026-03-01"}'
    badges = ["GPA 3.10", "International"]
    rows = [(1, "u", None, " ", None, None, None, None, None, page, "t"), (2, "u", "Seen", "Law", "MA", "Mar 07, 2026", "Accepted on Mar 02", badges, "seen", page, "t"),
            (3, "u", None, None, None, None, None, None, None, "{broken", "t"), (4, "u", "Seen", "Law", None, "Jan 05, 2026", "Rejected on Dec 30", None, None, None, "t")]
    got = {r.result_id: r for r in cleaning.clean_records(spark.createDataFrame(rows, schema)).collect()}
    a, b, c, d = (got[i] for i in (1, 2, 3, 4))
    assert (a.program, a.degree, a.date_added, a.status, a.term, a.us_or_international) == ("Botany, Hill College", "PhD", "2026-03-05", "Waitlisted", "Fall 2026", "American")
    assert (a.gpa, a.gre, a.gre_v, a.gre_aw, a.comments, a.decision_date, a.decision_date_source) == (3.8, 165.0, None, None, "a b\nc", "2026-03-01", "site_json")
    assert (b.program, b.degree, b.status, b.gpa, b.us_or_international, b.comments, b.decision_date) == ("Law, Seen", "MA", "Accepted", 3.1, "International", "seen", "2026-03-01")
    assert (b.raw.school, b.raw.tags, b.raw.date_of_notification) == ("Seen", badges, "2026-03-01")
    assert (c.program, c.status, c.gpa, c.decision_date_source, c.raw.tags) == (None, None, None, None, [])
    assert (d.decision_date, d.decision_date_source) == ("2025-12-30", "badge_year_inferred")


def test_load_counts_and_wide_id(spark):
    records = spark.createDataFrame(
        [(1, "first copy", 0), (1, "second", 1), (None, "no id", 2), (None, "x", 3)], "result_id long, program string, seq int"
    ).withColumn("url", F.lit(None).cast("string"))
    records = records.select("*", *[F.lit(None).cast("string").alias(n) for n in ("comments", "date_added", "status", "term", "us_or_international", "degree", "university")])
    records = records.select("*", *[F.lit(None).cast("double").alias(n) for n in ("gpa", "gre", "gre_v", "gre_aw")])
    load = loading.load_records(spark.createDataFrame([], SCHEMA), records, "seq")
    assert tuple(load.counts.first()) == (1, 0, 2) and load.rows.first()["program"] == "first copy"
    wide = records.withColumn("result_id", F.lit(2**40))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        loading.load_records(spark.createDataFrame([], SCHEMA), wide, "seq").counts.collect()
    assert cleaning.record_to_row(records.withColumn("url", F.lit("https://x/result/77/")).drop("result_id")).first()["p_id"] == 77


def test_search_arguments(spark):
    assert search.row_limit("1000") == 100 and search.row_limit(0) == 1 and search.row_limit("") == 20 and search.row_limit("-" + "9" * 5000) == 1
    for bad in ({"sort": "p_id; drop"}, {"order": "up"}, {"limit": "x"}, {"limit": "1_000"}, {"limit": "\u0663"}, {"limit": True}, {"sort": ""}, {"sort": "GPA"}, {"term": "a" * 101}):
        with pytest.raises(search.SearchError):
            search.check_arguments(bad)
    data = spark.createDataFrame([(1, "100% cs", None), (2, "a_b", 3.0), (3, None, 2.0)], "p_id int, program string, gpa double")
    data = data.select("*", *[F.lit(None).cast("string").alias(c) for c in ("status", "term", "us_or_international", "degree", "url")], F.lit(None).cast("date").alias("date_added"), F.lit(None).cast("double").alias("gre"))
    ids = lambda **a: [r["p_id"] for r in search.search(data, search.check_arguments(a)).collect()]
    assert ids(program="%") == [1] and ids(program="_") == [2]
    assert ids(sort="gpa", order="asc") == [3, 2, 1] and ids(sort="gpa") == [2, 3, 1]


def test_messages(spark):
    bodies = {'{"kind":"scrape_new_data","payload":{"since":5}}': None, '{"kind":"recompute_analytics"}': None, "x": "not json", "[1]": "not an object", '"s"': "not an object",
              "{}": "unknown kind", '{"kind":["a"]}': "unknown kind", '{"kind":5}': "unknown kind", '{"kind":"scrape_new_data","payload":[1]}': "payload", '{"kind":"scrape_new_data","payload":{"since":-1}}': "since",
              '{"kind":"scrape_new_data","payload":{"since":"5"}}': "since", '{"kind":"scrape_new_data","payload":{"since":5.0}}': "since", '{"kind":"scrape_new_data","payload":{"since":true}}': "since",
              '{"kind":"scrape_new_data","payload":{"since":null}}': None, '{"kind":"scrape_new_data","payload":null}': None, '{"kind":"scrape_new_data","payload":"x"}': "payload",
              '{"kind":"recompute_analytics","payload":{}}': None, '{"kind":"recompute_analytics","payload":{"since":5}}': "unknown field", '{"kind":"scrape_new_data","payload":{"since":2147483647}}': None,
              '{"kind":"scrape_new_data","payload":{"since":2147483648}}': "since", '{"kind":"scrape_new_data","payload":{"sinse":5}}': "unknown field", None: "size", '"' + "a" * 70000 + '"': "size"}
    df = inc.route_messages(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {r["body"]: r["reject_reason"] for r in df.collect()} == bodies
    free = inc.route_messages(df.select("body"), {"scrape_new_data": None})
    assert free.filter("reject_reason is null and body like '%sinse%'").count() == 1 and free.filter("body like '%recompute%' and reject_reason <> 'unknown kind'").count() == 0


@pytest.mark.parametrize(
    "pages_,mark,cap,ids,stopped,resume",
    [([[104, 103], [102, 101], [100]], 101, 50, [102, 103, 104], True, None), ([[5], [4], [3]], 1, 2, [4, 5], False, 3), ([[2], [9]], 2, 50, [], True, None), ([[7, 7]], None, 50, [7], False, None)],
)
def test_bounded_read(spark, pages_, mark, cap, ids, stopped, resume):
    df = spark.createDataFrame([(i + 1, x) for i, p in enumerate(pages_) for x in p], "page_no int, result_id int")
    got, state = inc.bounded_read(df, mark, cap)
    row = state.first()
    assert sorted(r["result_id"] for r in got.collect()) == ids and (row["stopped"], row["resume_page"]) == (stopped, resume)


ENTRY = "result_id int, url string, school_text string, program_text string, degree_text string, date_added_text string, decision_text string, tags_text array<string>, comment_text string, listing_json string, scraped_at string, arrival int"


def _entries(spark, *ids):
    return spark.createDataFrame([(i, f"https://x/result/{i}", "Hill College", f"Law {at}", None, "Mar 07, 2026", "accepted", ["GPA 3.10"], None, None, "t", at) for at, i in enumerate(ids)], ENTRY)


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet") if "state" not in str(p)}


def test_batches_are_cleaned_and_added_once(spark, tmp_path):
    store = inc.BatchStore(spark, str(tmp_path))
    assert store.rows().count() == 0 and store.watermark() is None and inc.snapshot_status(store).count() == 0
    inc.apply_batch(store, _entries(spark, 3, 4, 4, 3), "a")
    got = {r["p_id"]: r for r in store.rows().collect()}
    assert {i: (r["program"], r["gpa"], r["status"]) for i, r in got.items()} == {3: ("Law 0, Hill College", 3.1, "Accepted"), 4: ("Law 1, Hill College", 3.1, "Accepted")}
    assert store.watermark() == 4 and inc.snapshot_status(store).first()["total_entries"] == 2
    before = _files(tmp_path)
    inc.apply_batch(store, _entries(spark, 3, 4, 9), "a")  # replayed
    inc.apply_batch(store, _entries(spark, 4, 3), "b")  # nothing new
    assert store.rows().count() == 2 and _files(tmp_path) == before
    inc.apply_batch(store, _entries(spark, 5, 1), "c")
    assert sorted(r["p_id"] for r in store.rows().collect()) == [3, 4, 5] and store.watermark() == 5
    assert before.items() <= _files(tmp_path).items()  # stored rows are not rewritten


def test_a_batch_that_failed_is_not_seen_and_tried_again(spark, tmp_path, monkeypatch):
    store = inc.BatchStore(spark, str(tmp_path))
    inc.apply_batch(store, _entries(spark, 1), "a")
    with monkeypatch.context() as m:
        m.setattr(inc, "snapshot_payload", lambda t: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            inc.apply_batch(store, _entries(spark, 2, 3), "b")
    assert store.rows().count() == 1 and store.watermark() == 1 and (tmp_path / "applicants/batch=b").exists()
    inc.apply_batch(store, _entries(spark, 2, 3), "b")
    assert store.rows().count() == 3 and store.watermark() == 3


def test_only_new_entries_are_cleaned(spark, tmp_path, monkeypatch):
    store = inc.BatchStore(spark, str(tmp_path))
    store.commit("loaded", cleaning.record_to_row(cleaning.clean_entries(_entries(spark, 3, 5))), None)
    cleaned = []
    monkeypatch.setattr(inc, "clean_entries", lambda entries, *keep: (cleaned.append(sorted((r["result_id"] for r in entries.collect()), key=str)), cleaning.clean_entries(entries, *keep))[1])
    inc.apply_batch(store, _entries(spark, 2, 3, 5, 4, 4, 6), "a", since=2)
    assert cleaned == [[4, 6]] and sorted(r["p_id"] for r in store.rows().collect()) == [3, 4, 5, 6]
    # the key that an entry is dealt and judged by is that of its row
    odd = _entries(spark, None, None, 7).selectExpr("result_id", "case arrival when 0 then ' https://x/result/9/ ' when 1 then 'https://x/none' else url end as url", "* except (result_id, url)")
    inc.apply_batch(store, odd, "b")
    assert sorted(r["p_id"] for r in store.rows().collect()) == [3, 4, 5, 6, 7, 9] and store.watermark() == 9


def test_where_a_pull_starts(spark, tmp_path):
    store = inc.BatchStore(spark, str(tmp_path))
    stored = lambda: sorted(r["p_id"] for r in store.rows().collect())
    rows = cleaning.record_to_row(cleaning.clean_entries(_entries(spark, 13, 14, 15)))
    store.commit("loaded", rows, None)
    inc.apply_batch(store, _entries(spark, 12, 15, 17), "0")  # no mark yet: the newest stored id
    assert stored() == [13, 14, 15, 17] and store.watermark() == 17
    inc.apply_batch(store, _entries(spark, 10, 11, 12, 13), "1", since=11)
    assert stored() == [12, 13, 14, 15, 17] and store.watermark() == 17
    inc.apply_batch(store, _entries(spark, 18, 19), "2", since=1000)
    assert stored() == [12, 13, 14, 15, 17] and store.watermark() == 17


def test_a_new_checkpoint_repeats_no_number(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    schema = _entries(spark, 1).drop("arrival").schema
    for k, ids in enumerate([(1, 2), (3,), (2, 4)]):
        _entries(spark, *ids).drop("arrival").write.mode("append").parquet(source)
        store = inc.incremental_pull(spark, source, schema, root, str(tmp_path / f"mark{k // 2}"))
    assert sorted(r["p_id"] for r in store.rows().collect()) == [1, 2, 3, 4] and store.watermark() == 4


def test_refresh_of_the_snapshot(spark, tmp_path):
    store = inc.BatchStore(spark, str(tmp_path))
    assert inc.refresh_snapshot(store) and inc.snapshot_status(store).first()["total_entries"] == 0 and not inc.refresh_snapshot(store)
    rows = cleaning.record_to_row(cleaning.clean_entries(_entries(spark, 1, 2)))
    store.commit("a", rows, 2, refresh=False)
    store.commit("b", rows.limit(0), 2)
    assert inc.snapshot_status(store).first()["total_entries"] == 0 and inc.refresh_snapshot(store) and not inc.refresh_snapshot(store)
    status = inc.snapshot_status(store).first()
    assert (status["total_entries"], status["newest_entry"], status["n_answers"], store.watermark()) == (2, dt.date(2026, 3, 7), 11, 2)
    assert inc.refresh_snapshot(store, force=True) and inc.snapshot_status(store).first()["computed_at"] > status["computed_at"]


def _read_in_order(pages_, pending, budget, mark):
    """Pages one by one, as a reader would fetch them."""
    seen, taken, rest = set(), {}, []
    for position, at in pending:
        while True:
            if budget <= 0:
                rest.append((position, at))
                break
            budget -= 1
            ids = pages_.get(at, [])
            fresh = [i for i in ids if i > mark and i not in seen]
            seen.update(fresh)
            taken.update({i: at for i in fresh})
            if len(fresh) < len(ids) or at + 1 not in pages_:
                break
            at += 1
    return taken, rest


@pytest.mark.parametrize("pending,budget,mark", [([(1, 1)], 3, 0), ([(1, 7), (2, 1), (3, 4)], 8, 0), ([(1, 7), (2, 1), (3, 4)], 50, 81), ([(1, 4), (2, 4), (3, 1)], 6, 84), ([(1, 12), (2, 2)], 0, 0), ([(1, 30), (2, 1)], 4, 81)])
def test_resume_ranges(spark, pending, budget, mark):
    pages_ = {p: [100 - 2 * p, 101 - 2 * p] for p in range(1, 13)}
    entries = spark.createDataFrame([(p, i) for p, ids in pages_.items() for i in ids], "page_no int, result_id int")
    rows, rest = inc.resume_ranges(entries, spark.createDataFrame(pending, "position int, first int"), budget, mark)
    assert ({r["result_id"]: r["page_no"] for r in rows.collect()}, [tuple(r) for r in rest.collect()]) == _read_in_order(pages_, pending, budget, mark)


def test_date_layouts_equal_all_tried(spark):
    texts = [
        "Sep 20, 2026", "September 20, 2026", "May 5, 2026", "sep 2, 2026", "Sept 2, 2026", "20 Sep 2026", "5 May 2026", "2026-9-20", "2026-09-20", "-2026-9-20", "+12026-9-2", "Sep 20 2026",
        "20 September 2026", "Sep  2, 2026", "Sep 31, 2026", "Sep 2, +12026", "Sep 2, -2026", "Jan", "", " ", "20 Sep", "Sep 20", "May 5", "September 20", "20 September", "5 May", "+5 May", "Feb 29", "29 feb", "-5 Sep", None,
    ]
    df = spark.createDataFrame([(x,) for x in texts], "a string")
    whole = F.coalesce(*[F.try_to_date("a", f) for f in t.FULL_DATES])
    day = F.coalesce(*[F.try_to_date(F.concat(F.lit("2000 "), "a"), f"yyyy {f}") for f in t.MONTH_DAYS])
    got = df.select("a", whole.cast("string"), t.parse_date(F.col("a")).cast("string"), day.cast("string"), t.month_day(F.col("a")).cast("string")).collect()
    assert [r for r in got if r[1] != r[2] or r[3] != r[4]] == []
    assert sum(r[2] is not None for r in got) >= 8 and sum(r[4] is not None for r in got) >= 6


def test_cleaning_computes_a_step_once(spark):
    # expressions that later columns use often were copied into each of them: 46 dates parsed and 103 patterns replaced in the plan, now 13 and 48
    names = ("school_text", "program_text", "degree_text", "date_added_text", "decision_text", "comment_text", "listing_json", "source_page_url", "scraped_at", "url")
    # rows that the optimizer can't drop, and no shortened lists
    entries = (spark.range(1).select(F.col("id").cast("int").alias("result_id"), F.array(F.col("id").cast("string")).alias("tags_text"), *[F.col("id").cast("string").alias(n) for n in names])).localCheckpoint()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = cleaning.clean_entries(entries)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("gettimestamp") <= 13 and plan.count("regexp_replace") <= 48
