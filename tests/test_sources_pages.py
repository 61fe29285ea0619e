"""Record files, progress logs, listing pages, cursors, urls and url rules."""

import base64
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftworks.operators import pages
from siftworks.plans import data_queries, page_queries
from siftworks.sources import json_records as js

SCHEMA = "id int, name string"


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_until_bad_reads_one_file_in_many_tasks(spark, tmp_path):
    lines = [json.dumps({"id": i, "name": "x" * 200}) for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:2500], '{"id": 7,', *lines[2500:], "{oops"]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n\n".join(lines[:30]))
    (tmp_path / "c.jsonl").write_text("nonsense\n" + lines[0])
    (tmp_path / "d.jsonl").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = js.read_jsonl_until_bad(spark, str(tmp_path), SCHEMA)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(r["id"] for r in got.collect()) == sorted([*range(2500), *range(30)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_read_records_refuses_anything_but_a_list(spark, tmp_path):
    (tmp_path / "good.json").write_text(' [{"id": 1, "name": "a"},\n {"id": 2}] ')
    assert [tuple(r) for r in js.read_records(spark, str(tmp_path / "good.json"), SCHEMA).orderBy("id").collect()] == [(1, "a"), (2, None)]
    for i, text in enumerate(['{"id": 1}', '[{"id": 1}] [{"id": 2}]', '[{"id": 1}],[]', '[{"id": 1}', "[1]", "[null]"]):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(Exception, match="not a JSON array"):
            js.read_records(spark, str(tmp_path / f"bad{i}.json"), SCHEMA).collect()


def test_gated_ingest(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    files = {"a.json": '[{"id": 1}, {"id": 2}]', "b.json": '[{"id": 3}]'}
    for name, text in files.items():
        (source / name).write_text(text)
    listed = lambda **more: spark.createDataFrame([(n, more.get(n[0], len(t))) for n, t in files.items() if more.get(n[0], 0) is not None], "name string, size long")
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(str(target)).collect())
    assert js.gated_ingest(spark, str(source), listed(), SCHEMA, str(target)) == 3 and ids() == [1, 2, 3]

    def refused(reason, expected):
        with pytest.raises(js.GateError, match=reason):
            js.gated_ingest(spark, str(source), expected, SCHEMA, str(target))
        assert ids() == [1, 2, 3] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["in", "out"]

    refused("size", listed(a=5))
    refused("size", listed(b=None))  # a file that isn't listed
    refused("missing", listed().union(spark.createDataFrame([("c.json", 1)], "name string, size long")))
    for text, reason in (('[{"id": 3}', "no list"), ('{"id": 3}', "no list"), ('[{"id": 3}, 4]', "no list"), ('[{"id": 3}, null]', "something else"), ('[{"id": 3}] []', "no list")):
        (source / "b.json").write_text(text)
        refused(reason, listed(b=len(text)))
    (source / "b.json").write_text("[]")
    assert js.gated_ingest(spark, str(source), listed(b=2), SCHEMA, str(target)) == 2 and ids() == [1, 2]
    (source / "a.json").write_text("[ ]")
    with pytest.raises(js.GateError, match="no record"):
        js.gated_ingest(spark, str(source), listed(a=3, b=2), SCHEMA, str(target))
    assert ids() == [1, 2]


def test_no_file_of_the_gated_query_grows_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(data_queries, "scratch_path", lambda spark, label: f"file://{tmp_path}/{label}")
    assert {r["refused"] for r in data_queries.gated_ingest(spark, "/root/testdata/sf0.001").collect()} == {4}
    # a file of several lists for each file of one
    one, several = (len(list(tmp_path.glob(f"gated/{n}/part-*"))) for n in ("one", "several"))
    assert one == several > 1


def cursor(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


GOOD = '{"created_at":"2026-09-20 12:00:00","admitid":1012103,"_pointsToNextItems":true}'


@pytest.mark.parametrize(
    "text,fields",
    [
        (GOOD, ("2026-09-20 12:00:00", 1012103, True)),
        (GOOD.replace(":true", ":false"), ("2026-09-20 12:00:00", 1012103, False)),
        ('{"created_at":"2026-09-20 12:00:00","admitid":7}', ("2026-09-20 12:00:00", 7, True)),
        ('{"created_at":"2024-2-29 1:02:3","admitid":" 07 ","_pointsToNextItems":null}', ("2024-02-29 01:02:03", 7, False)),
        ('{"created_at":"2026-09-20 12:00:00","admitid":7.9,"_pointsToNextItems":"false"}', ("2026-09-20 12:00:00", 7, True)),
        ('{"created_at":"2026-09-20 12:00:00","admitid":true,"_pointsToNextItems":0}', ("2026-09-20 12:00:00", 1, False)),
        ('{"created_at":"2026-09-20 12:00:00","admitid":-3,"_pointsToNextItems":[]}', ("2026-09-20 12:00:00", -3, False)),
        ('{"created_at":"2026-13-45 99:99:99","admitid":7}', None),
        ('{"created_at":"2023-02-29 00:00:00","admitid":7}', None),
        ('{"created_at":"2026-09-20 24:00:00","admitid":7}', None),
        ('{"created_at":"2026-09-20","admitid":7}', None),
        ('{"created_at":"2026-09-20 12:00:00","admitid":"7.5"}', None),
        ('{"created_at":"2026-09-20 12:00:00","admitid":null}', None),
        ('{"created_at":"2026-09-20 12:00:00","id":7}', None),
        ('{"admitid":7}', None),
        ("[1]", None),
        ("{", None),
        ("", None),
    ],
)
def test_cursor(spark, text, fields):
    got = frame(spark, [cursor(text)]).select(pages.decode_cursor(F.col("c")).alias("d"), pages.safe_cursor(F.col("c")).alias("s")).first()
    assert (got["d"] and tuple(got["d"])) == fields
    if fields:
        assert json.loads(base64.urlsafe_b64decode(got["s"] + "==")) == dict(zip(("created_at", "admitid", "_pointsToNextItems"), fields, strict=True))
    assert text != GOOD or got["s"] == cursor(text)


def test_a_cursor_is_decoded_once(spark):
    made = frame(spark, [cursor(GOOD), cursor(GOOD.replace(":true", ":0")), "zz", None])
    got = made.select(pages.decoded_and_safe(F.col("c")).alias("x"), pages.decode_cursor(F.col("c")).alias("d"), pages.safe_cursor(F.col("c")).alias("safe"))
    assert all((r["x"] and (r["x"]["d"], r["x"]["safe"])) in ((r["d"], r["safe"]), r["d"]) for r in got.collect())
    query = page_queries.decode_cursor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert query.lower().count("parsejson") == 1


def test_odd_cursors_and_urls(spark):
    assert [r[0] for r in frame(spark, ["zz", "!!", None, "e30"]).select(pages.decode_cursor(F.col("c"))).collect()] == [None] * 4
    c, bad = cursor(GOOD), cursor("{}")
    host = "www.example.com"
    want = {
        f"https://{host}/survey/?cursor={c}": f"https://{host}/survey?cursor={c}", f"ftp://{host.upper()}/survey?page=007&x=1": f"https://{host}/survey?page=7",
        f"https://{host}/survey?cursor={c}&page=2": f"https://{host}/survey?page=2&cursor={c}", f"https://{host}/survey?page=&cursor=": f"https://{host}/survey",
        f"https://{host}/result/0012/x?y#z": f"https://{host}/result/12", f"https://{host}/robots.txt": f"https://{host}/robots.txt", f"https://{host}/survey;a?page=%203": f"https://{host}/survey?page=3",
        f"https://{host}/survey?cursor={bad}": None, f"https://{host}/survey?page=1.5": None, f"https://{host}/": None, f"https://x.{host}/survey": None, f"https://me@{host}/survey": None,
        f"https://{host}/surveys": None, "": None, None: None,
    }
    got = frame(spark, want).select("c", pages.canonical_url(F.col("c"), host).alias("u")).collect()
    assert {r["c"]: r["u"] for r in got} == want


RULES = "Disallow: /never\n# note\nUser-Agent: Bot # ours\nuser-agent: other\nDisallow: /bot\nCrawl-delay: 1\nAllow: /bot/open$\nDisallow:\nUser-agent: *\nDisallow: /private\nno colon\nAllow: /private*x\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: /eq\nAllow: /eq\n"


@pytest.mark.parametrize(
    "agent,denied",
    [("TidyBot/2.0", {"/bot", "/bot/open?x"}), ("reader", {"/private", "/private/y?q=1", "/a.pdf"}), ("anOTHER", {"/bot", "/bot/open?x"})],
)
def test_rules(spark, agent, denied):
    paths = ["/bot", "/bot/open", "/bot/open?x", "/private", "/private/ax", "/private/y?q=1", "/a.pdf", "/a.pdf?x", "/eq", "/never", "/"]
    files = spark.createDataFrame([("s", RULES), ("empty", ""), ("none", None), ("crlf", RULES.replace("\n", "\r\n"))], "site string, text string")
    urls = spark.createDataFrame([(s, p) for s in ("s", "empty", "none", "crlf", "missing") for p in [*paths, "/"]], "site string, path string")
    got = pages.url_rules(urls, pages.site_rules(files, agent)).collect()
    assert len(got) == 5 * len(paths)
    assert {(r["site"], r["path"]) for r in got if not r["allowed"]} == {(s, p) for s in ("s", "crlf") for p in denied}


def test_an_agent_without_rules_is_still_named(spark):
    files = spark.createDataFrame([("s", "User-agent: bot\nUser-agent: *\nCrawl-delay: 3\n\nUser-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /")], "site string, text string")
    urls = spark.createDataFrame([("s", "/a")], "site string, path string")
    # agent lines without a rule between them are one group, which * shares
    assert pages.url_rules(urls, pages.site_rules(files, "bot")).first()["allowed"] and not pages.url_rules(urls, pages.site_rules(files, "x")).first()["allowed"]


def test_request_path_and_markers(spark):
    urls = ["http://h/a/b;c?q=1#f", "http://h", "http://h?x", "/p;d/e", "http://h/a?#x", None]
    assert [r[0] for r in frame(spark, urls).select(pages.request_path(F.col("c"))).collect()] == ["/a/b?q=1", "/", "/?x", "/p;d/e", "/a", None]
    texts = ["<title>Just a moment...</title>", "just a moment captcha", "x cf-chl-bypass", None, " ", "User-agent: *", "<HTML>user-agent", "words"]
    got = frame(spark, texts).select(pages.challenge_page(F.col("c")), pages.looks_like_rules(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, False), (False, True), (False, True), (False, True), (False, False), (False, False)]


PAGE = """<html><div id="other" data-page="x"></div><div id="app" data-page='{"props":{"results":{"data":[{"id":3,"v":"old"},{"id":"2"},{"id":3,"v":"new"},5]}}}'></div>
<table><tr><th>h</th></tr><tr><td>S</td><td><span>P</span></td><td>d</td><td>ok</td><td><a href="/result/3">x</a></td></tr></table><table><tr><td>1</td><td>2</td><td>3</td><td><a href="/result/9">y</a></td></tr></table><a href="/n">Next</a></html>"""


def test_pages_are_parsed_once(spark):
    rows = [("u", PAGE, 1), ("v", None, 2), ("w", PAGE.replace("[{", "{"), 3), ("x", "<table><tr>" + "<td>" * 5, 4)]
    parsed = pages.parse_pages(spark.createDataFrame(rows, "url string, html string, at_fetch int"), "at_fetch")
    got = pages.attach_page_json(parsed, "at_fetch").orderBy("url").collect()
    assert [(r["url"], r["at_fetch"], r["result_id"], r["school_text"], r["ids_agree"]) for r in got] == [("u", 1, 3, "S", True), ("w", 3, 3, "S", None)]
    assert json.loads(got[0]["listing_json"])["v"] == "new" and got[1]["listing_json"] is None
    assert {r["url"]: len(r["links"]) for r in parsed.collect()} == {"u": 3, "v": 0, "w": 3, "x": 0}


def test_a_batch_of_pages_is_parsed_in_parts(spark):
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(1000)], "html": [PAGE] * 1000})
    parts = list(pages.parse_batches(iter([batch]), ["url"]))
    # what is held at once does not grow with the batch
    assert max(p.num_rows for p in parts) <= pages.PAGES_AT_ONCE < 100 and [u for p in parts for u in p.column("url").to_pylist()] == [str(i) for i in range(1000)]
    assert all(len(e) == 1 and e[0]["result_id"] == 3 for p in parts for e in p.column("entries").to_pylist())


def test_cached_pages(spark, tmp_path):
    (tmp_path / "page_00002.html").write_text("<!-- bot source-url: https://h/2 fetched-at: 2026-09-02T00:00:00+00:00 -->\n" + PAGE)
    (tmp_path / "page_00001.html").write_text("<!-- bot source-url: https://h/1 -->\n" + PAGE.replace(">S<", ">first<"))
    (tmp_path / "page_00003.html").write_text(PAGE.replace("/result/3", "/result/4"))
    got = {r["result_id"]: r for r in pages.reparse_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {3, 4} and (got[3]["school_text"], got[3]["source_page_url"]) == ("first", "https://h/1")
    assert got[4]["source_page_url"].endswith("page_00003.html") and all(len(r["scraped_at"]) == 25 for r in got.values())


def test_a_cache_is_a_folder_or_a_table(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"page_{n}.html").write_text(f"<!-- source-url: https://h/{n} -->\n" + PAGE)
    files = pages.cached_files(spark, str(tmp_path))
    found = pages.reparse_files(files)
    assert found.collect() == pages.reparse_pages(spark, str(tmp_path)).collect() and [r["source_page_url"] for r in found.collect()] == ["https://h/1"]
    # each page is parsed once
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_equal_cached_pages_are_parsed_once(spark):
    def page(head, html):
        return f"<!-- source-url: https://h/{head} fetched-at: 2026-09-0{head}T00:00:00+00:00 -->\n{html}"

    other = PAGE.replace("/result/3", "/result/4")
    rows = [("c", page(1, PAGE)), ("b", page(2, PAGE)), ("d", PAGE), ("e", page(4, other)), ("f", page(5, other + " ")), ("g", None), ("h", None)]
    files = spark.createDataFrame(rows, "file string, value string").withColumn("modified", F.current_timestamp())
    one = pages.first_copies(pages.cached_pages(files))
    assert sorted(r["file"] for r in one.collect()) == ["b", "e", "f", "g"]
    # no link is asked for
    assert "links" not in pages.parse_pages(one, "file", with_links=False).columns
    got = sorted((r["result_id"], r["source_page_url"], r["scraped_at"], r["school_text"]) for r in pages.reparse_files(files).collect())
    assert got == [(3, "https://h/2", "2026-09-02T00:00:00+00:00", "S"), (4, "https://h/4", "2026-09-04T00:00:00+00:00", "S")]


def test_elements_of_one_match():
    badge = '<div class="tw-inline-flex">'
    html = f"<TABLE><tr><td>a</td><td> b &amp; c </td><td>d<td>e</TD></td><td>f</td><td>{badge}x</div>{badge}y</div>{badge}</div><div>z</div><a href='/result/5'>s</a><a href='/q'>t</a></td></tr><tr class='tw-border-none'><td>{badge}1</div>{badge}2</span>3</div><p>p</p><p></p><p>q<br>r</p></table>{badge}no</div>"
    page = pages.parse_page(html)
    assert ["".join(c["texts"]) for c in page.rows[0]["cells"]] == ["a", " b & c ", "de", "e", "f", "xyzst"]
    assert pages._entries(page) == [(0, 5, "a", "b & c", None, "de", "e", ["1", "23"], "p\nqr")]
    assert [(href, "".join(texts)) for href, texts, _ in page.links] == [("/result/5", "s"), ("/q", "t")]
    assert pages._entries(pages.parse_page(html, False)) == pages._entries(page) and not pages.parse_page(html, False).links
