"""Listing pages as tables: entries, embedded records, links, canonical urls, cursors, url rules, challenge pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "at int, result_id int, school_text string, program_text string, degree_text string, date_added_text string, decision_text string, tags_text array<string>, comment_text string"
LINK = "at int, href string, text string, in_nav boolean"
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


# Tags, comments, raw text of scripts and styles, declarations. A tag comes with the text after it, if an end tag follows, and with the same
# tags that come next with text and end tag: a row of plain elements is one match. Groups: inside of the tag, name, attributes, text, name of the end tag, the elements that follow.
_RAW = tuple("".join(f"[{c}{c.upper()}]" for c in name) for name in ("script", "style"))
_TOKEN = re.compile(
    rf"""<(?:(?!(?:{"|".join(_RAW)})\b)((/?[a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>)(?:([^<]*+)</([a-zA-Z][^\s/>]*)>((?:<\1[^<]*+</\5>)*+))?"""
    + r"|!--.*?(?:-->|\Z)|" + "".join(rf"{x}\b[^>]*>.*?(?:</{x}\s*>|\Z)|" for x in _RAW) + r"[!?][^>]*>)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        # an embedded JSON text is full of quotes
        found.setdefault(name.lower(), unescape(max(values).replace("&quot;", '"')))
    return found


#: Longest attributes of a tag that are remembered, and of how many tags.
KNOWN_CHARS, KNOWN = 64, 4096
_known_attributes = lru_cache(KNOWN)(_attributes)
_READ = frozenset(("td", "div", "span", "tr", "a", "p", "th", "table", "nav"))
_PLAIN = frozenset(("td", "div", "span", "a", "p", "th"))
_VOID = frozenset(("br", "img", "input", "meta", "link", "hr"))
_NONE: dict[str, str] = {}


class _Page:
    """Rows of the page's first table (cells, links, spans, badges, paragraphs), its links (where they are asked for), and its embedded JSON."""

    def __init__(self, with_links: bool = True):
        self.with_links = with_links
        self.rows: list[dict] = []
        self.links: list[list] = []
        self.payload: str | None = None
        self.tables, self.first = 0, True  # only the first table is read
        self.nav = 0
        self.kinds: list[tuple[str, list[str] | None]] = []  # open tags, and where the texts inside them are gathered
        self.gathered: list[list[str]] = []  # these places alone

    def feed(self, html: str) -> None:
        kinds, gathered = self.kinds, self.gathered
        parts = _TOKEN.split(html)
        # the text before a match, and its groups; one more text is left over
        for before, opened, name, rest, data, end, more in zip(*[iter(parts)] * 7):
            if before and gathered:
                self.handle_data(before)
            if not name:
                continue
            tag = name.lower()
            # other tags' attributes are not asked for
            a = _NONE if not rest or tag not in ("div", "tr", "a") else _known_attributes(rest) if len(rest) <= KNOWN_CHARS else _attributes(rest)
            texts = [data, *more[len(opened) + 1 : -len(end) - 3].split(f"</{end}><{opened}")] if more else (data,)
            if end == tag and tag in _PLAIN:
                self.handle_plain(tag, a, texts)
                continue
            for data in texts:
                if tag[0] == "/":
                    self.handle_endtag(tag[1:])
                else:
                    place = self.handle_starttag(tag, a) if tag in _READ else None
                    if tag not in _VOID:
                        kinds.append((tag, place))
                        if place is not None:
                            gathered.append(place)
                if end:
                    if data and gathered:
                        self.handle_data(data)
                    self.handle_endtag(end.lower())
        if gathered:
            self.handle_data(parts[-1])

    def handle_plain(self, tag: str, a: dict[str, str], texts: list[str]) -> None:
        """Elements of nothing but text, each with the tag ``tag``."""
        for data in texts:
            place = self.handle_starttag(tag, a)
            if data:
                if "&" in data:
                    data = unescape(data)
                if place is not None:
                    place.append(data)
                for outer in self.gathered:
                    outer.append(data)

    def handle_starttag(self, tag: str, a: dict[str, str]) -> list[str] | None:
        """Where the texts inside the tag are gathered, if they are."""
        texts: list[str] | None = None
        inside = self.first and self.tables > 0
        row = self.rows[-1] if self.rows and inside else None
        if tag == "td":
            if row:
                texts = []
                row["cells"].append({"texts": texts, "spans": []})
        elif tag == "div":
            if self.payload is None and a.get("id") == "app":
                self.payload = a.get("data-page")
            if row:
                classes = a.get("class", "").split()
                if "tw-inline-flex" in classes:
                    texts = []
                    if "md:tw-hidden" not in classes:
                        row["badges"].append(texts)
        elif tag == "span":
            if row and row["cells"]:
                texts = []
                row["cells"][-1]["spans"].append(texts)
        elif tag == "tr":
            if inside:
                self.rows.append({"class": a.get("class", "").split(), "cells": [], "heads": 0, "href": None, "badges": [], "paragraphs": []})
        elif tag == "a":
            if self.with_links:
                texts = []
                self.links.append([a.get("href"), texts, self.nav > 0])
            if row and row["href"] is None and "/result/" in a.get("href", ""):
                row["href"] = a["href"]
        elif tag == "p":
            if row:
                texts = []
                row["paragraphs"].append(texts)
        elif tag == "th":
            if row:
                row["heads"] += 1
        elif tag == "table":
            self.tables += 1
        elif tag == "nav":
            self.nav += 1
        return texts

    def handle_endtag(self, tag: str) -> None:
        if tag == "nav":
            self.nav = max(0, self.nav - 1)
        if tag == "table" and self.tables:
            self.tables -= 1
            self.first = self.first and self.tables > 0
        kinds = self.kinds
        at = len(kinds) - 1
        while at >= 0 and kinds[at][0] != tag:
            at -= 1
        if at >= 0:
            for _, texts in kinds[at:]:
                if texts is not None:
                    self.gathered.pop()
            del kinds[at:]

    def handle_data(self, data: str) -> None:
        if "&" in data:
            data = unescape(data)
        for texts in self.gathered:
            texts.append(data)


def _flat(texts: list[str]) -> str | None:
    return " ".join("".join(texts).split()) or None


def parse_page(html: str | None, with_links: bool = True) -> _Page:
    page = _Page(with_links)
    page.feed(html or "")
    return page


def _entries(page: _Page) -> list[tuple]:
    """Entries of a page: a main row has a result link and four cells or more; continuation rows add badges and comments."""
    found: list[dict] = []
    for row in page.rows:
        if row["heads"]:
            continue
        tail = (row["href"] or "").rstrip("/").rsplit("/", 1)[-1].split("?")[0]
        if tail.isdigit() and len(row["cells"]) >= 4:
            cells = row["cells"]
            spans = [x for x in (_flat(s) for s in cells[1]["spans"]) if x]
            program, degree = (spans[0], spans[1] if len(spans) > 1 else None) if spans else (_flat(cells[1]["texts"]), None)
            found.append({"id": int(tail), "school": _flat(cells[0]["texts"]), "program": program, "degree": degree, "date": _flat(cells[2]["texts"]), "decision": _flat(cells[3]["texts"]), "tags": [], "comment": []})
        elif "tw-border-none" in row["class"] and found:
            found[-1]["tags"] += [x for x in map(_flat, row["badges"]) if x]
            found[-1]["comment"] += [x for x in map(_flat, row["paragraphs"]) if x]
    return [(i, f["id"], f["school"], f["program"], f["degree"], f["date"], f["decision"], f["tags"], "\n".join(f["comment"]) or None) for i, f in enumerate(found)]


def _structs(rows: list[list[tuple]], kind: str) -> pa.Array:
    """A list of structs for each of ``rows``."""
    names, types = zip(*(x.split() for x in kind.split(", ")), strict=True)
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[i] for x in flat], _ARROW[t]) for i, t in enumerate(types)]
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


#: Pages whose parsed rows are held at once, however many a batch has.
PAGES_AT_ONCE = 32


def parse_batches(batches: Iterator[pa.RecordBatch], columns: list[str], with_links: bool = True) -> Iterator[pa.RecordBatch]:
    """``columns``, entries, payload and (where asked for) links of batches of pages, a few pages at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(at, PAGES_AT_ONCE)
            entries, payloads, links = [], [], []
            for html in batch.column("html").to_pylist():
                # a page's many small lists are let go before the next page's
                page = parse_page(html, with_links)
                entries.append(_entries(page))
                payloads.append(page.payload)
                links.append([(i, href, _flat(texts), nav) for i, (href, texts, nav) in enumerate(page.links) if href])
            found = {"entries": _structs(entries, ENTRY), "payload": pa.array(payloads, pa.string())} | ({"links": _structs(links, LINK)} if with_links else {})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found.values()], [*columns, *found])


def parse_pages(pages: DataFrame, *keep: str, with_links: bool = True) -> DataFrame:
    """(url, keep..., entries, payload, links) of ``pages`` (url, html, keep...): each page is parsed once.

    entries and links are arrays of the structs ENTRY and LINK, payload is the page's embedded JSON text or null. A page without rows has empty arrays.
    Without ``with_links`` there is no column links, and they are not gathered.
    """
    kinds = dict(pages.dtypes)
    columns = ["url", *keep]
    entry, link = (f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in kind.split(', '))}>>" for kind in (ENTRY, LINK))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", entries {entry}, payload string" + (f", links {link}" if with_links else "")
    return pages.select(*columns, "html").mapInArrow(lambda batches: parse_batches(batches, columns, with_links), schema)


def extract_entries(pages: DataFrame, *keep: str) -> DataFrame:
    """(url, keep..., ENTRY) of ``pages`` (url, html, keep...): one page gives any number of rows."""
    return parse_pages(pages, *keep, with_links=False).select("url", *keep, F.inline("entries"))


def attach_page_json(parsed: DataFrame, *keep: str) -> DataFrame:
    """(url, keep..., ENTRY, listing_json, ids_agree) of ``parsed`` (see parse_pages), page by page without a shuffle.

    listing_json is the page's embedded record with the entry's id (the last of several; its id must be a whole number), ids_agree whether the page's two
    sets of ids are equal, null where the JSON is missing or damaged or has no record.
    """
    items = F.coalesce(F.from_json(F.get_json_object("payload", "$.props.results.data"), "array<string>"), F.array().cast("array<string>"))
    number = lambda x: F.when(F.get_json_object(x, "$.id").rlike(r"^-?\d+$") & x.rlike(r'"id"\s*:\s*-?\d'), F.get_json_object(x, "$.id").try_cast("int"))
    records = F.filter(F.transform(items, lambda x: F.struct(number(x).alias("id"), x.alias("json"))), lambda r: r["id"].isNotNull())
    with_records = parsed.select("url", *keep, "entries", records.alias("_records"))
    own, theirs = F.col("entries.result_id"), F.col("_records.id")
    agree = F.when(F.size("_records") > 0, (F.size(F.array_except(own, theirs)) == 0) & (F.size(F.array_except(theirs, own)) == 0))
    flat = with_records.select("url", *keep, "_records", agree.alias("ids_agree"), F.inline("entries"))
    last = F.try_element_at(F.filter("_records", lambda r: r["id"] == F.col("result_id")), F.lit(-1))["json"]
    return flat.withColumn("listing_json", last).drop("_records")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, LINK): the anchors of each page in order."""
    return parse_pages(pages).select("url", F.inline("links"))


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, value) of pages that are cached one per file below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def cached_pages(files: DataFrame) -> DataFrame:
    """(file, url, fetched_at, html) of cached pages (file, modified, value); their header line gives url and time of the fetch.

    A page without a header has its file as url and the file's time; the time is missing in some headers, too.
    """
    head = F.substring_index("value", "\n", 1)
    said = lambda name: F.nullif(F.regexp_extract(head, rf"{name}: (\S+)", 1), F.lit(""))
    url = said("source-url")
    modified = F.date_format(F.to_utc_timestamp("modified", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    html = F.when(url.isNull(), F.col("value")).otherwise(F.substr("value", F.char_length(head) + 2))
    return files.select("file", F.coalesce(url, F.col("file")).alias("url"), F.coalesce(said("fetched-at"), modified).alias("fetched_at"), html.alias("html"))


def reparse_pages(spark: SparkSession, path: str) -> DataFrame:
    """``reparse_files`` of pages that are cached one per file below ``path``; a cache of millions of pages is better kept as a table."""
    return reparse_files(cached_files(spark, path))


def first_copies(cached: DataFrame) -> DataFrame:
    """``cached`` pages (file, html, ...): of those that are equal in html, the first by file. Equal pages list the same entries in the same places, so the others are first for none."""
    others = [c for c in cached.columns if c != "html"]
    # pages are dealt by a digest, and told apart by it and their length
    same = cached.groupBy(F.sha2("html", 256).alias("_sha"), F.octet_length("html").alias("_bytes"))
    return same.agg(F.min_by(F.struct(*others, "html"), F.struct("file")).alias("_page")).select("_page.*")


def reparse_files(files: DataFrame) -> DataFrame:
    """Raw entries of cached pages (file, modified, value), with listing_json, scraped_at and source_page_url: of each id the first by file name (pages are numbered as they were fetched) and place."""
    parsed = parse_pages(first_copies(cached_pages(files)), "file", "fetched_at", with_links=False)
    found = attach_page_json(parsed, "file", "fetched_at")
    placed = found.withColumn("_place", F.struct("file", "at"))
    # an entry always has an id: without a branch for rows that have none, pages are parsed once
    kept = [c for c in found.columns if c not in ("result_id", "file", "at", "ids_agree")]
    first = placed.groupBy("result_id").agg(F.min_by(F.struct(*kept), "_place").alias("_row")).select("result_id", "_row.*")
    return first.withColumnsRenamed({"fetched_at": "scraped_at", "url": "source_page_url"})


def resolve(base: Column, href: Column) -> Column:
    """An absolute url of a link: absolute, from the host's root, or beside the page."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    beside = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(beside, F.lit("/"), href))
    )


def next_links(pages: DataFrame) -> DataFrame:
    """(url, next_url): the first link that says next, one in the pagination nav before others; none off-site."""
    says = F.lower(F.col("text")).startswith("next")
    rank = F.struct((~F.col("in_nav")).alias("outside"), "at")
    best = page_links(pages).filter(says).groupBy("url").agg(F.min_by("href", rank).alias("href"))
    found = best.select("url", resolve(F.col("url"), F.col("href")).alias("next_url"))
    return found.filter(F.try_parse_url("url", F.lit("HOST")) == F.try_parse_url("next_url", F.lit("HOST")))


# The paths that may be asked for, and what they become.
SITE_PATHS = ((r"^/robots\.txt$", "/robots.txt"), (r"^/survey/*$", "/survey"), (r"^/result/0*([0-9]+).*$", "/result/$1"))


def _with(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.try_element_at(F.transform(F.array(c), f), F.lit(1))


def decode_cursor(c: Column) -> Column:
    """struct<created_at string, admit_id long, forward boolean> of a URL-safe base64 cursor, null if it is damaged.

    The stamp must be a real date and time; the id may be a number or a text of digits; a missing direction is forward, another value counts by its truth.
    """
    plain = F.translate(F.regexp_replace(c, "=+$", ""), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.char_length(plain), F.lit(4)).cast("int")))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return _with(text, lambda t: _with(F.struct(t.alias("text"), F.try_parse_json(t).alias("whole")), lambda x: _cursor_fields(x["text"], x["whole"])))


def _cursor_fields(text: Column, whole: Column) -> Column:
    part = lambda path, kind: F.try_variant_get(whole, path, kind)
    # each field is looked up once
    said = F.struct(part("$.created_at", "string").alias("created"), part("$.admitid", "variant").alias("admit"), part("$._pointsToNextItems", "variant").alias("way"))
    return _with(said, lambda x: _checked_fields(text, x["created"], x["admit"], x["way"]))


def _checked_fields(text: Column, stamp: Column, admitted: Column, pointed: Column) -> Column:
    as_a = lambda c, kind: F.try_variant_get(c, "$", kind)
    pattern = r"^(\d{4}-\d{1,2}-\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
    group = lambda i: F.regexp_extract(stamp, pattern, i)
    clock = lambda i, limit: F.when(group(i).try_cast("int") < limit, F.lpad(group(i), 2, "0"))
    day = F.date_format(F.try_to_date(F.nullif(group(1), F.lit("")), "yyyy-M-d"), "yyyy-MM-dd ")
    created = F.concat(day, clock(2, 24), F.lit(":"), clock(3, 60), F.lit(":"), clock(4, 60))  # null if a part is
    kind, said = F.schema_of_variant(admitted), F.trim(as_a(admitted, "string"))
    admit = (
        F.when(kind == "BIGINT", as_a(admitted, "bigint"))
        .when(kind == "STRING", F.when(said.rlike(r"^[+-]?\d+$"), said.try_cast("bigint")))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), as_a(admitted, "double").try_cast("bigint"))
        .when(kind == "BOOLEAN", as_a(admitted, "boolean").cast("bigint"))
    )
    way, raw = F.schema_of_variant(pointed), as_a(pointed, "string")
    truth = F.when(way == "BOOLEAN", raw == "true").when(way == "STRING", raw != "").when(way.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), raw.try_cast("double") != 0)
    truth = truth.when((way == "VOID") | raw.isin("[]", "{}"), False).otherwise(True)
    forward = F.when(F.array_contains(F.json_object_keys(text), "_pointsToNextItems"), truth).otherwise(True)
    fields = F.struct(created.alias("created_at"), admit.alias("admit_id"), forward.alias("forward"))
    return _with(fields, lambda f: F.when(f["created_at"].isNotNull() & f["admit_id"].isNotNull(), f))


def encode_cursor(fields: Column) -> Column:
    text = F.concat(
        F.lit('{"created_at":"'), fields["created_at"], F.lit('","admitid":'), fields["admit_id"].cast("string"),
        F.lit(',"_pointsToNextItems":'), fields["forward"].cast("string"), F.lit("}"),
    )
    return F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def safe_cursor(c: Column) -> Column:
    """A cursor rebuilt from its three fields, null if it is damaged; a whole one stays as it is."""
    return _with(decode_cursor(c), encode_cursor)


def decoded_and_safe(c: Column) -> Column:
    """struct<d, safe>: the fields of ``decode_cursor`` and the text of ``safe_cursor``, decoded once."""
    return _with(decode_cursor(c), lambda d: F.struct(d.alias("d"), encode_cursor(d).alias("safe")))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    """The path without the parameters of its last part."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _argument(url: Column, name: str) -> Column:
    """The first value of a query's argument that is not empty, decoded."""
    return F.try_url_decode(F.nullif(F.regexp_extract(_query(url), rf"(?:^|&){name}=([^&]+)", 1), F.lit("")))


def canonical_url(url: Column, host: Column | str, paths: tuple[tuple[str, str], ...] = SITE_PATHS) -> Column:
    """A url rebuilt from checked parts, null if one is refused: https, the given host (a column or one value), an allowed path (pattern and what it becomes), a whole page number, a cursor."""
    host = F.lit(host) if isinstance(host, str) else host
    path = F.nullif(_path(url), F.lit(""))
    made = F.when(F.lit(False), F.lit(""))
    for pattern, template in paths:
        made = made.when(path.rlike(pattern), F.regexp_replace(path, pattern, template))
    page, cursor = _argument(url, "page"), _argument(url, "cursor")
    number = F.when(F.trim(page).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(page).cast("bigint").cast("string"))
    # null if an argument is there and refused, "" if none is there
    value = lambda given, name, checked: F.when(given.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}="), checked))
    page, cursor = value(page, "page", number), value(cursor, "cursor", safe_cursor(cursor))
    query = F.concat(page, F.when((page != "") & (cursor != ""), "&").otherwise(""), cursor)
    ask = _with(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(q))
    return F.when(_host(url) == host, F.concat(F.lit("https://"), host, made, ask))


def request_path(url: Column) -> Column:
    """Path and query of a url: what url rules are matched against."""
    return F.concat(F.when(_path(url) == "", "/").otherwise(_path(url)), F.when(_query(url) != "", F.concat(F.lit("?"), _query(url))).otherwise(""))


#: Urls and rules meet by so many first characters of a rule at most.
RULE_KEY = 16


def site_rules(files: DataFrame, agent: str) -> DataFrame:
    """(site, allow, pattern): the rules for ``agent`` in rules files (site, text), one per site.

    Lines in order form groups: agent lines, then rules; an agent line after a rule begins the next group. The groups that name a part of the agent
    count, in any case; where there are none, those of *. Comments, other directives and rules without a path are skipped.
    """
    lines = files.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).alias("at", "line"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.substring_index("line", "#", 1)
    split = lines.select("site", "at", F.lower(strip(F.regexp_extract(bare, r"^([^:]*):", 1))).alias("key"), strip(F.regexp_extract(bare, r"^[^:]*:([\s\S]*)$", 1)).alias("value"))
    said = split.filter(F.col("key").isin("user-agent", "allow", "disallow")).withColumn("names", F.col("key") == "user-agent")
    order = Window.partitionBy("site").orderBy("at")  # the lines of one file
    opens = F.col("names") & ~F.coalesce(F.lag("names").over(order), F.lit(True))
    grouped = said.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(order))
    name = F.lower("value")
    groups = grouped.filter("names").groupBy("site", "group").agg(F.max((name != "*") & F.lit(agent.lower()).contains(name)).alias("own"), F.max(name == "*").alias("all"))
    chosen = groups.withColumn("any_own", F.max("own").over(Window.partitionBy("site"))).filter(F.when(F.col("any_own"), F.col("own")).otherwise(F.col("all")))
    rules = grouped.filter(~F.col("names") & (F.col("value") != "")).join(chosen.select("site", "group"), ["site", "group"], "left_semi")
    return rules.select("site", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def rule_pattern(pattern: Column) -> Column:
    """A url rule as a regular expression: * is anything, a trailing $ is the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.array_join(F.transform(F.split(body, r"\*", -1), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), ".*")
    return F.concat(F.lit("^"), quoted, F.when(pattern.endswith("$"), "$").otherwise(""))


def url_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, path, allowed) of different ``urls`` (site, path): by the site's longest matching rule (rules: site, allow, pattern); ties allow, and so does no match.

    A rule meets only paths that begin with its first fixed characters (up to ``RULE_KEY``, before a *): urls and rules are dealt by site and these.
    """
    fixed = F.substr(F.regexp_extract("pattern", r"^([^*$]*)", 1), F.lit(1), F.lit(RULE_KEY))
    keyed = rules.select(F.col("site").alias("_site"), fixed.alias("_key"), "allow", F.char_length("pattern").alias("n"), rule_pattern(F.col("pattern")).alias("rx")).distinct()
    asked = urls.select("site", "path").distinct().select("*", F.explode(F.sequence(F.lit(0), F.least(F.char_length("path"), F.lit(RULE_KEY)))).alias("n_key"))
    asked = asked.withColumn("key", F.substr("path", F.lit(1), F.col("n_key")))
    met = asked.join(keyed, (F.col("site") == F.col("_site")) & (F.col("key") == F.col("_key")) & F.regexp_like("path", F.col("rx")), "left")
    best = met.groupBy("site", "path").agg(F.max(F.when(F.col("rx").isNotNull(), F.struct("n", "allow"))).alias("best"))
    return best.select("site", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def looks_like_rules(c: Column) -> Column:
    """Whether a text can be a rules file: blank, or one that names an agent, and no HTML."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return ~low.contains("<html") & ~low.contains("<!doctype") & (low.rlike(r"(?U)^\s*$") | low.contains("user-agent"))


# Texts that stand on challenge pages only.
CHALLENGE_MARKERS = ("<title>Just a moment...</title>", "cf-chl-bypass", "challenge-error-text")


def challenge_page(c: Column, markers: tuple[str, ...] = CHALLENGE_MARKERS) -> Column:
    """Whether a page is a block or challenge page, by its markers (as they are written)."""
    found = F.lit(False)
    for m in markers:
        found = found | c.contains(m)
    return F.coalesce(found, F.lit(False))
