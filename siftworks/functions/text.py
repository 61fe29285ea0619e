"""Cleaning rules for self-reported text, as column expressions: whitespace, terms, dates, decisions, badges, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badge texts, statuses, date layouts.
TERM = r"(?iU)^(Fall|Spring|Summer|Winter)\s+(\d{4})$"
CITIZENSHIP = r"(?i)^(International|American|Other)$"
WRITING = r"(?iU)^GRE\s*AW\s*:?\s*([\d.]+)$"
VERBAL = r"(?iU)^GRE\s*V(?:erbal)?\s*:?\s*([\d.]+)$"
GENERAL = r"(?iU)^GRE\s*(?:General|Q(?:uant)?)?\s*:?\s*([\d.]+)$"
GPA = r"(?iU)^GPA\s*:?\s*([\d.]+)$"
DECISION = r"(?iU)^(Accepted|Rejected|Wait\s*listed|Waitlisted|Interview(?:ed)?|Other)(?:\s+on\s+(.+))?$"
STATUS = {
    "accepted": "Accepted", "rejected": "Rejected", "waitlisted": "Waitlisted", "wait listed": "Waitlisted",
    "interview": "Interview", "interviewed": "Interview", "other": "Other",
}
FULL_DATES = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-M-d")
MONTH_DAYS = ("MMM d", "d MMM", "MMMM d", "d MMMM")
PLACEHOLDER = "0"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """All white space to single spaces, outer space cut, nothing left gives null."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def collapse_lines(c: Column) -> Column:
    """The same line by line; blank lines go."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return blank_to_null(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def title(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    chars = F.split(F.lower(c), "")
    letters = F.transform(chars, lambda x, i: F.when((i == 0) | ~F.try_element_at(chars, F.greatest(i, F.lit(1))).rlike(r"(?U)^\p{L}$"), F.upper(x)).otherwise(x))
    return F.array_join(letters, "")


def parse_term(c: Column) -> Column:
    return F.when(c.rlike(TERM), F.concat_ws(" ", F.initcap(F.regexp_extract(c, TERM, 1)), F.regexp_extract(c, TERM, 2)))


def parse_citizenship(c: Column) -> Column:
    return F.when(c.rlike(CITIZENSHIP), F.initcap(c))


def parse_date(c: Column) -> Column:
    """A date in one of the four full layouts, else null. A layout is tried only where its comma, dash or short month can be."""
    short, full, day_first, numeric = [F.try_to_date(c, f) for f in FULL_DATES]
    return F.when(c.contains(","), F.when(_short_month(c), short).otherwise(full)).otherwise(F.when(c.contains("-"), numeric).otherwise(day_first))


def _short_month(c: Column) -> Column:
    """Whether three characters and a space begin the text, as a short month does (and May, which is its own full name)."""
    return F.substr(c, F.lit(4), F.lit(1)) == " "


def iso_date(c: Column) -> Column:
    """The date in the first ten characters, else null."""
    head = F.substr(c, F.lit(1), F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def normalize_status(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    key = F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.coalesce(F.try_element_at(known, key), title(c))


def split_decision(c: Column) -> tuple[Column, Column]:
    """(status, date text) of a decision text; a text of another form is a status alone."""
    known = c.rlike(DECISION)
    status = normalize_status(F.when(known, F.regexp_extract(c, DECISION, 1)).otherwise(c))
    return status, F.when(known, blank_to_null(F.trim(F.regexp_extract(c, DECISION, 2))))


def month_day(text: Column) -> Column:
    """A month and day in one of the four layouts as a date of 2000, else null."""
    short, day_short, full, day_full = [F.try_to_date(F.concat(F.lit("2000 "), text), f"yyyy {f}") for f in MONTH_DAYS]
    return F.when(F.substr(text, F.lit(1), F.lit(1)).between("0", "9"), F.coalesce(day_short, day_full)).when(_short_month(text), short).otherwise(full)


def decision_date(text: Column, added: Column, day: Column | None = None) -> Column:
    """A full date as it is; a month and day in the year of ``added``, or the year before if they'd be after it.

    ``day`` is the text's ``month_day``. All are used several times: columns that are computed already spare work.
    """
    day = month_day(text) if day is None else day
    after = F.month(day) * 100 + F.dayofmonth(day) > F.month(added) * 100 + F.dayofmonth(added)
    year = F.year(added) - after.cast("int")
    placed = F.try_to_date(F.concat(year.cast("string"), F.date_format(day, "-MM-dd")), "yyyy-MM-dd")
    return F.when(day.isNotNull(), placed).otherwise(parse_date(text))


def read_number(c: Column) -> Column:
    """A number in plain or exponent notation, else null; too large a one is infinite."""
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite(c: Column) -> Column:
    """The number if it is finite, else null."""
    return F.when(F.abs(c) < float("inf"), c)


def to_number(c: Column) -> Column:
    """A finite number in plain or exponent notation, else null."""
    return finite(read_number(c))


#: Kinds of badges; a badge is of the first kind that fits it.
KINDS = {"term": TERM, "us_or_international": CITIZENSHIP, "gre_aw": WRITING, "gre_v": VERBAL, "gre": GENERAL, "gpa": GPA}
NUMBERS = ("gre_aw", "gre_v", "gre", "gpa")


def tag_kinds(tags: Column) -> Column:
    """array<struct<kind, tag>> of badges; the kind of a dated decision is decision, that of any other badge null."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != PLACEHOLDER))

    def kind(x: Column) -> Column:
        found = F.when(x.rlike(TERM), "term")
        for name, pattern in list(KINDS.items())[1:]:
            found = found.when(x.rlike(pattern), name)
        return found.when(x.rlike(DECISION) & (F.regexp_extract(x, DECISION, 2) != ""), "decision")

    return F.transform(kept, lambda x: F.struct(kind(x).alias("kind"), x.alias("tag")))


def last_tags(kinds: Column) -> dict[str, Column]:
    """The last badge of each kind from ``tag_kinds``, of a number only its digits."""
    last = lambda name: F.try_element_at(F.filter(kinds, lambda x: x["kind"] == name), F.lit(-1))["tag"]
    return {n: last(n) if n in ("term", "us_or_international") else F.regexp_extract(last(n), pattern, 1) for n, pattern in KINDS.items()}


def other_tags(kinds: Column) -> Column:
    """The badges of no kind."""
    return F.transform(F.filter(kinds, lambda x: x["kind"].isNull()), lambda x: x["tag"])


def classify_tags(tags: Column) -> dict[str, Column]:
    """Badges by kind: the last one of a kind counts; other_tags are those of none."""
    kinds = tag_kinds(tags)
    last = last_tags(kinds)
    found = {"term": parse_term(last["term"]), "us_or_international": parse_citizenship(last["us_or_international"])}
    return found | {n: to_number(last[n]) for n in NUMBERS} | {"other_tags": other_tags(kinds)}


# Words that stay lower-case inside a title, and words that don't tell names apart.
SMALL_WORDS = ("and", "of", "in", "for", "the", "on", "at", "to", "de", "del", "la", "du", "des", "und")
GENERIC_WORDS = (
    "university", "college", "institute", "school", "of", "the", "and", "at", "in",
    "for", "state", "technology", "sciences", "science", "studies", "department",
)
UC_CAMPUSES = {
    "UCLA": "Los Angeles", "UCSD": "San Diego", "UCSB": "Santa Barbara", "UCSC": "Santa Cruz", "UCI": "Irvine",
    "UCD": "Davis", "UCB": "Berkeley", "UCR": "Riverside", "UCM": "Merced", "UCSF": "San Francisco",
}
TRAILING_ABBREVIATION = r"\s*\(([A-Za-z&./\- ]{2,24})\)\s*$"


def smart_title(c: Column) -> Column:
    """First letters upper; small words lower but for the first; short all-capital words kept."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")

    def word(w: Column, i: Column) -> Column:
        capitals = (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) <= 6)
        first = F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))
        return F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).when(capitals, w).otherwise(first)

    return F.array_join(F.transform(words, word), " ")


def distinctive(c: Column) -> Column:
    """The words that tell a name apart; all of them if none does."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*GENERIC_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def source_parts(c: Column) -> Column:
    """The comma-separated parts of a text, then all joins of neighbours."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    joins = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i + 2 <= n),
        lambda i: F.transform(F.sequence(i + 2, n), lambda j: F.array_join(F.slice(parts, i + 1, j - i), ", ")),
    )
    return F.concat(parts, F.flatten(joins))


# Patterns of whole school names, and what they stand for.
SPLIT_SCHOOLS = (
    (r"(?i)^mcg(ill)?(\.)?$", "McGill University"),
    (r"(?i)^(ubc|u\.?b\.?c\.?|university of british columbia)$", "University of British Columbia"),
)


def rule_split(c: Column) -> tuple[Column, Column]:
    """(program, university) of a text by its separators; the university is Unknown if there is none."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    text = F.regexp_replace(text, "^,+|,+$", "")
    parts = F.filter(F.transform(F.split(text, ",| at | @ "), lambda x: F.trim(x)), lambda x: x != "")
    university = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    university = F.coalesce(*[F.when(university.rlike(pattern), full) for pattern, full in SPLIT_SCHOOLS], university)
    named = F.regexp_replace(title(university), r"\bOf\b", "of")
    return title(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))), F.when(university == "", "Unknown").otherwise(named)


def expand_abbreviation(c: Column) -> Column:
    """"Name (ABBR)": a California campus by its name; other mostly upper-case short abbreviations dropped."""
    found = c.rlike(TRAILING_ABBREVIATION)
    short = F.trim(F.regexp_extract(c, TRAILING_ABBREVIATION, 1))
    base = F.trim(F.regexp_replace(c, TRAILING_ABBREVIATION, ""))
    campuses = F.create_map(*[F.lit(x) for kv in UC_CAMPUSES.items() for x in kv])
    campus = F.try_element_at(campuses, F.trim(F.substring_index(F.upper(short), "/", 1)))
    letters = F.regexp_replace(short, "[^A-Za-z]", "")
    upper = F.char_length(F.regexp_replace(letters, "[^A-Z]", ""))
    droppable = (letters != "") & (upper >= 0.6 * F.char_length(letters)) & ~short.contains(" ") & (F.char_length(short) <= 12)
    return (
        F.when(found & campus.isNotNull() & F.lower(base).startswith("university of california"), F.concat(F.lit("University of California, "), campus))
        .when(found & droppable, base)
        .otherwise(c)
    )
