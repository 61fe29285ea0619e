"""Name standardization: each distinct text once, alias tables, canonical lists, an exact similarity join with the canonical names."""

from __future__ import annotations

import difflib
import hashlib
import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions import text as t
from siftworks.shared import materialize

PROGRAM_CUTOFF, UNIVERSITY_CUTOFF, WORDS_CUTOFF, SOURCE_CUTOFF = 0.84, 0.86, 0.8, 0.7

#: Characters whose frequency orders the characters of a name; the order decides how many candidates there are, not which matches.
RANKED = 4_096
#: From this length on, names meet by single characters.
LONG_NAME = 64

# Short spellings of universities, first match counts.
ABBREVIATIONS = [
    (r"(?i)^mcg(\.|ill)?$", "McGill University"),
    (r"(?i)^(ubc|u\.?b\.?c\.?)$", "University of British Columbia"),
    (r"(?i)^uoft$", "University of Toronto"),
    (r"(?i)^(jhu|johns? hopkins)$", "Johns Hopkins University"),
    (r"(?i)^(mit)$", "Massachusetts Institute of Technology"),
    (r"(?i)^(nyu)$", "New York University"),
    (r"(?i)^(ucla)$", "University of California, Los Angeles"),
    (r"(?i)^(usc)$", "University of Southern California"),
]


def pending_texts(rows: DataFrame, answers: DataFrame, column: str, sequence: str) -> DataFrame:
    """(text) without an answer (answers: text, ...), in order of first sight."""
    seen = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.min(sequence).alias("first"))
    return seen.join(answers.select("text"), "text", "left_anti").orderBy("first").select("text")


def merge_answers(*sources: DataFrame) -> DataFrame:
    """Answers (text, program, university) of several tables; the last table that has a text wins."""
    tagged = [s.select("text", "program", "university", F.lit(i).alias("_order")) for i, s in enumerate(sources)]
    whole = tagged[0]
    for s in tagged[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("text").agg(F.max_by(F.struct("program", "university"), "_order").alias("a")).select("text", "a.*")


def map_answers(rows: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """``rows`` with llm_generated_program and llm_generated_university where there is an answer."""
    named = answers.select(F.col("text").alias(column), F.col("program").alias("llm_generated_program"), F.col("university").alias("llm_generated_university"))
    return rows.join(named, column, "left")


def alias_join(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """``column`` replaced by its alias (aliases: alias, full; any case) where it has one. AQE broadcasts a small table."""
    table = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("full").alias("_full"))
    joined = names.join(table, F.lower(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_full", column)).drop("_alias", "_full")


def abbreviation(c: Column) -> Column:
    """The first of the fixed patterns that fits the whole name gives its full form."""
    found = F.when(c.rlike(ABBREVIATIONS[0][0]), ABBREVIATIONS[0][1])
    for pattern, full in ABBREVIATIONS[1:]:
        found = found.when(c.rlike(pattern), full)
    return found.otherwise(c)


def canon_exact(names: DataFrame, canon: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose name is canonical (canon: name)."""
    return names.join(canon.select(F.col("name").alias(column)), column, "left_semi")


def _character_counts(canon: DataFrame) -> dict[str, int]:
    """How often canonical names use each of their ``RANKED`` most frequent characters; others count as unused."""
    characters = F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substr("name", i, F.lit(1)))
    counts = canon.filter("name <> ''").select(F.explode(characters).alias("c")).groupBy("c").count()
    return {r["c"]: r["count"] for r in counts.orderBy(F.desc("count"), "c").limit(RANKED).collect()}


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _join_keys(name: str, cutoff: float, counts: dict[str, int]) -> tuple[list[int], int, int]:
    """The keys by which ``name`` meets every name that it can have a ratio of ``cutoff`` with, and the two halves of a map of its characters.

    A ratio of c needs c (a + b) / 2 common characters, repeats told apart by their number. Then, in any order that all names share, the first
    n - needed + k characters of both have k in common. A key is a pair of these characters, or a single one where a pair isn't
    sure to exist (names of one character, low cutoffs) or there would be too many pairs (long names). Each character flips one of the
    map's 128 bits, so that two maps never differ in more bits than their names in characters.
    """
    n = len(name)
    # names shorter than this can't be near: 2 shortest / (n + shortest) >= cutoff
    shortest = max(1, math.ceil(n * cutoff / (2 - cutoff) - 1e-9))
    needed = max(1, math.ceil(cutoff * (n + shortest) / 2 - 1e-9))
    seen: dict[str, int] = {}
    marks, bits = [], 0
    for c in name:
        seen[c] = seen.get(c, 0) + 1
        code = int.from_bytes(hashlib.blake2b(f"{c}{seen[c]}".encode(), digest_size=8).digest(), "little")
        marks.append((counts.get(c, 0) // 4 ** (seen[c] - 1), c, seen[c], code))
        bits ^= 1 << code % 128
    marks.sort()  # the rarest first
    codes = [code for *_, code in marks[: n - needed + 2]]
    one = cutoff <= 2 / 3 or n == 1
    single = codes[: n - needed + 1] if one or n * (2 - cutoff) / cutoff + 1e-9 >= LONG_NAME else []
    pairs = [] if one or n >= LONG_NAME else [x * 31 + y * 17 + 1 for x, y in itertools.combinations(codes, 2)]
    return [_signed(x) for x in {*single, *pairs}], _signed(bits >> 64), _signed(bits)


def near_pairs(names: DataFrame, canon: DataFrame, cutoff: float) -> DataFrame:
    """(name, candidates) of distinct (name): every canonical name that can have a ratio of ``cutoff`` with it, and few others.

    Both sides are dealt by pairs of their rarest characters, so neither list, nor all names of a length, meet in one task; lengths and
    maps of characters rule out most of those that meet before they are written.
    """
    counts = _character_counts(canon)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([_join_keys(x, cutoff, counts) for x in batch["name"]], columns=["keys", "high", "low"])
            yield found.assign(name=batch["name"].to_numpy(), n=batch["name"].str.len().to_numpy())

    def keys(df: DataFrame) -> DataFrame:
        marked = df.select("name").mapInPandas(keyed, "name string, n int, high long, low long, keys array<long>")
        return marked.select("name", "n", "high", "low", F.explode("keys").alias("key"))

    theirs = keys(canon.filter("name <> ''").select("name").distinct()).select("key", F.col("name").alias("candidate"), F.col("n").alias("m"), F.col("high").alias("high_"), F.col("low").alias("low_"))
    total = F.col("n") + F.col("m")
    differ = F.bit_count(F.col("high").bitwiseXOR(F.col("high_"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("low_")))
    fits = (2 * F.least("n", "m") >= F.lit(cutoff - 1e-9) * total) & (differ <= F.lit(1 - cutoff + 1e-9) * total)
    return keys(names).join(theirs, "key").filter(fits).groupBy("name").agg(F.collect_set("candidate").alias("candidates"))


def fuzzy_canon(names: DataFrame, canon: DataFrame, cutoff: float, column: str = "name") -> DataFrame:
    """(name, match) of each distinct name with a canonical one near enough; names without one are absent.

    Of the three most similar canonical names of at least ``cutoff`` (ties: the larger name first), the first whose distinctive
    words are similar too. Null and empty names have no match; a canonical name finds itself.
    """
    distinct = names.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    words = t.distinctive(F.col("name"))
    pairs = near_pairs(distinct, canon, cutoff).withColumns({"words": words, "their_words": F.transform("candidates", t.distinctive)})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher()
        for batch in batches:
            rows = []
            for name, candidates, own, theirs in zip(batch["name"], batch["candidates"], batch["words"], batch["their_words"], strict=True):
                matcher.set_seq2(name)
                near = []
                for candidate, other in zip(candidates, theirs, strict=True):
                    matcher.set_seq1(candidate)
                    if matcher.quick_ratio() >= cutoff and (ratio := matcher.ratio()) >= cutoff:
                        near.append((ratio, candidate, other))
                fits = (c for _, c, other in heapq.nlargest(3, near) if difflib.SequenceMatcher(None, own, other).ratio() >= WORDS_CUTOFF)
                if (match := next(fits, None)) is not None:
                    rows.append((name, match))
            yield pd.DataFrame(rows, columns=["name", "match"])

    return pairs.mapInPandas(best, "name string, match string")


def _standard(names: DataFrame, start: Column, aliases: DataFrame, canon: DataFrame, cutoff: float) -> DataFrame:
    """(original, name, known) of distinct (name): from ``start`` of it by alias and title to the canonical form; known: it has one, or is near one itself."""
    begun = names.select(F.col("name").alias("original"), start.alias("name")).distinct()
    titled = alias_join(begun, aliases).withColumn("name", t.smart_title(F.col("name")))
    asked = titled.select("name").unionByName(titled.select(F.trim("original").alias("name"))).distinct()
    listed = canon.select("name", F.col("name").alias("match")).distinct()
    found = listed.unionByName(fuzzy_canon(asked.join(listed, "name", "left_anti"), canon, cutoff))
    itself = found.select(F.col("name").alias("_trimmed"), F.lit(True).alias("_near"))
    joined = titled.join(found, "name", "left").join(itself, F.trim("original") == F.col("_trimmed"), "left")
    return joined.select("original", F.coalesce("match", "name").alias("name"), (F.col("match").isNotNull() | F.col("_near").isNotNull()).alias("known"))


def normalize_program(names: DataFrame, aliases: DataFrame, canon: DataFrame) -> DataFrame:
    """(original, name, known) of distinct (name): alias, title, canonical."""
    return _standard(names, F.trim("name"), aliases, canon, PROGRAM_CUTOFF)


def normalize_university(names: DataFrame, aliases: DataFrame, canon: DataFrame) -> DataFrame:
    """(original, name, known) of distinct (name): abbreviation, alias, title, canonical; Unknown if nothing is left."""
    found = _standard(names, t.expand_abbreviation(abbreviation(F.trim("name"))), aliases, canon, UNIVERSITY_CUTOFF)
    return found.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")))


def prefer_source(answers: DataFrame, column: str, normalize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``answers`` (text, column, ...) with an unknown answer replaced by the part of the text most like it (first of the best), and ``standard``, its normal form.

    normalize gives (original, name, known) of distinct (name). A known part counts as equal; below ``SOURCE_CUTOFF`` the answer stays.
    Each name is normalized once: the answers, then the parts of texts whose answer is unknown. A null answer counts as empty.
    """
    answers = answers.withColumn(column, F.trim(F.coalesce(column, F.lit(""))))
    own = materialize(normalize(answers.select(F.col(column).alias("name")).distinct()), "names")
    marked = answers.join(own.select(F.col("original").alias(column), F.col("name").alias("_own"), "known"), column)
    parts = marked.filter(~F.col("known") & (F.col(column) != "")).select("text", column, F.posexplode(t.source_parts(F.col("text"))).alias("at", "part"))
    theirs = materialize(normalize(parts.select(F.col("part").alias("name")).distinct()), "parts")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    judged = parts.join(theirs.select(F.col("original").alias("part"), F.col("name").alias("part_name"), F.col("known").alias("part_known")), "part")
    scored = judged.withColumn("ratio", F.when(F.col("part_known"), F.lit(1.0)).otherwise(ratio(column, "part")))
    best = scored.groupBy("text").agg(F.max_by(F.struct("part", "part_name", "ratio", F.col(column).alias("said")), F.struct("ratio", -F.col("at"))).alias("b"))
    use = best.filter((F.col("b.ratio") >= SOURCE_CUTOFF) & (F.lower("b.part") != F.lower("b.said"))).select("text", F.col("b.part").alias("_part"), F.col("b.part_name").alias("_theirs"))
    settled = marked.join(use, "text", "left")
    return settled.withColumns({column: F.coalesce("_part", column), "standard": F.coalesce("_theirs", "_own")}).drop("_part", "_theirs", "_own", "known")


def rule_scorer(texts: DataFrame) -> DataFrame:
    """(text, program, university) by separators: the scorer used where no model is given."""
    program, university = t.rule_split(F.col("text"))
    return texts.select("text", program.alias("program"), university.alias("university"))


def standardize_names(
    rows: DataFrame, column: str, sequence: str, cache: DataFrame, programs: tuple[DataFrame, DataFrame], universities: tuple[DataFrame, DataFrame],
    scorer: Callable[[DataFrame], DataFrame] = rule_scorer,
) -> DataFrame:
    """``rows`` with standardized names; each distinct text is scored once, and cached answers are normalized again.

    programs and universities are (aliases, canon) tables.
    """
    # written down: canonical names, and one row per distinct text, which the steps below read again
    programs, universities = ((aliases, materialize(canon.select("name").distinct(), "canon")) for aliases, canon in (programs, universities))
    answers = materialize(merge_answers(cache, scorer(pending_texts(rows, cache, column, sequence))), "answers")
    final = answers.select("text")
    for name, normalize, tables in (("program", normalize_program, programs), ("university", normalize_university, universities)):
        settled = prefer_source(answers.select("text", name), name, lambda names, f=normalize, tables=tables: f(names, *tables))
        final = final.join(settled.select("text", F.col("standard").alias(name)), "text")
    return map_answers(rows, final, column)


def grow_canon(names: DataFrame, canon: DataFrame, normalized: DataFrame, min_count: int = 2) -> DataFrame:
    """(name, n): normalized names (normalized: original, name) that aren't canonical, often enough, most frequent first."""
    counted = names.select(F.trim("name").alias("original")).groupBy("original").agg(F.count("*").alias("n"))
    letters = F.regexp_replace("original", r"(?U)[^\p{L}]", "")
    one_word = F.size(F.filter(F.split("original", r"(?U)\s+"), lambda w: w != "")) == 1
    fragment = (F.char_length("original") < 3) | (one_word & (letters != "") & (F.upper(letters) == letters) & (F.lower(letters) != letters))
    kept = counted.filter((F.col("original") != "") & ~fragment).join(normalized, "original")
    return kept.groupBy("name").agg(F.sum("n").alias("n")).join(canon, "name", "left_anti").filter(F.col("n") >= min_count).orderBy(F.desc("n"), "name")
