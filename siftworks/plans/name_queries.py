"""Registered queries of name standardization: worn, chatty and cached answers over the derived applicants find the names they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.functions import text as t
from siftworks.operators import model_output, names
from siftworks.plans.views import applicants, with_sql
from siftworks.shared import scratch_path
from siftworks.sources.json_records import read_names

_ALIASES = [("JHU", "Johns Hopkins University"), ("CMU", "Carnegie Mellon University"), ("Carnegie-Mellon", "Carnegie Mellon University"), ("EECS", "Computer Science")]


def _canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).filter("llm_generated_university <> 'Unknown'").select(F.col("llm_generated_university").alias("name")).distinct()


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).select(F.col("llm_generated_program").alias("name")).distinct()


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ALIASES, "alias string, full string")


def _without(c: Column, at: Column) -> Column:
    """A text without its character ``at`` (from 2 on)."""
    return F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + 1))


def fuzzy_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names with one character dropped find the canonical name."""
    a = applicants(spark, sf_dir).filter("llm_generated_university <> 'Unknown'")
    rows = a.select("p_id", _without(F.col("llm_generated_university"), (F.col("p_id") % 6 + 2).cast("int")).alias("name"))
    return rows.join(names.fuzzy_canon(rows, _canon(spark, sf_dir), names.UNIVERSITY_CUTOFF), "name").select("p_id", "match")


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model output for each applicant: clean, in chatter, cut short, empty, missing, with other values, nested, no object."""
    a = applicants(spark, sf_dir).select("p_id", F.col("program").alias("text"), "llm_generated_program", F.element_at(F.split("program", ", "), 2).alias("school"))
    clean = F.to_json(F.struct(F.col("llm_generated_program").alias("standardized_program"), F.concat(F.lit(" "), "school").alias("standardized_university")))
    kinds = [
        clean, F.concat(F.lit("Sure! Here is the answer:\n```json\n"), clean, F.lit("\n``` I hope {this} helps.")), F.substr(clean, F.lit(1), F.lit(30)), F.lit(""),
        F.lit(None).cast("string"), F.concat(F.lit('{"standardized_program": '), F.col("p_id").cast("string"), F.lit(', "standardized_university": null}')),
        F.concat(F.lit('{"standardized_program": {"name": "x"}, "rest": '), clean, F.lit("}")), F.concat(F.lit('["'), "school", F.lit('"]')), F.lit("{'standardized_program': 'x'}"), F.lit("{}"),
    ]
    output = kinds[0]
    for i, kind in enumerate(kinds):
        output = F.when(F.col("p_id") % len(kinds) == i, kind).otherwise(output)
    return a.select("p_id", "text", output.alias("output"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs and universities that model outputs name, or the rules where they name none; how many applicants have each."""
    return model_output.parse_outputs(_outputs(spark, sf_dir)).groupBy("text", "program", "university", "by_rules").agg(F.count("*").alias("n"))


def standardize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of applicants, those of one school answered by a cache with misspelled names, the rest by a model that drops characters."""
    rows = applicants(spark, sf_dir).select("p_id", F.regexp_replace("program", " +", " ").alias("program"))
    worn = F.element_at(F.split("program", ", "), 2)
    texts = rows.select(F.col("program").alias("text"), F.element_at(F.split("program", ", "), 1).alias("program"), _without(worn, F.lit(3)).alias("university")).distinct()
    cache = texts.filter("text like '%, Georgetown%'")

    def scorer(pending: DataFrame) -> DataFrame:
        # in chatter, but for the texts of one program, whose output is cut short
        said = F.to_json(F.struct(F.col("program").alias("standardized_program"), F.col("university").alias("standardized_university")))
        output = F.when(F.col("text").startswith("History"), F.substr(said, F.lit(1), F.lit(9))).otherwise(F.concat(F.lit("Here: "), said))
        return model_output.parse_outputs(pending.join(texts, "text").select("text", output.alias("output"))).drop("by_rules")

    aliases = _aliases(spark)
    out = names.standardize_names(rows, "program", "p_id", cache, (aliases, _programs(spark, sf_dir)), (aliases, _canon(spark, sf_dir)), scorer)
    return out.select("p_id", "llm_generated_program", "llm_generated_university")


def pending_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir).select("p_id", "program")
    answers = rows.filter("p_id < 3").select(F.col("program").alias("text"))
    return names.pending_texts(rows, answers, "program", "p_id")


def merge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = applicants(spark, sf_dir).select(F.col("p_id").cast("string").alias("text"), F.lit("p").alias("program"), F.col("llm_generated_university").alias("university"))
    return names.merge_answers(a, a.filter("cast(text as int) % 4 = 0").withColumn("program", F.lit("later")))


def grow_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School names that applicants use, none of them canonical but those that stand for one of two; all-capital names are fragments."""
    found = applicants(spark, sf_dir).select(F.element_at(F.split("program", ", "), 2).alias("name"))
    canon = _canon(spark, sf_dir).filter("name in ('Stanford University', 'Carnegie Mellon University')")
    return names.grow_canon(found, canon, names.normalize_university(found, _aliases(spark), canon))


def canon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants whose school stands in a list file with blank lines, outer space and repeats; a list that is not there names none."""
    path = scratch_path(spark, "canon")
    canon = _canon(spark, sf_dir).select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("value"))
    canon.unionByName(canon).unionByName(canon.select(F.lit("").alias("value"))).write.text(path)
    rows = applicants(spark, sf_dir).select("p_id", F.element_at(F.split("program", ", "), 2).alias("name"))
    listed = read_names(spark, path).unionByName(read_names(spark, path + "-missing"))
    return names.canon_exact(rows, listed)


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every program and school that applicants write, and whether it is known."""
    part = lambda i: applicants(spark, sf_dir).select(F.element_at(F.split("program", ", "), i).alias("name")).distinct()
    programs = names.normalize_program(part(1), _aliases(spark), _programs(spark, sf_dir)).withColumn("kind", F.lit("program"))
    return programs.unionByName(names.normalize_university(part(2), _aliases(spark), _canon(spark, sf_dir)).withColumn("kind", F.lit("university")))


NORMALIZE_SQL = with_sql("""
select distinct split_part(program, ', ', 1) as original, llm_generated_program as name, true as known, 'program' as kind from applicants
union select distinct split_part(program, ', ', 2), case when llm_generated_university = 'Unknown' then 'Summit University' else llm_generated_university end, llm_generated_university <> 'Unknown', 'university' from applicants""")


def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, distinctive words, parts and abbreviations of programs as they are, with small words and capitals, and with a trailing abbreviation."""
    k, program = F.col("p_id") % 3, F.col("program")
    text = F.when(k == 0, program).when(k == 1, F.concat(F.lit("the "), program, F.lit(", School of OLD ART2"))).otherwise(F.concat(program, F.lit(" (ABC/d)")))
    rows = applicants(spark, sf_dir).groupBy(text.alias("text")).agg(F.count("*").alias("n"))
    c = F.col("text")
    return rows.select("*", t.title(c).alias("title"), t.smart_title(c).alias("smart"), t.distinctive(c).alias("words"), F.array_join(t.source_parts(c), "|").alias("parts"), t.expand_abbreviation(c).alias("plain"))


_SMALL = ", ".join(f"'{w}'" for w in t.SMALL_WORDS)
_GENERIC = ", ".join(f"'{w}'" for w in t.GENERIC_WORDS)
TEXTS_SQL = with_sql("").rstrip() + f"""
, texts as (select case p_id % 3 when 0 then program when 1 then 'the ' || program || ', School of OLD ART2' else program || ' (ABC/d)' end as text, program, p_id % 3 as k from applicants
), grouped as (select text, program, k, count(*) as n from texts group by all
), split as (
  select *, list_filter(string_split(text, ' '), lambda w: w <> '') as w, regexp_extract_all(lower(text), '[a-z0-9]+') as all_words, list_transform(string_split(text, ','), lambda x: trim(x)) as p from grouped
), kept as (select *, list_filter(all_words, lambda x: x not in ({_GENERIC})) as own from split)
select text, n,
  array_to_string(list_transform(range(1, length(text) + 1), lambda i: case when i = 1 or not regexp_matches(lower(text)[(i - 1)::int], '[a-z]') then upper(text[i::int]) else lower(text[i::int]) end), '') as title,
  array_to_string(list_transform(w, lambda x, i: case when i > 1 and lower(x) in ({_SMALL}) then lower(x) when upper(x) = x and lower(x) <> x and length(x) <= 6 then x else upper(x[1]) || x[2:] end), ' ') as smart,
  array_to_string(case when len(own) > 0 then own else all_words end, ' ') as words,
  array_to_string(case len(p) when 2 then [p[1], p[2], p[1] || ', ' || p[2]] else [p[1], p[2], p[3], p[1] || ', ' || p[2], p[1] || ', ' || p[2] || ', ' || p[3], p[2] || ', ' || p[3]] end, '|') as parts,
  case when k = 2 then program else text end as plain
from kept"""


_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ')"
#: Outputs by kind: 0 and 1 have an answer, 5 and 9 an odd one, the others none.
MODEL_SQL = with_sql(f"""
select text, program, university, by_rules, count(*) as n from (
  select program as text, p_id % 10 not in (0, 1, 5, 9) as by_rules,
    case p_id % 10 when 0 then llm_generated_program when 1 then llm_generated_program when 5 then cast(p_id as varchar) when 9 then ''
      else {_TITLE.format("regexp_replace(split_part(program, ', ', 1), ' +', ' ', 'g')")} end as program,
    case p_id % 10 when 0 then split_part(program, ', ', 2) when 1 then split_part(program, ', ', 2) when 5 then 'None' when 9 then ''
      else {_TITLE.format("split_part(program, ', ', 2)")} end as university
  from applicants) group by all""")


def queries() -> dict:
    return {f.__name__: f for f in (model_outputs, fuzzy_canon, canon_exact, normalize_names, name_texts, standardize_names, pending_texts, merge_answers, grow_canon)}


def oracle_sql() -> dict[str, str]:
    return {
        "model_outputs": MODEL_SQL, "normalize_names": NORMALIZE_SQL, "name_texts": TEXTS_SQL,
        "canon_exact": with_sql("select p_id, split_part(program, ', ', 2) as name from applicants where split_part(program, ', ', 2) in (select llm_generated_university from applicants where llm_generated_university <> 'Unknown')"),
        "fuzzy_canon": with_sql("select p_id, llm_generated_university as match from applicants where llm_generated_university <> 'Unknown'"),
        "standardize_names": with_sql(
            "select p_id, llm_generated_program, case when llm_generated_university = 'Unknown' then 'Summit University' else llm_generated_university end as llm_generated_university from applicants"
        ),
        "pending_texts": with_sql("select distinct program as text from applicants where program not in (select program from applicants where p_id < 3)"),
        "merge_answers": with_sql("select cast(p_id as varchar) as text, case when p_id % 4 = 0 then 'later' else 'p' end as program, llm_generated_university as university from applicants"),
        "grow_canon": with_sql(
            "select split_part(program, ', ', 2) as name, count(*) as n from applicants where split_part(program, ', ', 2) in ('Johns Hopkins University', 'Georgetown University', 'Summit University') group by 1 having count(*) >= 2"
        ),
    }
