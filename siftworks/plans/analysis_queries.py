"""Registered queries of the analysis and of search, and their SQL."""

from __future__ import annotations

from siftworks.functions import formats
from siftworks.operators import analysis, search
from siftworks.operators import predicates as p
from siftworks.plans.views import applicants, with_sql
from pyspark.sql import functions as F

_CS = r"(?i)(computer\s+science|\beecs\b)"
_AT = " or ".join(
    ["regexp_matches({0}, '(?i)georgetown')", r"regexp_matches({0}, '(?i)massachusetts\s+institute\s+of\s+technology')", r"regexp_matches({0}, '\bMIT\b')",
     "regexp_matches({0}, '(?i)stanford')", r"regexp_matches({0}, '(?i)(carnegie\s+mellon|\bcmu\b)')"]
)
_ACC = "trim(status) ilike 'accept%'"
_F26 = "lower(trim(term)) = 'fall 2026'"
_GPA = "gpa > 0 and gpa <= 4.0"
_PHD = rf"{_F26} and {_ACC} and regexp_matches(degree, '(?i)^\s*ph\.?\s*d')"


def _avg(c: str, where: str = "true") -> str:
    return f"cast(round(cast(avg({c}) filter (where {where}) as decimal(38,10)), 2) as double)"


def _pct(n: str, d: str) -> str:
    return f"cast(round(100.0 * ({n}) / nullif({d}, 0), 2) as double)"


_N_ACC = f"count(*) filter (where {_ACC})"
_ORIG = f"count(*) filter (where regexp_matches(program, '{_CS}') and ({_AT.format('program')}))"
_STD = f"count(*) filter (where regexp_matches(llm_generated_program, '{_CS}') and ({_AT.format('llm_generated_university')}))"

QUESTION_SQL = {
    "q01": f"select count(*) as fall_2026_entries from applicants where {_F26}",
    "q02": "select count(*) filter (where lower(trim(us_or_international)) = 'international') as international_entries, count(*) as classified_entries, "
    + _pct("count(*) filter (where lower(trim(us_or_international)) = 'international')", "count(*)")
    + " as percent_international from applicants where lower(trim(us_or_international)) in ('international', 'american', 'other')",
    "q03": f"select {_avg('gpa', _GPA)} as avg_gpa, count(gpa) filter (where {_GPA}) as gpa_n, {_avg('gre', 'gre between 130 and 170')} as avg_gre_quant, "
    "count(gre) filter (where gre between 130 and 170) as gre_quant_n, "
    f"{_avg('gre_v', 'gre_v between 130 and 170')} as avg_gre_verbal, count(gre_v) filter (where gre_v between 130 and 170) as gre_verbal_n, "
    f"{_avg('gre_aw', 'gre_aw between 0 and 6')} as avg_gre_aw, count(gre_aw) filter (where gre_aw between 0 and 6) as gre_aw_n from applicants",
    "q04": f"select {_avg('gpa')} as avg_gpa, count(gpa) as applicants_with_gpa from applicants where {_F26} and lower(trim(us_or_international)) = 'american' and {_GPA}",
    "q05": f"select {_N_ACC} as accepted_entries, count(*) as fall_2025_entries, {_pct(_N_ACC, 'count(*)')} as acceptance_percent from applicants where lower(trim(term)) = 'fall 2025'",
    "q06": f"select {_avg('gpa')} as avg_gpa, count(gpa) as applicants_with_gpa from applicants where {_F26} and {_ACC} and {_GPA}",
    "q07": r"select count(*) as jhu_cs_masters_entries from applicants where regexp_matches(program, '(?i)(johns?\s+hopkins|\bjhu\b)') "
    rf"and regexp_matches(program, '{_CS}') and regexp_matches(degree, '(?i)^\s*master')",
    "q08": f"select count(*) as accepted_cs_phd_entries from applicants where {_PHD} and regexp_matches(program, '{_CS}') and ({_AT.format('program')})",
    "q09": f"select {_ORIG} as original_field_count, {_STD} as llm_field_count, {_STD} - {_ORIG} as difference from applicants where {_PHD}",
    "q10": f"select degree, count(*) as entries, {_N_ACC} as acceptances, {_pct(_N_ACC, 'count(*)')} as acceptance_percent, "
    f"{_avg('gpa', f'{_ACC} and {_GPA}')} as avg_accepted_gpa from applicants where {_F26} and degree is not null "
    "group by degree having count(*) >= 100 order by entries desc, degree limit 100",
    "q11": f"select llm_generated_university as university, count(*) as entries, {_N_ACC} as acceptances, {_pct(_N_ACC, 'count(*)')} as acceptance_percent "
    f"from applicants where {_F26} and llm_generated_university is not null and llm_generated_university <> 'Unknown' "
    "group by 1 order by entries desc, university limit 10",
}

SEARCH_ARGS = {"term": "FALL 2026", "program": "science", "sort": "gpa", "order": "asc", "limit": "50"}


def _predicates(t):
    """How many rows each predicate holds for."""
    checks = {
        "fall_2026": analysis.fall(2026), "classified": p.one_of("us_or_international", p.NATIONALITIES), "accepted": p.accepted(),
        "jhu": p.matches("program", p.JHU), "cs": p.matches("program", p.COMPUTER_SCIENCE), "mit": F.col("program").rlike(p.MIT_ACRONYM),
        "target": p.at_target_school("program"), "gpa_ok": p.valid_gpa(), "gpa_off": ~p.valid_gpa(), "gre_ok": p.valid_section("gre"),
        "writing_ok": p.valid_writing(), "comments_given": F.col("comments").isNotNull(), "with_percent": p.contains("program", "%"),
    }
    return t.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])


PREDICATES_SQL = (
    "select " + ", ".join(f"count(*) filter (where {w}) as {n}" for n, w in {
        "fall_2026": _F26, "classified": "lower(trim(us_or_international)) in ('international', 'american', 'other')", "accepted": _ACC,
        "jhu": r"regexp_matches(program, '(?i)(johns?\s+hopkins|\bjhu\b)')", "cs": f"regexp_matches(program, '{_CS}')", "mit": r"regexp_matches(program, '\bMIT\b')",
        "target": _AT.format("program"), "gpa_ok": _GPA, "gpa_off": f"not ({_GPA})", "gre_ok": "gre between 130 and 170",
        "writing_ok": "gre_aw between 0 and 6", "comments_given": "comments is not null", "with_percent": "contains(program, '%')",
    }.items()) + " from applicants"
)

NOTES_SQL = (
    f"select count(*) as entries, count(*) filter (where gpa is not null and not ({_GPA})) as gpa_off_scale, "
    "count(*) filter (where gre is not null and not gre between 130 and 170) as gre_off_scale, count(*) filter (where gre between 260 and 340) as gre_totals, "
    "count(*) filter (where gre_v is not null and not gre_v between 130 and 170) as gre_v_off_scale, "
    "count(*) filter (where gre_aw is not null and not gre_aw between 0 and 6) as gre_aw_off_scale, "
    f"{_avg('gre')} as naive_gre_average, min(date_added) as oldest_entry, max(date_added) as newest_entry from applicants"
)

SCALAR_SQL = "select " + ", ".join(
    f"(select {c} from {k}) as {k}_{c}" for k, cs in {
        "q01": ["fall_2026_entries"], "q02": ["international_entries", "classified_entries", "percent_international"],
        "q03": ["avg_gpa", "gpa_n", "avg_gre_quant", "gre_quant_n", "avg_gre_verbal", "gre_verbal_n", "avg_gre_aw", "gre_aw_n"],
        "q04": ["avg_gpa", "applicants_with_gpa"], "q05": ["accepted_entries", "fall_2025_entries", "acceptance_percent"],
        "q06": ["avg_gpa", "applicants_with_gpa"], "q07": ["jhu_cs_masters_entries"], "q08": ["accepted_cs_phd_entries"],
        "q09": ["original_field_count", "llm_field_count", "difference"],
    }.items() for c in cs
)


_COUNT = "coalesce(format('{{:,}}', {0}), '0')"
_AVERAGE = "coalesce(cast(cast({0} as decimal(38,2)) as varchar), 'N/A')"
_WITH_COUNT = f"{_AVERAGE} || ' (n = ' || {_COUNT.replace('{0}', '{1}')} || ')'"
_LINES = [
    (1, "Fall 2026 entries", _COUNT.format("fall_2026_entries"), "q01"),
    (2, "Percent international", f"coalesce({_AVERAGE.format('percent_international')} || case when percent_international is null then '' else '%' end, 'N/A')", "q02"),
    (2, "International entries", _COUNT.format("international_entries"), "q02"), (2, "Classified entries", _COUNT.format("classified_entries"), "q02"),
    (3, "Average GPA", _WITH_COUNT.format("avg_gpa", "gpa_n"), "q03"), (3, "Average GRE Quantitative", _WITH_COUNT.format("avg_gre_quant", "gre_quant_n"), "q03"),
    (3, "Average GRE Verbal", _WITH_COUNT.format("avg_gre_verbal", "gre_verbal_n"), "q03"), (3, "Average GRE Analytical Writing", _WITH_COUNT.format("avg_gre_aw", "gre_aw_n"), "q03"),
    (4, "Average GPA, American, Fall 2026", _WITH_COUNT.format("avg_gpa", "applicants_with_gpa"), "q04"),
    (5, "Fall 2025 acceptances", f"{_AVERAGE.format('acceptance_percent')} || case when acceptance_percent is null then '' else '%' end", "q05"),
    (6, "Average GPA, accepted, Fall 2026", _WITH_COUNT.format("avg_gpa", "applicants_with_gpa"), "q06"),
    (7, "Johns Hopkins computer science masters entries", _COUNT.format("jhu_cs_masters_entries"), "q07"), (8, "Accepted computer science PhD entries", _COUNT.format("accepted_cs_phd_entries"), "q08"),
    (9, "Count on standardized fields", _COUNT.format("llm_field_count"), "q09"), (9, "Difference", "case when difference > 0 then '+' else '' end || cast(difference as varchar)", "q09"),
]
LINES_SQL = " union all ".join(f"select {i} as nth, {n} as number, '{label}' as label, {value} as value from {q}" for i, (n, label, value, q) in enumerate(_LINES))


def _table_sql(question: str, columns: list[str], order: str) -> str:
    cells = ", ".join(f"coalesce(cast({c} as varchar), 'N/A')" for c in columns)
    return f"select {question[1:]}, cast([] as varchar[][]), {columns}, coalesce(list([{cells}] order by {order}), []) from {question}"


PAYLOAD_SQL = f""", lines as ({LINES_SQL}), answers as (
  select number, list([label, value] order by nth) as lines, cast([] as varchar[]) as columns, cast([] as varchar[][]) as "table" from lines group by number
  union all {_table_sql("q10", ["degree", "entries", "acceptances", "acceptance_percent", "avg_accepted_gpa"], "entries desc, degree")}
  union all {_table_sql("q11", ["university", "entries", "acceptances", "acceptance_percent"], "entries desc, university")}
)
select cast(to_json({{'summary': {{'total_entries': (select count(*) from applicants), 'newest_entry': (select cast(max(date_added) as varchar) from applicants)}},
  'answers': list({{'number': number, 'lines': lines, 'columns': columns, 'table': "table"}} order by number)}}) as varchar) as payload from answers"""


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(applicants(spark, sf_dir))
    found = {k: on(f) for k, f in analysis.QUESTIONS.items()}
    found |= {
        "scalar_answers": on(analysis.scalar_answers),
        "summary": on(analysis.summary),
        "data_notes": on(analysis.data_notes),
        "status_counts": on(analysis.status_counts),
        "predicates": on(_predicates),
        "format_answers": on(formats.format_answers),
        "snapshot_payload": on(formats.snapshot_payload),
        "search": on(lambda t: search.search(t, search.check_arguments(SEARCH_ARGS))),
        "fetch_newest": on(lambda t: search.fetch_newest(t, 100)),
    }
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: with_sql(v) for k, v in QUESTION_SQL.items()}
    ctes = ", ".join(f"{k} as ({v})" for k, v in QUESTION_SQL.items() if k < "q10")
    found["scalar_answers"] = with_sql("").rstrip() + f", {ctes} {SCALAR_SQL}"
    found["format_answers"] = with_sql("").rstrip() + f", {ctes} select number, label, value from ({LINES_SQL})"
    every = ", ".join(f"{k} as ({v})" for k, v in QUESTION_SQL.items())
    found["snapshot_payload"] = with_sql("").rstrip() + f", {every} {PAYLOAD_SQL}"
    found["summary"] = with_sql("select count(*) as total_entries, max(date_added) as newest_entry from applicants")
    found["data_notes"] = with_sql(NOTES_SQL)
    found["status_counts"] = with_sql("select status, count(*) as entries from applicants group by 1")
    found["predicates"] = with_sql(PREDICATES_SQL)
    found["search"] = with_sql(
        "select p_id, program, strftime(date_added, '%Y-%m-%d') as date_added, status, term, us_or_international, gpa, gre, degree, url "
        "from applicants where lower(trim(term)) = 'fall 2026' and contains(lower(program), 'science') order by gpa asc nulls last, p_id desc limit 50"
    )
    found["fetch_newest"] = with_sql("select * from applicants order by p_id desc limit 100")
    return found
