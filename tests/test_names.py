"""Names: the similarity join against difflib, the source guard, model outputs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions import text as t
from siftworks.operators import model_output, names

ALIASES = [("JHU", "Johns Hopkins University"), ("CMU", "Carnegie Mellon University")]
CANON = ["Johns Hopkins University", "Carnegie Mellon University", "Stanford University", "University of Marlo"]


def worn(name, rng, edits):
    for _ in range(edits):
        at = rng.randrange(len(name) + 1)
        name = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("aeioz é学𝄞") + name[at:], name[:at] + name[at + 1 : at + 2] + name[at : at + 1] + name[at + 2 :]])
    return name


def made(rng, n):
    words = ["university", "college", "of", "north", "south", "Marlo", "Ébène", "tech", "the", "学校", "aaaa", "Institute", "St.", "𝄞𝄞"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)] + ["a", "b", "ab", "abc", "é"] + [" ".join(rng.choices(words, k=14)) for _ in range(15)]


@pytest.mark.parametrize("cutoff", [0.6, 0.84, 0.86, 1.0])
def test_fuzzy_canon_against_brute_force(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    canon = sorted(set(made(rng, 150)))
    asked = sorted({worn(rng.choice(canon), rng, rng.randint(0, 4)) for _ in range(300)} | {"zzz"})
    distinct = dict(map(tuple, spark.createDataFrame([(x,) for x in {*canon, *asked}], "n string").select("n", t.distinctive(F.col("n"))).collect()))
    want = {}
    for name in filter(None, asked):
        near = difflib.get_close_matches(name, canon, n=3, cutoff=cutoff)
        fits = [m for m in near if difflib.SequenceMatcher(None, distinct[name], distinct[m]).ratio() >= 0.8]
        want |= {name: fits[0]} if fits else {}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = names.fuzzy_canon(frame([*asked, *asked[:9], None, ""]).repartition(3), frame([*canon, canon[0]]), cutoff)
    assert dict(map(tuple, got.collect())) == want and len(want) > 50


def test_pairs_stay_few(spark):
    """Of names of one length and many letters in common only near ones are compared."""
    rng = random.Random(5)
    canon = sorted({"University of " + "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)).title() for _ in range(800)})
    asked = sorted({worn(x, rng, 1) for x in canon})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    pairs = names.near_pairs(frame(asked), frame(canon), 0.86).select(F.sum(F.size("candidates"))).first()[0]
    near = sum(difflib.SequenceMatcher(None, a, b).quick_ratio() >= 0.86 for a in asked[:80] for b in canon) / 80
    assert len(asked) <= pairs < min(10 * near * len(asked), 0.05 * len(asked) * len(canon))


def test_fuzzy_canon_of_nothing(spark):
    empty, some = spark.createDataFrame([], "name string"), spark.createDataFrame([("University of Mayra",), ("Stanfrd University",), ("",), (None,)], "name string")
    canon = spark.createDataFrame([(c,) for c in CANON], "name string")
    assert names.fuzzy_canon(empty, canon, 0.86).count() == names.fuzzy_canon(some, empty, 0.86).count() == 0
    assert [tuple(r) for r in names.fuzzy_canon(some, canon, 0.86).collect()] == [("Stanfrd University", "Stanford University")]


def test_source_guard(spark):
    canon = spark.createDataFrame([(c,) for c in CANON], "name string")
    aliases = spark.createDataFrame(ALIASES, "alias string, full string")
    cases = [
        ("Law, University of Mayra", "University of Mayyra", "University of Mayra", "University of Mayra"),  # the text's own spelling
        ("x", "Unrelated", "Unrelated", "Unrelated"),
        ("Botany, JHU", "Jhuu Univrsty", "JHU", "Johns Hopkins University"),  # a part known by its alias
        ("Botany, Stanfrd University", "Elsewhere", "Stanfrd University", "Stanford University"),  # a part near a canonical name
        ("Law, Elsewhere", "cmu", "cmu", "Carnegie Mellon University"),  # an answer known by its alias stays
        ("Law, Carnegie Mellon University", "CARNEGIE MELLON", "Carnegie Mellon University", "Carnegie Mellon University"),
        ("a, b", "", "", "Unknown"),
        ("c, d", None, "", "Unknown"),
        ("  , ,", " odd ", "odd", "Odd"),
    ]
    answers = spark.createDataFrame([c[:2] for c in cases], "text string, university string")
    got = names.prefer_source(answers, "university", lambda n: names.normalize_university(n, aliases, canon))
    assert {r["text"]: (r["university"], r["standard"]) for r in got.collect()} == {c[0]: c[2:] for c in cases}
    assert names.prefer_source(answers.limit(0), "university", lambda n: names.normalize_university(n, aliases, canon)).count() == 0


OUTPUTS = [
    ('{"standardized_program": " Law ", "standardized_university": "MIT"}', ("Law", "MIT", False)),
    ('Sure: {"standardized_university": "MIT",\n "standardized_program": "Law", "why": [1]} and {more}', ("Law", "MIT", False)),
    ('{"standardized_program": "Law"}', ("Law", "", False)),
    ('{"standardized_program": null, "standardized_university": 5}', ("None", "5", False)),
    ("{}", ("", "", False)),
    ('{"standardized_program": {"a": "Law"}}', ("Art", "Yale", True)),
    ('{"standardized_program": "Law"', ("Art", "Yale", True)),
    ("{'standardized_program': 'Law'}", ("Art", "Yale", True)),
    ('["Law"]', ("Art", "Yale", True)),
    ('{"a": 1,}', ("Art", "Yale", True)),
    ("", ("Art", "Yale", True)),
    (None, ("Art", "Yale", True)),
]


def test_model_outputs(spark):
    got = model_output.parse_outputs(spark.createDataFrame([("art, yale", o) for o, _ in OUTPUTS], "text string, output string"))
    assert [tuple(r)[1:] for r in got.collect()] == [w for _, w in OUTPUTS]
    assert model_output.parse_outputs(spark.createDataFrame([(None, None)], "text string, output string")).first()[1:] == ("", "Unknown", True)


def test_model_scorer(spark):
    def load():
        known = {"jhu!": "JHU"}
        return lambda texts: ['ok {"standardized_program": "Law", "standardized_university": "%s"}' % known[x] if x in known else None for x in texts]

    rows = spark.createDataFrame([(1, "jhu!"), (2, "law"), (3, "jhu!"), (4, None)], "id int, text string")
    canon = spark.createDataFrame([(c,) for c in CANON], "name string")
    aliases = spark.createDataFrame(ALIASES, "alias string, full string")
    cache = spark.createDataFrame([], "text string, program string, university string")
    programs = (aliases, spark.createDataFrame([("Law",)], "name string"))
    out = names.standardize_names(rows, "text", "id", cache, programs, (aliases, canon), model_output.model_scorer(load))
    got = {r["id"]: (r["llm_generated_program"], r["llm_generated_university"]) for r in out.collect()}
    assert got == {1: ("Law", "Johns Hopkins University"), 2: ("Law", "Unknown"), 3: ("Law", "Johns Hopkins University"), 4: (None, None)}
