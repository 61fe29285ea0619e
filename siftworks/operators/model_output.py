"""Answers of a language model as columns: the first JSON object in its chatter, typed; what has none goes by the rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.functions import text as t

# The first object in a text, and the fields of an answer.
OBJECT = r"(?s)\{.*?\}"
FIELDS = ("standardized_program", "standardized_university")


def parse_output(c: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """struct<fields: string> of the first object in a model's output, null if there is none or it is damaged.

    The object ends at its first closing brace, so one that holds another is damaged. A missing field is empty, a null
    one is the text None, other values are as JSON writes them; outer white space is cut.
    """
    found = F.regexp_extract(F.coalesce(c, F.lit("")), OBJECT, 0)
    schema = ", ".join(f"{f} string" for f in (*fields, "_bad"))
    parsed = F.from_json(found, schema, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    keys = F.json_object_keys(found)
    value = lambda f: F.when(F.array_contains(keys, f), F.regexp_replace(F.coalesce(parsed[f], F.lit("None")), r"(?U)^\s+|\s+$", "")).otherwise("")
    return F.when((found != "") & parsed["_bad"].isNull() & keys.isNotNull(), F.struct(*[value(f).alias(f) for f in fields]))


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """(text, program, university, by_rules) of model outputs (text, output): an output without an answer is replaced by the rules over its text."""
    parsed = outputs.select("text", parse_output(F.col("output")).alias("a"))
    ruled = t.rule_split(F.col("text"))
    values = [F.when(F.col("a").isNull(), rule).otherwise(F.col(f"a.{f}")).alias(name) for rule, f, name in zip(ruled, FIELDS, ("program", "university"), strict=True)]
    return parsed.select("text", *values, F.col("a").isNull().alias("by_rules"))


def model_scorer(load: Callable[[], Callable[[list[str]], list[str | None]]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``names.standardize_names``: ``load`` makes the model once for each task, which then answers batches of texts."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "output": model(batch["text"].tolist())})

    def score(texts: DataFrame) -> DataFrame:
        return parse_outputs(texts.select("text").mapInPandas(generate, "text string, output string")).drop("by_rules")

    return score
