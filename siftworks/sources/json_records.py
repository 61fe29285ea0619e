"""JSON and JSON-lines records, name lists, and gated reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftworks.shared import exists, materialize


def rows_type(schema: str) -> str:
    return f"array<{schema if schema.startswith('struct') else f'struct<{schema}>'}>"


def record_list(c: Column, schema: str) -> Column:
    """The records of a text that is one JSON array and nothing else, null for any other text; an element that is no record is null."""
    # inside brackets, so that what follows an array makes the text damaged or a second element
    whole = F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{rows_type(schema)}>")
    return F.when(F.ltrim(c).startswith("[") & (F.size(whole) == 1), F.try_element_at(whole, F.lit(1)))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of files that each hold a JSON array (plain or .gz); a file with anything else fails the read, but one of no bytes, which has no record."""
    schema = schema if isinstance(schema, str) else schema.simpleString()
    rows = record_list(F.col("value"), schema)
    refused = F.raise_error(F.lit("not a JSON array of records")).cast(rows_type(schema))
    return spark.read.text(path, wholetext=True).select(F.inline(F.coalesce(F.when(~F.exists(rows, lambda r: r.isNull()), rows), refused)))


def write_records(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines, all or nothing by Spark's commit."""
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


@dataclass(frozen=True)
class TolerantRead:
    rows: DataFrame
    counts: DataFrame


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> TolerantRead:
    """All good lines; counts has one row: good, damaged."""
    parsed = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).select("*")
    flags = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    counts = flags.agg(F.count_if(F.col("r._bad").isNull()).alias("good"), F.count_if(F.col("r._bad").isNotNull()).alias("damaged"))
    return TolerantRead(parsed.filter("_bad is null").drop("_bad"), counts)


def read_jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of each file the lines before its first damaged one. A file is read in as many splits as its size asks for.

    A line's place is its split's offset in the file and, inside the split, the order of reading; the first damaged place of each file, one
    row for each damaged file, is written down and joined back.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").filter("trim(value) <> ''")
    parsed = lines.select("file", "place", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    stops = materialize(parsed.filter("r._bad is not null").groupBy("file").agg(F.min("place").alias("stop")), "damaged")
    return parsed.join(stops, "file", "left").filter("stop is null or place < stop").select("r.*").drop("_bad")


def unwrap_rows(payloads: DataFrame, column: str, row_schema: str) -> DataFrame:
    """Rows of JSON payloads that are a list of rows, or an object with such a list under "rows"; anything else has none."""
    rows = f"array<struct<{row_schema}>>"
    text = F.ltrim(column)
    plain = F.when(text.startswith("["), F.from_json(column, rows))
    wrapped = F.when(text.startswith("{"), F.from_json(column, f"struct<rows: {rows}>")["rows"])
    return payloads.select(F.inline(F.coalesce(plain, wrapped)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): trimmed, non-blank, different lines; a missing path has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


class GateError(ValueError):
    """Files that may not be published."""


def gated_ingest(spark: SparkSession, path: str, expected: DataFrame, schema: str, target: str) -> int:
    """Publish the record files in ``path`` to ``target`` if each is as long as ``expected`` (name, size) says, all are there and are lists of objects, and there are records.

    One pass reads the files, observes what the gate asks for, and writes the records to a folder beside the target, which a rename publishes;
    an older target is moved away first. What is refused leaves the target as it was. Returns the number of records.
    """
    listed = expected.groupBy("name").agg(F.max("size").alias("size"))
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("length"))
    checked = files.join(listed, "name", "left").select("length", "size", record_list(F.col("value"), schema).alias("rows"))
    gate = Observation("gate")
    observed = checked.observe(
        gate,
        F.count_if(F.col("size").isNotNull()).alias("listed"),
        F.count_if(~F.col("length").eqNullSafe(F.col("size"))).alias("sizes"),
        F.count_if(F.col("rows").isNull()).alias("unreadable"),
        F.count_if(F.exists("rows", lambda r: r.isNull())).alias("others"),
    )
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    observed.select(F.inline("rows")).write.parquet(staging)
    found = gate.get
    records = spark.read.parquet(staging).count()
    reasons = {
        "a file's size differs from the listed one": found["sizes"], "a listed file is missing": listed.count() - found["listed"], "a file is no list": found["unreadable"],
        "a list holds something else than records": found["others"], "there is no record": not records,
    }
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for reason, wrong in reasons.items():
        if wrong:
            fs.delete(place(staging), True)
            raise GateError(reason)
    old = place(f"{staging}.old")
    replaced = fs.exists(place(target)) and fs.rename(place(target), old)
    if not fs.rename(place(staging), place(target)):
        raise OSError(f"{staging} could not be renamed to {target}")
    if replaced:
        fs.delete(old, True)
    return records
