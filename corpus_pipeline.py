"""A corpus pipeline of five stages: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared folder
and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import bpe, mixing, quality_rank, secret_scan, similar_sets, simhash
from siftworks.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stages on hashes and Markov models are no SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking does not reject.

    Null and empty texts are scored like others, and repeated rows each; a score at the threshold stays; without labels none is rejected;
    further columns are not read; an empty table gives an empty one.
    """
    model = quality_rank.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rank.score_documents(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def _row_key(*columns: str) -> Column:
    """A digest of the columns, which rows share only if all of these are equal (a null is no empty text)."""
    return F.unhex(F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null")) for c in columns]).cast("binary")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (nulls last, then by digest) of each group of near-duplicates.

    Near: five-word shingles alike by 0.8 or more; links of SimHash fingerprints are checked first, a join finds what they leave apart. Rows are told apart by a digest of all columns, so no row goes or stays for its id
    alone; of rows equal in every column one stays. Null, empty and wordless texts are one group; further columns are not read;
    an empty table gives an empty one.
    """
    rows = docs.select(_row_key(*COLUMNS).alias("row"), *COLUMNS)
    groups = similar_sets.set_components(rows, radius=simhash.RADIUS)
    ids = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keepers = groups.join(ids, "row").groupBy("component").agg(F.min_by("row", order).alias("row")).select("row")
    return rows.dropDuplicates(["row"]).join(keepers, "row", "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets, and n_chars of what is left.

    Null texts stay null (n_chars too) and empty ones empty; repeated rows each stay; further columns are not read.
    """
    redacted = secret_scan.redact_secrets(docs.select(*COLUMNS), secret_scan.train(docs))
    return redacted.withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a row is chosen by its id and text, so rows without an id are mixed like others.

    Null and empty texts have size 0 and go with their hash; a null source is one of its own; further columns are not read.
    """
    return mixing.repeat_rows(docs.select(*COLUMNS), _row_key("doc_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix, one row per row; a null text counts as empty."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact),
    ("mix", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
