"""Corpus pipeline: quality rules, near-dedup, decontamination, PII masking, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes each stage's result as Parquet under
``spark.checkpoint.dir`` and reads it back as the next one's docs. All stages but
the last return the columns of ``documents``; each operator's docstring says what it
does with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm.decontamination import contained_items
from shelfwise.llm.packing import pack
from shelfwise.llm.pii import find_pii, mask
from shelfwise.llm.quality_rules import quality_rules
from shelfwise.llm.simhash import one_of_each
from shelfwise.operators.materialize import freeze

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep."""
    return quality_rules(docs, keep=tuple(COLUMNS)).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id; rows without an id come last, of rows that share one each text counts."""
    return one_of_each(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a row is judged by its own text, whatever its id."""
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    leaks = contained_items(keyed.select(F.col("text_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(leaks.select(F.col("doc_id").alias("text_key")).distinct(), "text_key", "left_anti").select(COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked; n_chars follows where a text changes."""
    found = find_pii(docs).withColumn("masked", mask(F.col("text"), F.col("pii_spans")))
    length = F.when(F.size("pii_spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids and the ids' checksum."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
          ("pii", mask_pii), ("packing", packing)]
ORACLE_SQL = None  # SimHash, tokens and packing are not SQL: tests/llm holds the result against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
