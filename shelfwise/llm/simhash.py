"""SimHash near-duplicates found by deletion variants of fingerprint segments.

With k = 2 bits and two 32-bit segments, linked fingerprints agree in one
segment but for at most one bit, so they share a variant with that bit blanked.
A variant held by two fingerprints gives one pair, verified by bit distance.
Fingerprints of fuller variants are linked through their one-bit neighbours
instead: two of them lie within 2 bits exactly if they share a neighbour (or
each other), so no group is expanded into pairs. Components are minimum labels
spread over the links, with a reliable checkpoint each round.

Null and wordless texts have fingerprint zero; repeated rows stay rows of
their own; very long texts are hashed whole, 65,536 shingles at a time; extra columns
are not read; an empty table gives no rows; a null doc_id never names a component.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from shelfwise.session import ensure_checkpoint_dir

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
BIT = "shiftleft(cast(1 as bigint), {})"


def fingerprint(text: str | None, width: int = 3) -> int:
    words = WORDS.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(n)), np.uint64, n)
    ones = sum(np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
               for i in range(0, n, 65536))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _links(fps: DataFrame, bits: int) -> DataFrame:
    blank = F.explode(F.expr("sequence(0, 63)"))
    low = F.expr("shiftrightunsigned(fp, if(i < 32, 0, 32)) & 4294967295L")
    v = (fps.select("fp", blank.alias("i"))
         .select("fp", "i", low.bitwiseAND(F.bitwise_not(F.expr(BIT.format("i % 32")))).alias("seg")))
    held = v.groupBy("i", "seg").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = held.where("n = 2").where(_distance("a", "b") <= bits).select("a", "b")
    full = v.join(held.where("n > 2").select("i", "seg"), ["i", "seg"], "left_semi").select("fp").distinct()
    near = full.select("fp", F.explode(F.expr("sequence(-1, 63)")).alias("i"))
    near = near.select("fp", F.expr(f"if(i < 0, fp, fp ^ {BIT.format('greatest(i, 0)')})").alias("mid"))
    star = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return pairs.union(near.join(star, "mid").select("a", F.col("fp").alias("b")).where("a <> b")).distinct()


def _labels(rows: DataFrame, bits: int) -> DataFrame:
    """fp and first of each fingerprint: the smallest (no doc_id, doc_id, fp) of its component, which names it."""
    if bits != 2:
        raise ValueError("the segments and neighbours are laid out for 2 bits")
    label = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    label = label.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp").alias("c")).checkpoint()
    e = _links(label.select("fp"), bits)
    e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    while True:
        seen = e.join(label.withColumnRenamed("fp", "a"), "a").groupBy(F.col("b").alias("fp")).agg(F.min("c").alias("m"))
        new = (label.join(seen, "fp", "left").select("fp", "c", F.least("c", "m").alias("m")).checkpoint())
        moved = new.where(~F.col("m").eqNullSafe(F.col("c"))).limit(1).count()
        label = new.select("fp", F.col("m").alias("c"))
        if not moved:
            return label


def simhash_components(docs: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", _fingerprints("text").alias("fp")).checkpoint()
    return rows.join(_labels(rows, bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                                       F.col("c.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, bits: int = 2) -> DataFrame:
    """One row of each component, whole: that of the smallest doc_id (a null one is the largest), then fingerprint, then text hash.

    Rows that share a doc_id are told apart by their texts; of rows equal in both one stays.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    row = ["simhash_text", "simhash_id", "simhash_none"]  # plain columns, so that the join and the distinct share one shuffle of the texts
    keyed = docs.withColumns({row[0]: F.xxhash64("text"), row[1]: F.coalesce("doc_id", F.lit(0)), row[2]: F.col("doc_id").isNull()})
    rows = keyed.select("doc_id", *row, _fingerprints("text").alias("fp")).checkpoint()
    first = rows.join(_labels(rows, bits), "fp").where(F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("fp") == F.col("c.fp")))
    first = first.groupBy(row[1], row[2], "fp").agg(F.min(row[0]).alias(row[0])).select(row)
    return keyed.join(first, row, "left_semi").dropDuplicates(row).select(docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
