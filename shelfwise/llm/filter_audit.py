"""How a chain of filters interacts: contingency tensors contracted by einsum.

1. Every row gets one bit for each filter that it fails (bytes of the whole text, one
   pass in Arrow batches) and a 128-bit digest of its text.
2. Copies: rows are summed by (digest, part) with their smallest doc_id, so the test
   against smaller doc_ids needs no join and a text held by a third of all rows is
   reduced before the shuffle.
3. Each part's counts (rows, good rows, toxic rows) by failed filters are a tensor of
   one axis of two (pass, fail) for each filter. A step of an order selects pass,
   fail or all along each axis; one einsum makes all steps of all orders.

Null text counts as empty, a null part as the empty string. A row with a null doc_id
has no smaller doc_id, is none for others and has no label; repeated rows count once
each and are no copies of each other; a doc_id with several label rows is good (toxic)
if one of them says so. Very long texts are read whole. Extra columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
MEASURES = ("n", "good", "toxic")


def failed_bits(raw: bytes, chars: int, min_words: int = 100, min_distinct_pct: int = 80, max_capital_pct: int = 10) -> int:
    """Bits of the filters A (1), B (2), C (4) and D (8) that a text fails."""
    words = raw.split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < min_words) | (100 * len(set(words)) < min_distinct_pct * len(words)) << 1
            | (100 * capitals > max_capital_pct * chars) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def text_bits(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, part, bits (A to D) and key (digest of the text) of each row."""
    def run(batches):
        for b in batches:
            chars = pc.utf8_length(b.column("text")).to_pylist()
            raw = b.column("text").cast(pa.large_binary() if pa.types.is_large_string(b.column("text").type) else pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array([failed_bits(t, n, **limits) for t, n in zip(raw, chars)], pa.int32()),
                 pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())], names=["doc_id", "part", "bits", "key"])
    text, part = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text).mapInArrow(run, "doc_id long, part string, bits int, key binary")


def cells(bits: DataFrame, labels: DataFrame, copy_bit: int = 16) -> DataFrame:
    """part, mask (failed filters, that of copies included), n, good and toxic: at most 32 rows a part."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic")))
    one = bits.groupBy("doc_id", "part", "bits", "key").agg(F.count("*").alias("n"))
    none = F.lit(0)
    rows = (one.where("doc_id is not null").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
            .unionByName(one.where("doc_id is null").withColumns({"good": none, "toxic": none})))
    rows = rows.withColumns({"good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")})
    at = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *MEASURES))
    texts = rows.groupBy("key", "part", "bits").agg(*(F.sum(m).alias(m) for m in MEASURES), F.min(at).alias("first"),
                                                    F.sum(F.expr("if(doc_id is null, n, 0)")).alias("free"))
    texts = texts.withColumn("lowest", F.min("first.doc_id").over(Window.partitionBy("key")))  # one row a part and text
    lead = F.col("first.doc_id") == F.col("lowest")
    passed = {m: F.when(lead, F.col(f"first.{m}")).otherwise(0) + (F.col("free") if m == "n" else 0) for m in MEASURES}
    passed = {m: F.coalesce(v, F.lit(0)) for m, v in passed.items()}
    both = F.array(F.struct(F.col("bits").alias("mask"), *(v.alias(m) for m, v in passed.items())),
                   F.struct(F.col("bits").bitwiseOR(copy_bit).alias("mask"), *((F.col(m) - v).alias(m) for m, v in passed.items())))
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES)).where("n > 0")


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def contract(tensor: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """Sums of ``tensor`` (measures, 2, ..., 2) for each row of ``choices`` (selections, filters, 2): (selections, measures)."""
    axes = ascii_lowercase[:choices.shape[1]]
    return np.einsum(f"M{axes},{','.join('S' + x for x in axes)}->SM", tensor, *choices.transpose(1, 0, 2))


def audit(names: str):
    """A function from the cells of one part to its rows: every step of every order of the filters ``names``."""
    k = len(names)
    orders = ["".join(p) for p in permutations(names)]
    order, step = np.repeat(orders, k), np.tile(np.arange(k), len(orders))
    own = np.array([names.index(o[s]) for o, s in zip(order, step)])

    def chosen(mine: tuple, earlier: tuple, later: tuple) -> np.ndarray:
        return np.array([[mine if o[s] == f else earlier if f in o[:s] else later for f in names] for o, s in zip(order, step)], np.int64)
    after, here, failing, alone = chosen(PASS, PASS, ALL), chosen(FAIL, PASS, ALL), chosen(FAIL, ALL, ALL), chosen(FAIL, PASS, PASS)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((len(MEASURES), *[2] * k), np.int64)
        place = tuple((part["mask"].to_numpy() >> i) & 1 for i in range(k))
        for m, name in enumerate(MEASURES):
            np.add.at(tensor[m], place, part[name].to_numpy())
        removed = contract(tensor, here)
        value = np.zeros(k, np.int64)
        np.add.at(value, own, removed[:, 0])
        return pd.DataFrame({
            "part": part["part"].iloc[0], "filter_order": order, "step": step + 1, "kept": contract(tensor, after)[:, 0], "removed": removed[:, 0],
            "redundant": contract(tensor, failing)[:, 0] - removed[:, 0], "unique_fails": contract(tensor, alone)[:, 0],
            "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": value[own]})
    return run


def filter_audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Counts of each step of each order of the filters A to E, by part (see the module)."""
    schema = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
              "good_lost long, toxic_lost long, shapley long")
    return cells(text_bits(docs, **limits), labels).groupBy("part").applyInPandas(audit("ABCDE"), schema)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_filter_audit": op11_filter_audit}

ORACLE = {"op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed
  FROM d LEFT JOIN marks USING (doc_id)),
sums AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM judged GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s AS step, filter_order[s] AS f, filter_order[1:s - 1] AS before
  FROM orders, range(1, 6) r(s)),
met AS (
  SELECT part, filter_order, step, f, n, g, x, failed, contains(failed, f) AS fails,
         before <> '' AND translate(failed, before, '') <> failed AS gone
  FROM sums, steps),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN x ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""}
