"""Quality rules with host-level verdicts (DataFrame functions only).

Every row gets the base counts of its whole text. Failures are summed by host
(one partial aggregate, so a hot host is reduced before the shuffle), each
host's failure rate is shrunk by a beta prior fitted to all hosts by moments,
and the verdict goes back to the rows. Null text counts as empty; a null host
is a host of its own; rows of one text have one verdict within a host, and repeated
rows stay; very long texts are counted whole; extra columns are dropped, but for those
named in ``keep``, which come back in one struct, so that no name clashes; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.operators.materialize import attach_scalars, freeze

WORD = r"[^\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that stand twice or more in the text."""
    wins = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.alias("i"))))
    return F.sort_array(F.coalesce(wins, F.array().cast("array<struct<w:string,i:int>>")))


def _covered(wins: Column) -> Column:
    def hit(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(wins, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(wins, k + 1)["w"] == x["w"], F.lit(False))

    at = F.transform(F.filter(wins, hit), lambda x: F.sequence(x["i"], x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(at)))


def base_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, keep: tuple = ()) -> DataFrame:
    """doc_id, host and the base counts of each row; the columns of ``keep`` in a struct named row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), *([F.struct(*keep).alias("row")] if keep else []),
                    F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("wins", _repeat_words(F.col("words")))
    d = d.select("doc_id", "host", *(["row"] if keep else []), F.size("words").cast("long").alias("n_words"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 _covered(F.col("wins")).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < min_words)
                        | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))


def host_rates(scored: DataFrame) -> DataFrame:
    """Failure rate by host, shrunk by a beta prior fitted to all hosts by beta-binomial moments.

    With mean failure rate p, the spread of host rates that binomial sampling alone gives is taken out of the observed one
    (every host weighted by its rows): what is left is the correlation c of two rows of one host, between 0 and 1, and
    the prior has (1 - c) / c rows. Without spread beyond sampling (c = 0) every host has the mean rate.
    """
    hosts = scored.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.sum("n").alias("total"), F.sum("failed").alias("bad"), F.sum(failed * failed / n).alias("spread"), F.sum(n * n).alias("squares"),
                     F.count("*").alias("hosts"))
    mean, others = F.col("bad") / F.col("total"), F.col("hosts") - 1
    pq, room = mean * (1 - mean), F.col("total") - F.col("squares") / F.col("total") - others
    found = (F.col("spread") - F.col("total") * mean * mean - pq * others) / (pq * room)
    sums = sums.select("total", mean.alias("mean"), F.when((pq > 0) & (room > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))
                       .otherwise(F.lit(0.0)).alias("c"))
    c = F.col("c")
    rate = F.when(c < 1, (c * failed + (1 - c) * F.col("mean")) / (c * n + 1 - c)).otherwise(failed / n)
    return attach_scalars(hosts, sums).select("host", "n", "total", rate.alias("host_rate"))


def quality_rules(docs: DataFrame, max_host_rate: float = 0.5, keep: tuple = (), hot_share: int = 1000) -> DataFrame:
    """Base counts, base_failed, the host's shrunk rate and kept (and the struct row, see base_rules).

    Verdicts of hosts with over 1 / hot_share of all rows, fewer than hot_share
    by count, are broadcast; rows of the other hosts meet theirs by a shuffle.
    """
    scored = freeze(base_rules(docs, keep=keep))
    v = freeze(host_rates(scored)).withColumnRenamed("host", "v_host")
    hot = F.col("n") * hot_share > F.col("total")
    same = F.col("host").eqNullSafe(F.col("v_host"))
    big = F.broadcast(v.where(hot).select("v_host", "host_rate"))
    joined = (scored.join(big, same, "inner")
              .unionByName(scored.join(big, same, "left_anti").join(v.where(~hot).select("v_host", "host_rate"), same, "inner")))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).drop("v_host")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumn("host_rate", F.round("host_rate", 9))


QUERIES = {"op7_quality_rules": op7_quality_rules}

ORACLE = {"op7_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) s(k) GROUP BY r),
b AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN hit USING (r)),
judged AS (
  SELECT * EXCLUDE (lines), CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM b),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS x FROM judged GROUP BY host),
fit AS (
  SELECT total, p, hosts, CASE WHEN p * (1 - p) > 0 AND total - squares / total - (hosts - 1) > 0
    THEN least(1.0, greatest(0.0, (spread - total * p * p - p * (1 - p) * (hosts - 1)) / (p * (1 - p) * (total - squares / total - (hosts - 1))))) ELSE 0 END AS c
  FROM (SELECT sum(n) AS total, sum(x) / CAST(sum(n) AS DOUBLE) AS p, sum(x * x / CAST(n AS DOUBLE)) AS spread, sum(CAST(n AS DOUBLE) * n) AS squares,
               count(*) AS hosts FROM hosts)),
rates AS (SELECT host, n, CAST(total AS BIGINT) AS total, CASE WHEN c < 1 THEN (c * x + (1 - c) * p) / (c * n + 1 - c) ELSE x / CAST(n AS DOUBLE) END AS host_rate
          FROM hosts, fit)
SELECT j.doc_id, j.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate,
       NOT base_failed AND host_rate <= 0.5 AS kept
FROM judged j JOIN rates h ON j.host IS NOT DISTINCT FROM h.host"""}
