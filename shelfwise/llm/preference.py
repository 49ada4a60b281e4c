"""Preference pairs rendered as one prompt and two masked completions.

Both sides of a pair are ordered conversations. Their longest common turn
prefix (same role and text) is rendered once as the prompt; what follows is each
side's completion, with the spans to train on: the texts of assistant turns and
the end mark after them, as start:end code points of the completion.

Turns are ordered by (turn, role, text), so ties have one order and repeated
turns stay; a null role or text counts as empty; a side without turns is an
empty conversation; rows with another side than chosen or rejected are ignored;
each turn with a null pair id is a pair of its own, so that they make no unbounded
conversation; a mark within a text or role ("<|end|>") is broken by a
zero-width space, so that no text can forge a turn; extra columns are not read; an
empty table gives no rows. A pair is ``usable`` if both completions hold something to
train on. One row holds one whole conversation, as the format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN = "struct<turn:bigint,role:string,text:string>"


def _side(name: str) -> Column:
    turn = F.struct(F.col("turn"), *(F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|", "<\u200b|").alias(c) for c in ("role", "text")))
    said = F.sort_array(F.collect_list(F.when(F.col("side") == name, turn)))
    return F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)


def _open(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _close(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_open(t), _close(t))), "")


def trained(turns: Column, role: str) -> Column:
    """start:end of each turn of the role in the rendered turns, comma-joined."""
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        s = acc["at"] + F.length(_open(t))
        e = s + F.length(_close(t))
        span = F.concat(s.cast("string"), F.lit(":"), e.cast("string"))
        return F.struct(e.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(turns, init, step, lambda a: F.array_join(a["out"], ","))


def preference_pairs(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, usable."""
    turns = turns.where(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", "role", "text")
    turns = turns.withColumn("alone", F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id()))
    pairs = turns.groupBy("pair_id", "alone").agg(_side("chosen"), _side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    pairs = pairs.select("pair_id", F.col("n_common").cast("long").alias("n_common"),
                         render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
                         *[f(rest(s), *a).alias(s + end) for f, a, end in ((render, (), ""), (trained, (role,), "_mask"))
                           for s in ("chosen", "rejected")])
    return pairs.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def op10_preference(spark, sf_dir: str) -> DataFrame:
    """Each conversation as chosen; rejected says only the first line of assistant turns from turn conv_id modulo 5 on."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    short = (F.col("role") == "assistant") & (F.col("turn") >= F.col("pair_id") % 5)
    worse = conv.withColumn("text", F.when(short, F.split("text", "\n")[0]).otherwise(F.col("text")))
    return preference_pairs(conv.withColumn("side", F.lit("chosen")).unionByName(worse.withColumn("side", F.lit("rejected"))))


QUERIES = {"op10_preference": op10_preference}
