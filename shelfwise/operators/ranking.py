"""Global ordering operators without a single-partition window (H1).

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
For per-customer or per-product frames that is unbounded, so positions in a
total order are computed the way a distributed sort does it:

1. range-partition on the sort keys and sort inside each partition;
2. tag each row with its partition id and its ordinal inside the partition
   (``monotonically_increasing_id`` = ``pid << 33 | ordinal``);
3. hold the tagged rows (Spark's block store, from their first use on), so that the
   counts and the rows themselves come from one range partitioning; no job runs
   while the plan is built. A lost block comes out the same again: the bounds belong
   to the shuffle, and the order inside a partition is total;
4. prefix-sum the per-partition counts (one row per partition, broadcast) and
   add the offset.

NTILE, exact PERCENTILE_CONT and top-N DENSE_RANK are built on top. The sort
keys must form a total order: callers append a unique tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.materialize import hold

_ORD_BITS = 33


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_row_number(df: DataFrame, order_by: list[Column], name: str = "row_number",
                      total_name: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order_by`` (a total order).

    If ``total_name`` is given, the total row count is added as well.
    """
    n = _partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("_rk_pid", F.spark_partition_id())
              .withColumn("_rk_mono", F.monotonically_increasing_id()))
    tagged = hold(tagged)
    counts = tagged.groupBy("_rk_pid").agg(F.count(F.lit(1)).alias("_rk_n"))
    w = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_rk_pid",
        F.coalesce(F.sum("_rk_n").over(w), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_n").over(Window.partitionBy(F.lit(1))).alias("_rk_total"))
    out = tagged.join(F.broadcast(offsets), "_rk_pid")
    local = F.col("_rk_mono") - F.shiftleft(F.col("_rk_pid").cast("long"), _ORD_BITS)
    out = out.withColumn(name, F.col("_rk_off") + local + 1)
    if total_name:
        out = out.withColumn(total_name, F.col("_rk_total"))
    return out.drop("_rk_pid", "_rk_mono", "_rk_off", "_rk_total")


def ntile_expr(position: Column, total: Column, tiles: int) -> Column:
    """SQL NTILE rule: the first ``total % tiles`` buckets get one extra row."""
    q = (total / tiles).cast("long")  # floor for non-negative
    r = total % tiles
    big = r * (q + 1)
    first = F.floor((position - 1) / (q + 1)) + 1
    rest = r + F.floor((position - big - 1) / F.nullif(q, F.lit(0))) + 1
    return F.when(position <= big, first).otherwise(rest).cast("int")


def with_ntile(df: DataFrame, order_by: list[Column], tiles: int, name: str,
               num_partitions: int | None = None) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY order_by)`` over the whole frame, distributed."""
    ranked = global_row_number(df, order_by, "_nt_pos", "_nt_total", num_partitions)
    return ranked.withColumn(name, ntile_expr(F.col("_nt_pos"), F.col("_nt_total"), tiles)) \
                 .drop("_nt_pos", "_nt_total")


def percentile_cont(df: DataFrame, value: str, fractions: dict[str, float],
                    num_partitions: int | None = None, extra_aggs: dict[str, Column] | None = None) -> DataFrame:
    """Exact ``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY value)`` for each alias -> p.

    One row out. NULLs are ignored; the value is read as DOUBLE and
    interpolated linearly between the neighbouring ranks. ``extra_aggs`` are
    evaluated over the same (already materialised) rows in the same pass,
    with the original value column available under its own name.
    """
    vals = df.select(F.col(value).cast("double").alias("_pc_v"), F.col(value)).where(F.col("_pc_v").isNotNull())
    ranked = global_row_number(vals, [F.col("_pc_v")], "_pc_pos", "_pc_n", num_partitions)
    idx = F.col("_pc_pos") - 1
    aggs, picks = [], []
    for alias, p in fractions.items():
        rn = (F.col("_pc_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(rn), F.ceil(rn)
        # conditional aggregates pick the (at most 2) neighbouring ranks
        aggs += [F.max(F.when(idx == lo, F.col("_pc_v"))).alias(f"_{alias}_lo"),
                 F.max(F.when(idx == hi, F.col("_pc_v"))).alias(f"_{alias}_hi"),
                 F.max(rn - lo).alias(f"_{alias}_d")]
        picks.append((F.col(f"_{alias}_lo") + (F.col(f"_{alias}_hi") - F.col(f"_{alias}_lo")) * F.col(f"_{alias}_d"))
                     .alias(alias))
    for alias, expr in (extra_aggs or {}).items():
        aggs.append(expr.alias(alias))
        picks.append(F.col(alias))
    return ranked.agg(*aggs).select(*picks)


def top_dense_rank(df: DataFrame, value: str, n: int, name: str, ascending: bool = False) -> DataFrame:
    """Rows whose ``value`` is among the ``n`` best distinct values, with their
    DENSE_RANK. Only the ``n`` distinct values travel (TakeOrdered), then a
    broadcast join of ``n`` rows brings the rank back."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    best = (df.select(value).where(F.col(value).isNotNull()).distinct()
            .orderBy(order).limit(n))
    ranked = best.withColumn(name, F.dense_rank().over(Window.orderBy(order)))
    return df.join(F.broadcast(ranked), value)


def top_n(df: DataFrame, order_by: list[Column], n: int | None, rank_name: str | None = None) -> DataFrame:
    """``ORDER BY … LIMIT n`` (TakeOrderedAndProject), optionally numbered 1..n.

    Without ``n`` every row comes back, ordered; numbers then come from the
    distributed row number, not from a window in one task.
    """
    if n is None:
        rows = global_row_number(df, order_by, rank_name) if rank_name else df
        return rows.orderBy(rank_name) if rank_name else rows.orderBy(*order_by)
    top = df.orderBy(*order_by).limit(n)
    if rank_name:
        top = top.withColumn(rank_name, F.row_number().over(Window.orderBy(*order_by)))
    return top
