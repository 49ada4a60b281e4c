"""Distributed ranking operators equal the single-partition window results."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators.ranking import global_row_number, percentile_cont, top_dense_rank, with_ntile


def _data(spark, n, seed=7, distinct=40):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, distinct), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, v double").repartition(5)


def test_global_row_number_is_a_permutation(spark):
    df = _data(spark, 1003)
    out = global_row_number(df, [F.col("k").desc(), F.col("id")], "rn", "total", num_partitions=4)
    got = {(r.id, r.rn) for r in out.collect()}
    ref = {(r.id, r.rn) for r in df.select("id", F.row_number().over(
        Window.orderBy(F.col("k").desc(), "id")).alias("rn")).collect()}
    assert got == ref
    assert out.select(F.max("total")).first()[0] == 1003


def test_ntile_matches_window_ntile_with_ties(spark):
    for n in (1, 4, 5, 7, 1003):
        df = _data(spark, n, seed=n)
        out = with_ntile(df, [F.col("k").asc(), F.col("id").asc()], 5, "t", num_partitions=3)
        ref = df.select("id", F.ntile(5).over(Window.orderBy("k", "id")).alias("t"))
        assert sorted((r.id, r.t) for r in out.select("id", "t").collect()) == sorted(
            (r.id, r.t) for r in ref.collect())


def test_percentile_cont_matches_numpy_linear(spark):
    df = _data(spark, 999)
    vals = np.array([r.v for r in df.collect()])
    out = percentile_cont(df, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, num_partitions=4).first()
    for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        assert abs(out[name] - np.quantile(vals, p)) < 1e-12


def test_percentile_single_value(spark):
    df = spark.createDataFrame([(3.5,)], "v double")
    assert percentile_cont(df, "v", {"p": 0.9}).first()["p"] == 3.5


def test_top_dense_rank_keeps_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 9, 9, 8, 7, 7, 7, 1])], "id int, net int")
    out = top_dense_rank(df, "net", 3, "r")
    assert sorted((r.id, r.r) for r in out.collect()) == [(0, 1), (1, 2), (2, 2), (3, 3)]
    asc = top_dense_rank(df, "net", 2, "r", ascending=True)
    assert sorted((r.id, r.r) for r in asc.collect()) == [(4, 2), (5, 2), (6, 2), (7, 1)]
