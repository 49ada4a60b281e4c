"""Results stay whole: long keys keep their digits, lists without a limit keep every row."""

import os
from types import SimpleNamespace

from pyspark.sql import functions as F

from shelfwise.operators.ranking import top_n
from shelfwise.plans import business, kpis, marts
from shelfwise.sources.catalog import Catalog
from shelfwise.sources.tpch_binding import _pad

from conftest import SF_SMALL


def test_padding_never_cuts_a_key(spark):
    rows = spark.createDataFrame([(7,), (1234567891,), (1234567892,)], "k long").select(_pad(F.col("k"), 9).alias("c")).collect()
    assert [r.c for r in rows] == ["000000007", "1234567891", "1234567892"]


def test_top_n_without_a_limit_returns_and_numbers_every_row(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = top_n(df, [F.col("v").desc()], None, "rank").collect()
    assert [(r.v, r["rank"]) for r in got] == [(999 - i, i + 1) for i in range(1000)]


def test_category_walk_passes_32_levels(spark):
    rows = [(i, f"c{i}", f"n{i}", i - 1 if i else None, i) for i in range(36)]
    cats = spark.createDataFrame(rows, "category_id int, category_code string, category_name string, "
                                       "parent_category_id int, category_level int").coalesce(1).cache()
    assert business.q54(SimpleNamespace(product_categories=cats)).count() == 36


def test_every_returned_line_is_bound(spark):
    cat = Catalog.from_tpch(spark, SF_SMALL)
    flagged = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("l_returnflag = 'R'")
    items, returns = cat.return_items, cat.returns
    assert items.count() == items.select("return_item_id").distinct().count() == flagged.count() > flagged.where("l_linenumber = 1").count()
    assert returns.count() == flagged.select("l_orderkey").distinct().count()
    refund = items.agg(F.sum(F.col("quantity_returned") * F.col("unit_refund_amount")).alias("r")).first().r
    assert returns.agg(F.sum("refund_amount").alias("r")).first().r == refund


def test_calendar_reaches_every_order(spark, tmpdir_path):
    d = F.when(F.col("o_orderkey") % 97 == 1, F.lit("1988-02-28").cast("date")).when(F.col("o_orderkey") % 97 == 2, F.lit("2031-12-20").cast("date"))
    for f in os.listdir(SF_SMALL):
        df = spark.read.parquet(f"{SF_SMALL}/{f}")
        if f == "orders.parquet":
            df = df.withColumn("o_orderdate", F.coalesce(d.cast(df.schema["o_orderdate"].dataType), "o_orderdate"))
        df.write.parquet(f"{tmpdir_path}/{f}")
    cat = Catalog.from_tpch(spark, tmpdir_path)
    days = {r.full_date for r in cat.calendar_date.select("full_date").collect()}
    for dates in (cat.orders.select("order_date"), cat.shipments.select("ship_date"), cat.shipments.select("delivery_date"), cat.returns.select("return_date")):
        assert {r[0] for r in dates.distinct().collect()} - {None} <= days
    assert {1988, 2031} <= {r.y for r in marts.fact_sales_line(cat).select(F.year("order_date").alias("y")).distinct().collect()}
    assert marts.fact_sales_line(cat).count() == marts.fact_sales_line(Catalog.from_tpch(spark, SF_SMALL)).count()


def test_rising_returns_of_every_category(spark, monkeypatch):
    rows = [(f"c{i}", 9.0 - i, "down" if i < 3 else "up") for i in range(7)]
    monkeypatch.setattr(kpis, "k21_returns_by_category", lambda *a, **k: spark.createDataFrame(rows, "category string, return_count double, trend string"))
    cat = Catalog.from_tpch(spark, SF_SMALL)

    def rising(**kw):
        return sorted(r.risk[-2:] for r in kpis.k23_operational_risks(cat, **kw).collect() if r.risk.startswith("Rising returns"))
    assert rising() == ["c3", "c4", "c5", "c6"] and rising(return_categories=3) == ["c3", "c4", "c5"]
