"""Table functions FN1-FN5: parameterised DataFrame plans.

Date bounds are plain literals, so the filters reach the order scan and
Catalyst folds them; nothing is collected except the optional default bounds
(one scalar aggregate).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.expr import days_between, month_start, ratio, xavg
from shelfwise.operators.materialize import attach_scalars
from shelfwise.plans import marts as M
from shelfwise.sources.catalog import Catalog

B = F.broadcast


def _d(x):
    return F.lit(x).cast("date") if isinstance(x, str) else F.lit(x)


def _window_facts(cat: Catalog, start, end) -> DataFrame:
    return M.sold_order_facts(cat).where(F.col("order_date").between(_d(start), _d(end)))


def order_date_bounds(cat: Catalog) -> tuple[dt.date, dt.date]:
    row = cat.orders.agg(F.min("order_date"), F.max("order_date")).first()
    return row[0], row[1]


def monthly_revenue(cat: Catalog, start=None, end=None) -> DataFrame:  # FN1
    if start is None or end is None:
        lo, hi = order_date_bounds(cat)
        start, end = start or lo, end or hi
    d = cat.calendar_date.select(F.col("full_date").alias("order_date"), "year_number", "month_number")
    f = _window_facts(cat, start, end).join(B(d), "order_date")
    m = f.groupBy("year_number", "month_number", month_start("order_date").alias("month_start")).agg(
        F.sum("net_sales").alias("net"), (F.sum("net_sales") - F.sum("cogs_amount")).alias("gp"),
        F.count(F.lit(1)).alias("order_count"))
    prior = F.lag("net", 12).over(Window.orderBy("month_start"))  # months of the window only
    return m.select("year_number", "month_number", "month_start", F.round("net", 2).alias("net_sales"),
                    F.round("gp", 2).alias("gross_profit"), "order_count", F.round(prior, 2).alias("yoy_net_sales"),
                    ratio(F.col("net") - prior, prior, 4).alias("yoy_growth_pct")).orderBy("month_start")


def store_performance(cat: Catalog, start, end) -> DataFrame:  # FN2
    f = _window_facts(cat, start, end).where(F.col("store_id").isNotNull())
    per = f.groupBy("store_id").agg(
        F.sum("net_sales").alias("net"), F.sum("cogs_amount").alias("cogs"), F.count(F.lit(1)).alias("orders"),
        F.sum("units").alias("units"))
    s = cat.stores.select("store_id", "store_code", "store_name", "region_id", "selling_sq_ft")
    r = cat.regions.select("region_id", "region_name")
    j = per.join(s, "store_id").join(B(r), "region_id")
    gp = F.col("net") - F.col("cogs")
    return j.select("store_id", "store_code", "store_name", "region_name", F.round("net", 2).alias("net_sales"),
                    F.round(gp, 2).alias("gross_profit"), ratio(gp, "net", 4).alias("margin_pct"),
                    F.col("orders").alias("order_count"), ratio("net", "orders", 2).alias("aov"),
                    F.col("units").alias("units_sold"),
                    F.rank().over(Window.orderBy(F.col("net").desc_nulls_first())).alias("sales_rank"),
                    ratio("net", "selling_sq_ft", 2).alias("sales_per_sqft")
                    ).orderBy(F.col("net_sales").desc_nulls_first(), "store_id")


def customer_rfm_asof(cat: Catalog, as_of=None) -> DataFrame:  # FN3
    as_of = as_of or cat.as_of
    f = M.sold_order_facts(cat).where(F.col("order_date") <= _d(as_of))
    cust = f.groupBy("customer_id").agg(
        days_between(_d(as_of), F.max("order_date")).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"), F.sum("net_sales").alias("monetary"))
    scored = M.score_rfm(cust, "recency_days", "frequency", "monetary")
    return scored.select("customer_id", "recency_days", "frequency", F.round("monetary", 2).alias("monetary"),
                         "r_score", "f_score", "m_score", M.rfm_segment().alias("rfm_segment"))


def category_contribution(cat: Catalog, start, end) -> DataFrame:  # FN4
    lines = M.sold_lines(cat).where(F.col("order_date").between(_d(start), _d(end)))
    per_prod = lines.groupBy("product_id").agg(
        F.sum("line_net_amount").alias("net"), F.sum("line_cogs_amount").alias("cogs"), F.sum("quantity").alias("units"))
    pcm = M.product_category_map(cat).select("product_id", "category_code", "category_name")
    g = per_prod.join(pcm, "product_id").groupBy("category_code", "category_name").agg(
        F.sum("net").alias("net"), F.sum("cogs").alias("cogs"), F.sum("units").alias("units_sold"))
    total = F.sum("net").over(Window.partitionBy())  # categories: bounded by the hierarchy
    order = Window.orderBy(F.col("net").desc_nulls_first())
    cum = F.sum("net").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return g.select("category_code", "category_name", F.round("net", 2).alias("net_sales"),
                    F.round(F.col("net") - F.col("cogs"), 2).alias("gross_profit"), "units_sold",
                    ratio(F.col("net"), total, 4).alias("contribution_pct"), F.rank().over(order).alias("sales_rank"),
                    ratio(cum, total, 4).alias("cumulative_pct")).orderBy(F.col("net_sales").desc_nulls_first())


def executive_scorecard(cat: Catalog, start, end) -> DataFrame:  # FN5
    start = dt.date.fromisoformat(start) if isinstance(start, str) else start
    end = dt.date.fromisoformat(end) if isinstance(end, str) else end
    days = (end - start).days
    prior_start, prior_end = start - dt.timedelta(days=days + 1), start - dt.timedelta(days=1)
    f = M.sold_order_facts(cat).where(F.col("order_date").between(_d(prior_start), _d(end)))
    in_cur = F.col("order_date") >= _d(start)
    # one pass over both windows, labelled by date
    sales = f.agg(
        F.sum(F.when(in_cur, F.col("net_sales"))).alias("net"),
        F.sum(F.when(~in_cur, F.col("net_sales"))).alias("prior_net"),
        (F.sum(F.when(in_cur, F.col("net_sales"))) - F.sum(F.when(in_cur, F.col("cogs_amount")))).alias("gp"),
        F.count(F.when(in_cur, 1)).alias("orders"),
        F.countDistinct(F.when(in_cur, F.col("customer_id"))).alias("customers"))
    rl = cat.return_items.join(cat.returns.where(F.col("return_date").between(_d(start), _d(end)))
                               .select("return_id"), "return_id")
    rets = rl.agg(F.coalesce(F.sum(F.col("quantity_returned") * F.col("unit_refund_amount")), F.lit(0)).alias("refund"))
    o = cat.orders.where(F.col("order_date").between(_d(start), _d(end))).select("order_id", "order_date")
    ship = (cat.shipments.where(F.col("ship_date").isNotNull()).join(o, "order_id")
            .agg(xavg(days_between("ship_date", "order_date")).alias("lead")))
    j = attach_scalars(attach_scalars(sales, rets), ship)
    return j.select(F.round("net", 2).alias("net_sales"), F.round("prior_net", 2).alias("prior_period_net_sales"),
                    ratio(F.col("net") - F.col("prior_net"), "prior_net", 4).alias("sales_growth_pct"),
                    F.round("gp", 2).alias("gross_profit"), ratio("gp", "net", 4).alias("margin_pct"),
                    F.col("orders").alias("order_count"), ratio("net", "orders", 2).alias("aov"),
                    F.col("customers").alias("active_customers"), ratio("refund", "net", 4).alias("return_rate_value"),
                    F.round("lead", 2).alias("avg_fulfillment_days"))


__all__ = ["monthly_revenue", "store_performance", "customer_rfm_asof", "category_contribution",
           "executive_scorecard"]
