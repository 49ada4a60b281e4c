"""Business queries Q01-Q56 (L3) as DataFrame plans.

Signature ``qNN(cat) -> DataFrame`` with the reference's output columns.
Money is rounded to 2 places, ratios to 4, in DECIMAL arithmetic
(``functions.expr.ratio``); NULL ordering is always written out (N1) and
every LIMIT/rank gets a deterministic tie-breaker (H4).

Plan notes
* "L" (lines of sold orders) is pre-aggregated to order grain whenever the
  query only needs order-level keys (month, day, store, channel, customer):
  ``sold_order_facts`` does one partial aggregation of the line table keyed by
  order, so the join with ``orders`` and all distinct-order counts run on
  order grain.
* Product-level queries aggregate lines by product first and join product
  attributes afterwards.
* Windows without PARTITION BY only run on post-aggregate frames whose size is
  bounded by the calendar (months, days) or by dimension cardinality
  (regions, stores, categories). Per-customer/per-product global orderings go
  through ``operators.ranking``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.expr import month_start, months_between_starts, ratio, xavg, xdiv
from shelfwise.operators.materialize import attach_scalars
from shelfwise.operators.ranking import percentile_cont, top_dense_rank, top_n
from shelfwise.plans import marts as M
from shelfwise.plans.table_functions import executive_scorecard
from shelfwise.sources.catalog import Catalog

B = F.broadcast


def _r2(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several 1-row aggregates (equi-join on a constant key)."""
    out = frames[0]
    for f in frames[1:]:
        out = attach_scalars(out, f)
    return out


def _calendar(cat: Catalog, *cols) -> DataFrame:
    return cat.calendar_date.select(F.col("full_date").alias("order_date"), *cols)


def _monthly_net(cat: Catalog) -> DataFrame:
    return (M.sold_order_facts(cat).groupBy(month_start("order_date").alias("month_start"))
            .agg(F.sum("net_sales").alias("net_sales")))


# ---------------------------------------------------------------- sales
def q01(cat):
    f = M.sold_order_facts(cat).join(B(_calendar(cat, "year_number", "month_number", "month_name")), "order_date")
    return (f.groupBy("year_number", "month_number", "month_name", month_start("order_date").alias("month_start"))
            .agg(_r2(F.sum("net_sales")).alias("net_sales"), F.count(F.lit(1)).alias("order_count"))
            .orderBy("month_start"))


def q02(cat):
    f = M.sold_order_facts(cat).join(B(_calendar(cat, "year_number", "quarter_number")), "order_date")
    return (f.groupBy("year_number", "quarter_number")
            .agg(_r2(F.sum("net_sales")).alias("net_sales"),
                 _r2(F.sum("net_sales") - F.sum("cogs_amount")).alias("gross_profit"),
                 F.count(F.lit(1)).alias("order_count"))
            .orderBy("year_number", "quarter_number"))


def _yoy(monthly: DataFrame, value: str, lag_n: int):
    w = Window.orderBy("month_start")  # months: bounded by the calendar
    prior = F.lag(value, lag_n).over(w)
    return prior, ratio(F.col(value) - prior, prior, 4)


def q03(cat):
    m = _monthly_net(cat)
    prior, growth = _yoy(m, "net_sales", 12)
    return m.select("month_start", _r2("net_sales").alias("net_sales"), _r2(prior).alias("prior_year_sales"),
                    growth.alias("yoy_growth_pct")).orderBy("month_start")


def _share_of_total(df: DataFrame, value: str) -> F.Column:
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy()), 4)


def q04(cat):
    s = cat.stores.select("store_id", "region_id")
    r = cat.regions.select("region_id", "region_code", "region_name")
    per_store = (M.sold_order_facts(cat).where(F.col("store_id").isNotNull())
                 .groupBy("store_id").agg(F.sum("net_sales").alias("net"), F.count(F.lit(1)).alias("orders")))
    g = (per_store.join(s, "store_id").join(B(r), "region_id")
         .groupBy("region_code", "region_name").agg(F.sum("net").alias("net"), F.sum("orders").alias("order_count")))
    return g.select("region_code", "region_name", _r2("net").alias("net_sales"), "order_count",
                    _share_of_total(g, "net").alias("region_share_pct")).orderBy(F.col("net_sales").desc_nulls_first())


def q05(cat):
    s = cat.stores.select("store_id", "store_code", "store_name", "store_format", "region_id", "selling_sq_ft")
    r = cat.regions.select("region_id", "region_name")
    per_store = (M.sold_order_facts(cat).where(F.col("store_id").isNotNull())
                 .groupBy("store_id").agg(F.sum("net_sales").alias("net")))
    g = per_store.join(s, "store_id").join(B(r), "region_id")
    return g.select("store_id", "store_code", "store_name", "store_format", "region_name",
                    _r2("net").alias("net_sales"), ratio("net", "selling_sq_ft", 2).alias("sales_per_sqft"),
                    F.rank().over(Window.orderBy(F.col("net").desc_nulls_first())).alias("sales_rank")
                    ).orderBy(F.col("net_sales").desc_nulls_first(), "store_id")


def _product_sales(cat, active_only=False) -> DataFrame:
    """Per product: net, units, distinct orders.

    A product's orders are counted at the first of its lines in an order (and the first row of the order), told by
    windows over the one sort that the join needs: no task holds a map of its (product, order) pairs.
    """
    def nth(*keys):
        return F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))
    lines = (cat.order_items.select("order_id", "product_id", "line_net_amount", "quantity").repartition("order_id")
             .withColumn("_line", nth("order_id", "product_id")))
    orders = M.sold_orders(cat).select("order_id").withColumn("_row", nth("order_id"))
    per_product = lines.join(orders, "order_id").groupBy("product_id").agg(
        F.sum("line_net_amount").alias("net"), F.sum("quantity").alias("units"),
        F.count(F.when((F.col("_line") == 1) & (F.col("_row") == 1), 1)).alias("orders"))
    p = cat.products.select("product_id", "sku", "product_name", "is_active")
    if active_only:
        p = p.where(F.col("is_active"))
    return per_product.join(p, "product_id")


def q06(cat):
    g = _product_sales(cat)
    return g.select("product_id", "sku", "product_name", _r2("net").alias("net_sales"),
                    F.col("units").alias("units_sold"), F.col("orders").alias("order_count")
                    ).orderBy(F.col("net_sales").desc_nulls_first(), "product_id")


def _category_lines(cat, keys=("category_code", "category_name"), all_status=False, extra_keys=()):
    """Lines aggregated by (product[, extra]) then joined to the category map."""
    lines = M.sold_lines(cat) if not all_status else cat.order_items.join(
        cat.orders.select("order_id", "channel_id"), "order_id")
    per_prod = lines.groupBy("product_id", *extra_keys).agg(
        F.sum("line_net_amount").alias("net"), F.sum("line_cogs_amount").alias("cogs"),
        F.sum("quantity").alias("units"))
    pcm = M.product_category_map(cat).select("product_id", *keys)
    return per_prod.join(pcm, "product_id")


def q07(cat):
    g = _category_lines(cat).groupBy("category_code", "category_name").agg(
        F.sum("net").alias("net"), F.sum("cogs").alias("cogs"), F.sum("units").alias("units_sold"))
    return g.select("category_code", "category_name", _r2("net").alias("net_sales"),
                    _r2(F.col("net") - F.col("cogs")).alias("gross_profit"), "units_sold"
                    ).orderBy(F.col("net_sales").desc_nulls_first())


def _sku_sales(cat, active_only=False):
    per_prod = (M.sold_lines(cat).groupBy("product_id")
                .agg(F.sum("line_net_amount").alias("net"), F.sum("quantity").alias("units")))
    p = cat.products.select("product_id", "sku", "product_name", "is_active")
    if active_only:
        p = p.where(F.col("is_active") == True)  # noqa: E712
    return (per_prod.join(p, "product_id").groupBy("sku", "product_name")
            .agg(F.sum("net").alias("net"), F.sum("units").alias("units_sold")))


def q08(cat):
    g = top_dense_rank(_sku_sales(cat), "net", 20, "sales_rank", ascending=False)
    return g.select("sku", "product_name", _r2("net").alias("net_sales"), "units_sold", "sales_rank"
                    ).orderBy("sales_rank", "sku")


def q09(cat):
    g = _sku_sales(cat, active_only=True).where(F.col("units_sold") >= 5)
    g = top_dense_rank(g, "net", 20, "sales_rank_asc", ascending=True)
    return g.select("sku", "product_name", _r2("net").alias("net_sales"), "units_sold", "sales_rank_asc"
                    ).orderBy("sales_rank_asc", "sku")


def q10(cat):
    o = M.sold_orders(cat)
    return (o.groupBy(month_start("order_date").alias("month_start"))
            .agg(ratio(F.sum("net_amount"), F.count(F.lit(1)), 2).alias("aov"), F.count(F.lit(1)).alias("order_count"))
            .orderBy("month_start"))


def q11(cat):
    f = M.sold_order_facts(cat)
    n = F.count(F.lit(1))
    return (f.groupBy(month_start("order_date").alias("month_start"))
            .agg(ratio(F.sum("units"), n, 2).alias("units_per_transaction"),
                 ratio(F.sum("line_count"), n, 2).alias("lines_per_order"))
            .orderBy("month_start"))


def _daily_net(cat):
    return M.sold_order_facts(cat).groupBy("order_date").agg(F.sum("net_sales").alias("net_sales"))


def q12(cat):
    d = _calendar(cat, "season_name", "day_name", "is_weekend", "day_of_week")
    return (_daily_net(cat).join(B(d), "order_date")
            .groupBy("season_name", "day_name", "is_weekend", "day_of_week")
            .agg(F.round(xavg("net_sales"), 2).alias("avg_daily_net_sales"))
            .orderBy("season_name", "day_of_week").drop("day_of_week"))


def q13(cat):
    d = _daily_net(cat)  # one row per day
    w = Window.orderBy("order_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("order_date", _r2("net_sales").alias("daily_net_sales"),
                    _r2(F.sum("net_sales").over(w)).alias("running_revenue")).orderBy("order_date")


def q14(cat):
    m = _monthly_net(cat)
    w = Window.orderBy("month_start").rowsBetween(-2, Window.currentRow)
    return m.select("month_start", _r2("net_sales").alias("net_sales"),
                    _r2(F.sum("net_sales").over(w)).alias("rolling_3mo_revenue"),
                    F.round(xdiv(F.sum("net_sales").over(w), F.count("net_sales").over(w)), 2).alias("rolling_3mo_avg")
                    ).orderBy("month_start")


def q15(cat):
    g = _category_lines(cat, keys=("category_name",)).groupBy("category_name").agg(F.sum("net").alias("net"))
    total = F.sum("net").over(Window.partitionBy())
    cum = F.sum("net").over(Window.orderBy(F.col("net").desc_nulls_first())
                            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return g.select("category_name", _r2("net").alias("net_sales"), ratio(F.col("net"), total, 4).alias("contribution_pct"),
                    ratio(cum, total, 4).alias("cumulative_pct")).orderBy(F.col("net_sales").desc_nulls_first())


def q16(cat):
    s = cat.stores.select("store_id", "region_id")
    r = cat.regions.select("region_id", "region_name")
    ch = cat.channels.select("channel_id", "channel_name")
    # aggregate to (store, channel) first, then grouping sets over the small result
    base = (M.sold_order_facts(cat).groupBy("store_id", "channel_id").agg(F.sum("net_sales").alias("net"))
            .join(s, "store_id", "left").join(B(r), "region_id", "left").join(B(ch), "channel_id"))
    g = base.groupingSets([["region_name", "channel_name"], ["region_name"], ["channel_name"], []],
                          "region_name", "channel_name").agg(
        F.sum("net").alias("net"), F.grouping("region_name").alias("is_region_total"),
        F.grouping("channel_name").alias("is_channel_total"))
    return g.select(F.coalesce("region_name", F.lit("ALL REGIONS")).alias("region_name"),
                    F.coalesce("channel_name", F.lit("ALL CHANNELS")).alias("channel_name"),
                    _r2("net").alias("net_sales"), F.col("is_region_total").cast("int").alias("is_region_total"),
                    F.col("is_channel_total").cast("int").alias("is_channel_total")
                    ).orderBy("is_region_total", "region_name", "is_channel_total", "channel_name")


def q17(cat):
    m = _monthly_net(cat)
    w = Window.orderBy("month_start")
    prior = F.lag("net_sales", 1).over(w)
    return m.select("month_start", _r2("net_sales").alias("net_sales"), _r2(prior).alias("prior_month"),
                    ratio(F.col("net_sales") - prior, prior, 4).alias("mom_growth_pct"),
                    _r2(F.lead("net_sales", 1).over(w)).alias("next_month_sales")).orderBy("month_start")


# ---------------------------------------------------------------- customers
def q18(cat):
    c = M.customer_360(cat).where(F.col("order_count").isNotNull())
    top = top_n(c, [F.col("lifetime_gross_profit").desc_nulls_last(), F.col("customer_id").asc()], 100)
    return top.select("customer_id", "customer_number", "customer_type", "loyalty_tier", "order_count",
                      _r2("lifetime_net_sales").alias("lifetime_net_sales"),
                      _r2("lifetime_gross_profit").alias("historical_clv"), "lifecycle_status")


def q19(cat):
    r = M.customer_rfm(cat)
    return (r.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"), F.round(xavg("lifetime_net_sales"), 2).alias("avg_monetary"),
        F.round(xavg("order_count"), 2).alias("avg_frequency"),
        F.round(xavg("days_since_last_order"), 1).alias("avg_recency_days"))
        .orderBy(F.col("customer_count").desc_nulls_first(), "rfm_segment"))


def q20(cat):
    per_cust = M.sold_orders(cat).groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"))
    n, rep = F.count(F.lit(1)), F.count(F.when(F.col("orders") >= 2, 1))
    return per_cust.agg(n.alias("customers_with_orders"), rep.alias("repeat_customers"),
                        ratio(rep, n, 4).alias("repeat_purchase_rate"))


def _customer_months(cat) -> DataFrame:
    """Distinct (customer, month) of sold orders (partial aggregation dedups)."""
    return (M.sold_orders(cat).select("customer_id", month_start("order_date").alias("month_start"))
            .distinct())


def q21(cat):
    cm = _customer_months(cat)
    first = cm.groupBy("customer_id").agg(F.min("month_start").alias("first_month"))
    j = cm.join(first, "customer_id")
    status = F.when(F.col("month_start") == F.col("first_month"), "New").otherwise("Returning")
    return (j.groupBy("month_start", status.alias("customer_status")).agg(F.count(F.lit(1)).alias("customers"))
            .orderBy("month_start", "customer_status"))


def q22(cat):
    cm = _customer_months(cat)
    first = cm.groupBy("customer_id").agg(F.min("month_start").alias("cohort_month"))
    j = cm.withColumnRenamed("month_start", "activity_month").join(first, "customer_id")
    return (j.groupBy("cohort_month", "activity_month")
            .agg(F.count(F.lit(1)).alias("active_customers"))
            .select("cohort_month", "activity_month",
                    months_between_starts("activity_month", "cohort_month").alias("months_since_acquisition"),
                    "active_customers")
            .orderBy("cohort_month", "activity_month"))


def q23(cat):
    current = month_start(F.lit(cat.as_of))
    prior = F.add_months(current, -1)
    o = cat.orders.select("customer_id", month_start("order_date").alias("m"))  # all statuses (D10)
    o = o.where(F.col("m").isin(current, prior))
    per = o.groupBy("customer_id").agg(F.max(F.col("m") == prior).alias("in_prior"),
                                       F.max(F.col("m") == current).alias("in_current"))
    n = F.count(F.when(F.col("in_prior"), 1))
    kept = F.count(F.when(F.col("in_prior") & F.col("in_current"), 1))
    return per.agg(n.alias("prior_buyers"), kept.alias("retained_buyers"), ratio(kept, n, 4).alias("retention_rate")) \
              .select(prior.alias("prior_month"), current.alias("current_month"), "prior_buyers",
                      "retained_buyers", "retention_rate")


def q24(cat):
    c = M.customer_360(cat).where(F.col("lifecycle_status").isin("Churn Risk", "At Risk")
                                  | (F.coalesce("days_since_last_order", F.lit(0)) > 90))
    return (c.groupBy("lifecycle_status").agg(
        F.count(F.lit(1)).alias("customers"), _r2(F.sum("lifetime_net_sales")).alias("historical_sales_at_risk"),
        F.round(xavg("days_since_last_order"), 1).alias("avg_days_inactive"))
        .orderBy(F.col("historical_sales_at_risk").desc_nulls_last()))


def q25(cat):
    c = M.customer_360(cat).where(F.col("lifetime_gross_profit").isNotNull())
    top = top_n(c, [F.col("lifetime_gross_profit").desc_nulls_last(), F.col("customer_id").asc()], 50, "value_rank")
    return top.select("customer_id", "customer_number", "loyalty_tier", "order_count",
                      _r2("lifetime_gross_profit").alias("historical_clv"),
                      _r2("lifetime_net_sales").alias("lifetime_net_sales"), "value_rank").orderBy("value_rank")


def q26(cat, limit: int | None = None):
    c = M.customer_360(cat).where((F.col("days_since_last_order") > 180) & (F.col("order_count") >= 2))
    top = top_n(c, [F.col("lifetime_net_sales").desc_nulls_first(), F.col("customer_id").asc()], limit)
    return top.select("customer_id", "customer_number", "customer_type", "last_order_date", "days_since_last_order",
                      _r2("lifetime_net_sales").alias("lifetime_net_sales"), "order_count")


def q27(cat):
    c = cat.customers.select("customer_id", "customer_type", "preferred_store_id")
    s = cat.stores.select(F.col("store_id").alias("preferred_store_id"), "state_code", "region_id")
    r = cat.regions.select("region_id", "region_name")
    j = c.join(s, "preferred_store_id", "left").join(B(r), "region_id", "left")
    return (j.groupBy("region_name", "state_code").agg(
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct(F.when(F.col("customer_type") == "Loyalty", F.col("customer_id"))).alias("loyalty_customers"))
        .orderBy(F.col("customers").desc_nulls_first(), "region_name", "state_code"))


def q28(cat):
    c = M.customer_360(cat).where(F.col("lifetime_net_sales").isNotNull())
    out = percentile_cont(c, "lifetime_net_sales", {"p50_sales": 0.5, "p90_sales": 0.9, "p99_sales": 0.99},
                          extra_aggs={"avg_sales": F.round(xavg("lifetime_net_sales"), 2)})
    return out.select(*[_r2(c).alias(c) for c in ("p50_sales", "p90_sales", "p99_sales")], "avg_sales")


# ---------------------------------------------------------------- finance
def q29(cat):
    f = M.sold_order_facts(cat)
    return (f.groupBy(month_start("order_date").alias("month_start"))
            .agg(_r2(F.sum("net_sales")).alias("net_sales"), _r2(F.sum("cogs_amount")).alias("cogs"),
                 _r2(F.sum("net_sales") - F.sum("cogs_amount")).alias("gross_profit"))
            .orderBy("month_start"))


def q30(cat):
    ch = cat.channels.select("channel_id", "channel_name")
    g = (_category_lines(cat, keys=("category_name",), extra_keys=("channel_id",)).join(B(ch), "channel_id")
         .groupBy("category_name", "channel_name").agg(F.sum("net").alias("net"), F.sum("cogs").alias("cogs")))
    return g.select("category_name", "channel_name", _r2("net").alias("net_sales"),
                    ratio(F.col("net") - F.col("cogs"), "net", 4).alias("gross_margin_pct")
                    ).orderBy(F.col("gross_margin_pct").asc_nulls_last(), "category_name", "channel_name")


def q31(cat):
    f = M.sold_order_facts(cat)
    return (f.groupBy(month_start("order_date").alias("month_start"))
            .agg(_r2(F.sum("gross_sales")).alias("gross_sales"), _r2(F.sum("discount_amount")).alias("discount_amount"),
                 ratio(F.sum("discount_amount"), F.sum("gross_sales"), 4).alias("discount_rate"),
                 ratio(F.sum("promo_net_sales"), F.sum("net_sales"), 4).alias("promo_sales_mix"))
            .orderBy("month_start"))


def q32(cat):
    g = _category_lines(cat, keys=("category_name",)).groupBy("category_name").agg(
        F.sum("net").alias("net"), F.sum("cogs").alias("cogs"))
    return g.select("category_name", _r2("net").alias("revenue"), _r2("cogs").alias("cost"),
                    _r2(F.col("net") - F.col("cogs")).alias("profit"), ratio("cogs", "net", 4).alias("cost_ratio")
                    ).orderBy(F.col("profit").desc_nulls_first())


def q33(cat):
    m = M.payment_mix(cat)
    total = F.sum("payment_amount").over(Window.partitionBy("payment_month"))
    return m.select("method_group", "method_name", "payment_month", "payment_count",
                    _r2("payment_amount").alias("payment_amount"),
                    ratio(F.col("payment_amount"), total, 4).alias("month_share")
                    ).orderBy(F.col("payment_month").desc_nulls_first(), F.col("payment_amount").desc_nulls_first())


def q34(cat):
    f = M.sold_order_facts(cat)
    sales = f.groupBy(month_start("order_date").alias("month_start")).agg(
        F.sum("net_sales").alias("net"), F.sum("cogs_amount").alias("cogs"),
        F.sum("discount_amount").alias("disc"), F.count(F.lit(1)).alias("orders"))
    rl = cat.return_items.join(cat.returns.select("return_id", "return_date"), "return_id")
    refunds = rl.groupBy(month_start("return_date").alias("month_start")).agg(
        F.sum(F.col("quantity_returned") * F.col("unit_refund_amount")).alias("refund"))
    j = sales.join(refunds, "month_start", "left")
    return j.select("month_start", _r2("net").alias("net_sales"), _r2("cogs").alias("cogs"),
                    _r2(F.col("net") - F.col("cogs")).alias("gross_profit"),
                    ratio(F.col("net") - F.col("cogs"), "net", 4).alias("margin_pct"),
                    _r2("disc").alias("discounts"), _r2(F.coalesce("refund", F.lit(0))).alias("refunds"), "orders"
                    ).orderBy("month_start")


# ---------------------------------------------------------------- operations
def _turnover(cogs: str, value: str, positions: str) -> Column:
    """cogs / (value / positions), rounded to cents. cogs * positions leaves DECIMAL's 38 digits at size, so the
    whole and the fractional part of cogs / value are multiplied apart: both products keep their digits."""
    c, v, n = F.col(cogs), F.col(value), F.col(positions)
    whole = F.floor(xdiv(c, v)).cast("decimal(20,0)")
    rest = c - whole * v  # less than the value
    return F.when(v == 0, F.lit(None)).otherwise(F.round((whole * n).cast("decimal(38,8)") + xdiv(rest * n.cast("decimal(12,0)"), v), 2))


def q35(cat):
    since = F.date_sub(F.lit(cat.as_of), 365)
    o = cat.orders.where(F.col("order_date") >= since).select("order_id")  # all statuses (D10)
    cogs = M.order_totals(cat).join(o, "order_id").agg(F.sum("cogs_amount").alias("cogs"))
    inv = (cat.inventory.join(cat.products.select("product_id", "current_unit_cost"), "product_id")
           .agg(F.sum(F.col("quantity_on_hand") * F.col("current_unit_cost")).alias("inv_sum"),
                F.count(F.col("quantity_on_hand") * F.col("current_unit_cost")).alias("inv_n")))
    j = one_row_join(cogs, inv)
    return j.select(_r2("cogs").alias("cogs_trailing_year"),
                    ratio("inv_sum", "inv_n", 2).alias("avg_inventory_value_proxy"),
                    _turnover("cogs", "inv_sum", "inv_n").alias("inventory_turnover_proxy"))


def q36(cat, limit: int | None = None):
    since = F.date_sub(F.lit(cat.as_of), 90)
    o = cat.orders.where(F.col("order_date") >= since).select("order_id", "order_date")
    per_day = (cat.order_items.join(o, "order_id").groupBy("product_id", "order_date")
               .agg(F.sum("quantity").alias("units")))
    demand = per_day.groupBy("product_id").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("days"))
    stock = cat.inventory.groupBy("product_id").agg(F.sum("quantity_on_hand").alias("on_hand"))
    p = cat.products.select("product_id", "sku", "product_name")
    j = stock.join(demand, "product_id").join(p, "product_id")
    j = j.select("sku", "product_name", "on_hand", ratio("units", "days", 2).alias("avg_daily_units"),
                 ratio(F.col("on_hand") * F.col("days"), "units", 1).alias("days_of_supply"))
    return top_n(j, [F.col("days_of_supply").asc_nulls_last(), F.col("sku").asc()], limit)


def q37a(cat):
    h = M.inventory_health(cat)
    return (h.groupBy("stock_status", "location_type").agg(
        F.count(F.lit(1)).alias("positions"), _r2(F.sum("inventory_value_cost")).alias("inventory_value"))
        .orderBy("stock_status", "location_type"))


def q37b(cat, limit: int | None = None):
    s = cat.inventory_snapshots
    out = s.groupBy("snapshot_date").agg(
        F.count(F.when(F.col("quantity_on_hand") == 0, 1)).alias("stockout_rows"),
        F.count(F.lit(1)).alias("total_rows"))
    out = out.withColumn("stockout_rate", ratio("stockout_rows", "total_rows", 4))
    return top_n(out, [F.col("snapshot_date").desc_nulls_first()], limit)


def q38(cat):
    sp = M.supplier_performance(cat)
    return sp.select("supplier_code", "supplier_name", "supplier_tier", "po_count", "units_ordered", "units_received",
                     F.round("fill_rate", 4).alias("fill_rate"), F.round("on_time_rate", 4).alias("on_time_rate"),
                     F.round("avg_actual_lead_time_days", 1).alias("avg_lead_time_days")
                     ).orderBy(F.col("fill_rate").asc_nulls_last(), "supplier_code")


def q39(cat):
    sp = M.supplier_performance(cat)
    a, c = xavg("avg_actual_lead_time_days"), xavg("contracted_lead_time_days")
    return (sp.groupBy("supplier_tier").agg(
        F.round(c, 1).alias("avg_contracted_lead"), F.round(a, 1).alias("avg_actual_lead"),
        F.round(a - c, 1).alias("lead_time_variance_days")).orderBy("supplier_tier"))


def q40(cat):
    since = F.date_sub(F.lit(cat.as_of), 90)
    o = cat.orders.where(F.col("store_id").isNotNull() & (F.col("order_date") >= since)).select("order_id", "store_id")
    ss = M.order_totals(cat).join(o, "order_id").groupBy("store_id").agg(F.sum("net_sales").alias("net"))
    lab = (cat.store_labor_hours.where(F.col("work_date") >= since).groupBy("store_id")
           .agg(F.sum("labor_hours").alias("hours")))
    s = cat.stores.select("store_id", "store_code", "store_name", "region_id")
    r = cat.regions.select("region_id", "region_name")
    j = ss.join(s, "store_id").join(B(r), "region_id").join(lab, "store_id", "left")
    prod = xdiv("net", "hours")
    return j.select("store_code", "store_name", "region_name", _r2("net").alias("net_sales_90d"),
                    F.round("hours", 1).alias("labor_hours_90d"), ratio("net", "hours", 2).alias("sales_per_labor_hour"),
                    F.rank().over(Window.orderBy(prod.desc_nulls_last())).alias("productivity_rank")
                    ).orderBy(F.col("sales_per_labor_hour").desc_nulls_last(), "store_code")


def q41(cat):
    sp = M.shipment_performance(cat).where(F.col("dc_code").isNotNull())
    n = F.count(F.lit(1))
    late = F.count(F.when(F.col("delay_flag") != "On Track", 1))
    return (sp.groupBy("dc_code", "dc_name").agg(
        n.alias("shipments"), F.round(xavg("fulfillment_lead_time_days"), 2).alias("avg_fulfillment_days"),
        F.round(xavg("transit_days"), 2).alias("avg_transit_days"), late.alias("delayed_shipments"),
        ratio(late, n, 4).alias("delay_rate")).orderBy(F.col("delay_rate").desc_nulls_first(), "dc_code"))


def q42(cat, limit: int | None = None):
    sp = M.shipment_performance(cat).where(F.col("delay_flag").isin("Delayed Ship", "Delayed Delivery"))
    top = top_n(sp, [F.col("fulfillment_lead_time_days").desc_nulls_last(), F.col("shipment_id").asc()], limit)
    return top.select("shipment_id", "order_id", "order_date", "ship_date", "fulfillment_lead_time_days",
                      "carrier_name", "delay_flag", "dc_name")


def q43(cat):
    ch = cat.channels.select("channel_id", "channel_name")
    sold = (_category_lines(cat, keys=("category_name",), all_status=True, extra_keys=("channel_id",))
            .join(B(ch), "channel_id").groupBy("category_name", "channel_name")
            .agg(F.sum("units").alias("units_sold"), F.sum("net").alias("net_sales")))
    pcm = M.product_category_map(cat).select("product_id", "category_name")
    ret = (M.fact_return_line(cat).groupBy("product_id", "channel_id")
           .agg(F.sum("quantity_returned").alias("u"), F.sum("refund_line_amount").alias("v"))
           .join(pcm, "product_id").join(B(ch), "channel_id")
           .groupBy("category_name", "channel_name").agg(F.sum("u").alias("units_returned"),
                                                         F.sum("v").alias("refund_amount")))
    j = sold.join(ret, ["category_name", "channel_name"], "left")
    return j.select("category_name", "channel_name", ratio("units_returned", "units_sold", 4).alias("return_rate_units"),
                    ratio("refund_amount", "net_sales", 4).alias("return_rate_value")
                    ).orderBy(F.col("return_rate_value").desc_nulls_last(), "category_name", "channel_name")


def q44(cat):
    r = M.fact_return_line(cat)
    flag = F.when(F.col("restock_flag"), 1).otherwise(0)
    return (r.groupBy("return_reason_code").agg(
        F.count(F.lit(1)).alias("return_lines"), F.sum("quantity_returned").alias("units_returned"),
        _r2(F.sum("refund_line_amount")).alias("refund_cost"), ratio(F.sum(flag), F.count(F.lit(1)), 4).alias("restock_rate"))
        .orderBy(F.col("refund_cost").desc_nulls_first()))


# ---------------------------------------------------------------- marketing
def q45(cat):
    c = M.campaign_performance(cat).where(F.col("actual_spend") > 0)
    return c.select("campaign_code", "campaign_name", "campaign_type", _r2("actual_spend").alias("actual_spend"),
                    _r2("order_gross_profit").alias("order_gross_profit"), F.round("campaign_roi", 4).alias("campaign_roi"),
                    "attributed_orders", "conversion_rate").orderBy(F.col("campaign_roi").desc_nulls_last(), "campaign_code")


def q46(cat):
    c = M.campaign_performance(cat)
    return (c.groupBy("campaign_type").agg(
        F.sum("sent_count").alias("sent_count"), F.sum("open_count").alias("open_count"),
        F.sum("click_count").alias("click_count"), F.sum("convert_count").alias("convert_count"),
        ratio(F.sum("convert_count"), F.sum("sent_count"), 4).alias("conversion_rate"),
        ratio(F.sum("click_count"), F.sum("open_count"), 4).alias("click_to_open_rate"))
        .orderBy(F.col("conversion_rate").desc_nulls_last(), "campaign_type"))


def q47(cat):
    c = M.campaign_performance(cat)
    return c.select("campaign_code", "campaign_name", "objective_code", _r2("order_net_sales").alias("attributed_net_sales"),
                    "attributed_orders", "attributed_customers",
                    ratio("order_net_sales", "attributed_orders", 2).alias("aov_on_attributed_orders")
                    ).orderBy(F.col("order_net_sales").desc_nulls_first(), "campaign_code")


def q48(cat):
    o = cat.orders.where(F.col("campaign_id").isNotNull()).select("order_id", "campaign_id", "store_id")
    per = M.order_totals(cat).join(o, "order_id").groupBy("campaign_id", "store_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("net_sales").alias("net"))
    mc = cat.marketing_campaigns.select("campaign_id", "campaign_code")
    s = cat.stores.select("store_id", "region_id")
    r = cat.regions.select("region_id", "region_name")
    j = per.join(mc, "campaign_id").join(s, "store_id", "left").join(B(r), "region_id", "left")
    return (j.groupBy("campaign_code", "region_name").agg(F.sum("orders").alias("attributed_orders"),
                                                         _r2(F.sum("net")).alias("net_sales"))
            .orderBy("campaign_code", F.col("net_sales").desc_nulls_first()))


def q49(cat):
    # first order = smallest order id (D14); min_by carries its campaign, no rejoin
    first = M.sold_orders(cat).groupBy("customer_id").agg(F.min_by("campaign_id", "order_id").alias("campaign_id"))
    mc = cat.marketing_campaigns.select("campaign_id", "campaign_code", "campaign_name", "objective_code")
    return (first.where(F.col("campaign_id").isNotNull()).join(mc, "campaign_id")
            .groupBy("campaign_code", "campaign_name", "objective_code")
            .agg(F.count(F.lit(1)).alias("new_customers_acquired"))
            .orderBy(F.col("new_customers_acquired").desc_nulls_first(), "campaign_code"))


# ---------------------------------------------------------------- executive
def q50(cat):
    as_of = cat.as_of
    return executive_scorecard(cat, as_of - dt.timedelta(days=30), as_of)


def q51(cat):
    since = F.date_sub(F.lit(cat.as_of), 90)
    dec = "decimal(38,2)"
    churn = (M.customer_360(cat).where(F.col("lifecycle_status") == "Churn Risk")
             .agg(_r2(F.sum("lifetime_net_sales")).cast(dec).alias("exposure_amount"))
             .select(F.lit("High churn-risk customer sales").alias("risk_name"), "exposure_amount",
                     F.lit("Customer").alias("domain")))
    stock = (M.inventory_health(cat).where(F.col("stock_status") == "Stockout")
             .agg(F.count(F.lit(1)).cast(dec).alias("exposure_amount"))
             .select(F.lit("Stockout inventory positions").alias("risk_name"), "exposure_amount",
                     F.lit("Operations").alias("domain")))
    camp = (M.campaign_performance(cat).where(F.col("campaign_roi").isNotNull() & (F.col("campaign_roi") < 0))
            .agg(F.count(F.lit(1)).cast(dec).alias("exposure_amount"))
            .select(F.lit("Negative/low ROI campaigns (count)").alias("risk_name"), "exposure_amount",
                    F.lit("Marketing").alias("domain")))
    ship = (M.shipment_performance(cat).where((F.col("delay_flag") != "On Track") & (F.col("order_date") >= since))
            .agg(F.count(F.lit(1)).cast(dec).alias("exposure_amount"))
            .select(F.lit("Delayed shipments (90d)").alias("risk_name"), "exposure_amount",
                    F.lit("Operations").alias("domain")))
    u = churn.unionByName(stock).unionByName(camp).unionByName(ship)
    return u.select("risk_name", "domain", "exposure_amount",
                    F.rank().over(Window.orderBy(F.col("exposure_amount").desc_nulls_first())).alias("risk_rank")
                    ).orderBy("risk_rank", "risk_name")


def q52(cat):
    dec = "decimal(38,2)"
    champs = (M.customer_rfm(cat).where(F.col("rfm_segment") == "Champions")
              .agg(F.count(F.lit(1)).cast(dec).alias("magnitude"), _r2(F.sum("lifetime_net_sales")).cast(dec).alias("value_signal"))
              .select(F.lit("Champions customers expand").alias("opportunity"), "magnitude", "value_signal"))
    camps = (M.campaign_performance(cat).where(F.col("campaign_roi") >= 1)
             .agg(F.count(F.lit(1)).cast(dec).alias("magnitude"), _r2(F.sum("order_gross_profit")).cast(dec).alias("value_signal"))
             .select(F.lit("Top ROI campaigns to scale").alias("opportunity"), "magnitude", "value_signal"))
    below = (M.inventory_health(cat).where(F.col("stock_status") == "Below Reorder")
             .agg(F.count(F.lit(1)).cast(dec).alias("magnitude"),
                  _r2(F.sum("inventory_value_cost")).cast(dec).alias("value_signal"))
             .select(F.lit("Below-reorder SKUs to replenish").alias("opportunity"), "magnitude", "value_signal"))
    return champs.unionByName(camps).unionByName(below).orderBy(F.col("value_signal").desc_nulls_last())


def q53(cat):
    since = F.date_sub(F.lit(cat.as_of), 30)
    s = (M.sales_daily(cat).where(F.col("order_date") >= since)
         .agg(F.sum("net_sales").alias("net"), F.sum("gross_profit").alias("gp"), F.sum("order_count").alias("orders")))
    c = M.customer_360(cat).agg(
        F.count(F.when(F.col("lifecycle_status") == "Active", 1)).alias("active"),
        F.count(F.when(F.col("lifecycle_status") == "Churn Risk", 1)).alias("churn"))
    o = M.inventory_health(cat).agg(F.count(F.when(F.col("stock_status") == "Stockout", 1)).alias("stockouts"))
    j = one_row_join(s, c, o)
    txt = lambda e: e.cast("string")
    kv = F.array(
        F.struct(F.lit("net_sales_30d").alias("kpi"), txt(_r2("net")).alias("kpi_value")),
        F.struct(F.lit("gross_profit_30d").alias("kpi"), txt(_r2("gp")).alias("kpi_value")),
        F.struct(F.lit("margin_pct_30d").alias("kpi"), txt(ratio("gp", "net", 4)).alias("kpi_value")),
        F.struct(F.lit("orders_30d").alias("kpi"), txt(F.col("orders")).alias("kpi_value")),
        F.struct(F.lit("aov_30d").alias("kpi"), txt(ratio("net", "orders", 2)).alias("kpi_value")),
        F.struct(F.lit("active_customers").alias("kpi"), txt(F.col("active")).alias("kpi_value")),
        F.struct(F.lit("churn_risk_customers").alias("kpi"), txt(F.col("churn")).alias("kpi_value")),
        F.struct(F.lit("stockout_positions").alias("kpi"), txt(F.col("stockouts")).alias("kpi_value")))
    return j.select(F.inline(kv)).orderBy("kpi")


def q54(cat):
    """Category tree walk as one recursive query, to any depth.

    A row has one parent, so no cycle can be reached from a root and the walk ends; Spark's own bound on
    recursion levels and rows raises an error where it is hit, it never cuts the result.
    """
    cat.product_categories.createOrReplaceTempView("shelfwise_category_tree")
    return cat.product_categories.sparkSession.sql("""
        WITH RECURSIVE tree AS (
          SELECT category_id, category_code, category_name, parent_category_id, category_level, category_code AS path
          FROM shelfwise_category_tree WHERE parent_category_id IS NULL
          UNION ALL
          SELECT k.category_id, k.category_code, k.category_name, k.parent_category_id, k.category_level,
                 concat(t.path, ' > ', k.category_code)
          FROM shelfwise_category_tree k JOIN tree t ON k.parent_category_id = t.category_id)
        SELECT * FROM tree ORDER BY path""")


def q55(cat):
    cutoff = F.add_months(F.lit(cat.as_of), -13)
    eligible = cat.stores.where((F.col("open_date") <= cutoff) & (F.col("is_active") == True)).select("store_id")  # noqa
    f = M.sold_order_facts(cat).join(eligible, "store_id", "left_semi")
    m = f.groupBy(month_start("order_date").alias("month_start")).agg(F.sum("net_sales").alias("net"))
    prior = F.lag("net", 12).over(Window.orderBy("month_start"))
    return m.select("month_start", _r2("net").alias("sss_net_sales"),
                    ratio(F.col("net") - prior, prior, 4).alias("sss_yoy_growth_pct")).orderBy("month_start")


def q56(cat):
    ch = cat.channels.select("channel_id", "channel_group")
    m = (M.sold_order_facts(cat).groupBy(month_start("order_date").alias("month_start"), "channel_id")
         .agg(F.sum("net_sales").alias("net")).join(B(ch), "channel_id")
         .groupBy("month_start", "channel_group").agg(F.sum("net").alias("net")))
    m = m.withColumn("mix", xdiv("net", F.sum("net").over(Window.partitionBy("month_start"))))
    w = Window.partitionBy("channel_group").orderBy("month_start").rowsBetween(-2, Window.currentRow)
    return m.select("month_start", "channel_group", _r2("net").alias("net_sales"), F.round("mix", 4).alias("mix_pct"),
                    F.round(xdiv(F.sum("mix").over(w), F.count("mix").over(w)), 4).alias("mix_pct_ma3")
                    ).orderBy("month_start", "channel_group")


QUERIES = {f"q{i:02d}": globals()[f"q{i:02d}"] for i in range(1, 57) if f"q{i:02d}" in globals()}
QUERIES.pop("q37", None)
QUERIES["q37a"], QUERIES["q37b"] = q37a, q37b
