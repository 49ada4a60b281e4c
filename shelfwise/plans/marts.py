"""Analytical marts M01-M15 (L2).

Each mart is ``fn(cat) -> DataFrame``; ``cat.as_of`` replaces the
reference's ``CURRENT_DATE``/``NOW()``. Marts are memoised on the catalog
so a query that uses one twice gets the same plan object (exchange reuse).

Plan shape, for scale:
* Line-grain facts are pre-aggregated to order grain right after the scan
  (map-side partial aggregation), so the big join with ``orders`` happens on
  order grain and distinct-order counts become plain counts (H2).
* Dimension attributes are joined *after* aggregation (H5).
* Global NTILE uses the range-partitioned ranking operator (H1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.expr import days_between, is_sold, month_start, ratio, xavg, xdiv
from shelfwise.operators.ranking import with_ntile
from shelfwise.sources.catalog import Catalog

B = F.broadcast


def sold_orders(cat: Catalog) -> DataFrame:
    return cat.orders.where(is_sold())


def order_totals(cat: Catalog) -> DataFrame:
    """Line measures summed per order (all statuses), order grain."""
    def build():
        oi = cat.order_items
        return oi.groupBy("order_id").agg(
            # COUNT(order_item_id): the id is a non-NULL key, so this is COUNT(*); not
            # reading the id lets Catalyst drop the binding's id window
            F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("units"),
            F.sum("line_gross_amount").alias("gross_sales"), F.sum("discount_amount").alias("discount_amount"),
            F.sum("line_net_amount").alias("net_sales"), F.sum("line_cogs_amount").alias("cogs_amount"),
            F.sum(F.when(F.col("promotion_id").isNotNull(), F.col("line_net_amount"))).alias("promo_net_sales"))
    return cat.memo("order_totals", build)


def sold_order_facts(cat: Catalog) -> DataFrame:
    """Sold orders with their line totals (orders without lines drop out, as
    in the reference's inner join)."""
    def build():
        o = sold_orders(cat).select("order_id", "order_date", "customer_id", "store_id", "channel_id",
                                    "campaign_id", "net_amount")
        return order_totals(cat).join(o, "order_id")
    return cat.memo("sold_order_facts", build)


def sold_lines(cat: Catalog) -> DataFrame:
    """``L``: order lines of sold orders (line grain)."""
    def build():
        o = sold_orders(cat).select("order_id", "order_date", "customer_id", "store_id", "channel_id",
                                    "campaign_id")
        return cat.order_items.join(o, "order_id")
    return cat.memo("sold_lines", build)


# M01
def product_category_map(cat: Catalog) -> DataFrame:
    def build():
        p = cat.products
        c2 = cat.product_categories.select(F.col("category_id").alias("subcategory_id"),
                                           F.col("category_code").alias("subcategory_code"),
                                           F.col("category_name").alias("subcategory_name"),
                                           F.col("parent_category_id").alias("_parent"))
        c1 = cat.product_categories.select(F.col("category_id").alias("_parent"), "category_code", "category_name")
        return (p.join(c2, p.category_id == c2.subcategory_id)
                .join(c1, "_parent", "left")
                .select("product_id", "sku", "product_name", "brand_name", "is_active", "current_list_price",
                        "current_unit_cost", "primary_supplier_id", "subcategory_id", "subcategory_code",
                        "subcategory_name", F.col("_parent").alias("category_id"), "category_code", "category_name"))
    return cat.memo("m01", build)


# M02
def fact_sales_line(cat: Catalog) -> DataFrame:
    def build():
        oi = cat.order_items
        o = sold_orders(cat).select("order_id", "order_number", "order_date", "order_timestamp", "order_status",
                                    "customer_id", "store_id", "channel_id", "campaign_id", "employee_id")
        d = cat.calendar_date.select(F.col("full_date").alias("order_date"), "year_number", "quarter_number",
                                     "month_number", "month_name", "week_of_year", "season_name", "is_weekend",
                                     "is_holiday")
        profit = F.col("line_net_amount") - F.col("line_cogs_amount")
        return (oi.join(o, "order_id").join(B(d), "order_date")
                .select("order_item_id", "order_id", "order_number", "order_date", "order_timestamp", "order_status",
                        "customer_id", "store_id", "channel_id", "campaign_id", "employee_id", "product_id",
                        "line_number", "quantity", "unit_price", "unit_cost", "discount_amount", "line_gross_amount",
                        "line_net_amount", "line_cogs_amount", profit.alias("line_gross_profit"),
                        F.when(F.col("line_net_amount") == 0, F.lit(None))
                        .otherwise(ratio(profit, "line_net_amount", 4)).alias("line_margin_pct"),
                        "promotion_id", "is_gift", "year_number", "quarter_number", "month_number", "month_name",
                        "week_of_year", "season_name", "is_weekend", "is_holiday"))
    return cat.memo("m02", build)


# M03
def sales_daily(cat: Catalog) -> DataFrame:
    def build():
        f = sold_order_facts(cat)
        agg = f.groupBy("order_date", "store_id", "channel_id").agg(
            F.count(F.lit(1)).alias("order_count"), F.sum("units").alias("units_sold"),
            F.sum("gross_sales").alias("gross_sales"), F.sum("discount_amount").alias("discount_amount"),
            F.sum("net_sales").alias("net_sales"), F.sum("cogs_amount").alias("cogs_amount"),
            (F.sum("net_sales") - F.sum("cogs_amount")).alias("gross_profit"))
        d = cat.calendar_date.select(F.col("full_date").alias("order_date"), "year_number", "quarter_number",
                                     "month_number")
        s = cat.stores.select("store_id", "store_code", "store_name", "store_format", "region_id")
        r = cat.regions.select("region_id", "region_code", "region_name")
        ch = cat.channels.select("channel_id", "channel_code", "channel_name")
        return (agg.join(B(d), "order_date").join(s, "store_id", "left").join(B(r), "region_id", "left")
                .join(B(ch), "channel_id")
                .select("order_date", "year_number", "quarter_number", "month_number", "store_id", "store_code",
                        "store_name", "store_format", "region_id", "region_code", "region_name", "channel_id",
                        "channel_code", "channel_name", "order_count", "units_sold", "gross_sales",
                        "discount_amount", "net_sales", "cogs_amount", "gross_profit"))
    return cat.memo("m03", build)


# M04
def sales_monthly(cat: Catalog) -> DataFrame:
    def build():
        return (sales_daily(cat)
                .groupBy("year_number", "month_number", month_start("order_date").alias("month_start"))
                .agg(*[F.sum(c).alias(c) for c in ("net_sales", "gross_sales", "cogs_amount", "gross_profit",
                                                   "discount_amount", "order_count", "units_sold")]))
    return cat.memo("m04", build)


# M05
def customer_360(cat: Catalog) -> DataFrame:
    def build():
        as_of = F.lit(cat.as_of)
        f = sold_order_facts(cat)
        stats = f.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("order_count"),
            F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
            F.sum("net_sales").alias("lifetime_net_sales"),
            (F.sum("net_sales") - F.sum("cogs_amount")).alias("lifetime_gross_profit"),
            F.sum("units").alias("lifetime_units"),
            # AVG(o.net_amount) over the line join = line-weighted
            xdiv(F.sum(F.col("net_amount") * F.col("line_count")), F.sum("line_count")).alias("avg_order_value"))
        c = cat.customers.select("customer_id", "customer_number", "customer_type", "registration_date",
                                 "preferred_store_id", "is_active")
        la = cat.loyalty_accounts.select("customer_id", F.col("tier_code").alias("loyalty_tier"), "points_balance")
        days = days_between(as_of, "last_order_date")
        out = (c.join(la, "customer_id", "left").join(stats, "customer_id", "left")
               .withColumn("days_since_last_order", days))
        status = (F.when(F.col("last_order_date").isNull(), "Never Purchased")
                  .when(F.col("days_since_last_order") > 180, "Churn Risk")
                  .when(F.col("days_since_last_order") > 90, "At Risk")
                  .when(F.col("order_count") == 1, "One-Time")
                  .otherwise("Active"))
        return out.withColumn("lifecycle_status", status).select(
            "customer_id", "customer_number", "customer_type", "registration_date", "preferred_store_id",
            "is_active", "loyalty_tier", "points_balance", "order_count", "first_order_date", "last_order_date",
            "lifetime_net_sales", "lifetime_gross_profit", "lifetime_units", "avg_order_value",
            "days_since_last_order", "lifecycle_status")
    return cat.memo(f"m05@{cat.as_of}", build)


def rfm_segment(r="r_score", f="f_score", m="m_score"):
    r, f, m = F.col(r), F.col(f), F.col(m)
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal")
            .when((r >= 4) & (f <= 2), "Promising New")
            .when((r <= 2) & (f >= 3), "At Risk Loyal")
            .when((r <= 2) & (m <= 2), "Hibernating")
            .otherwise("Need Attention"))


def score_rfm(base: DataFrame, recency: str, frequency: str, monetary: str) -> DataFrame:
    """Three global NTILE(5) scores; ``customer_id`` breaks ties."""
    cid = F.col("customer_id")
    scored = with_ntile(base, [F.col(recency).desc_nulls_first(), cid.asc()], 5, "r_score")
    scored = with_ntile(scored, [F.col(frequency).asc_nulls_last(), cid.asc()], 5, "f_score")
    scored = with_ntile(scored, [F.col(monetary).asc_nulls_last(), cid.asc()], 5, "m_score")
    return scored


# M06
def customer_rfm(cat: Catalog) -> DataFrame:
    def build():
        base = customer_360(cat).where(F.col("order_count").isNotNull()).select(
            "customer_id", "last_order_date", "order_count", "lifetime_net_sales", "days_since_last_order")
        scored = score_rfm(base, "days_since_last_order", "order_count", "lifetime_net_sales")
        return scored.select(
            "customer_id", "last_order_date", "order_count", "lifetime_net_sales", "days_since_last_order",
            "r_score", "f_score", "m_score", (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total"),
            rfm_segment().alias("rfm_segment"))
    return cat.memo(f"m06@{cat.as_of}", build)


def stock_status(on_hand="quantity_on_hand", reorder="reorder_point", max_stock="max_stock"):
    q, r, m = F.col(on_hand), F.col(reorder), F.col(max_stock)
    return (F.when(q == 0, "Stockout")
            .when(r.isNotNull() & (q <= r), "Below Reorder")
            .when(m.isNotNull() & (q >= m), "Overstock")
            .otherwise("Healthy"))


# M07
def inventory_health(cat: Catalog) -> DataFrame:
    def build():
        i = cat.inventory
        p = cat.products.select("product_id", "current_unit_cost")
        pcm = product_category_map(cat).select("product_id", "sku", "product_name", "category_name")
        s = cat.stores.select("store_id", "store_name")
        dc = cat.distribution_centers.select("dc_id", "dc_name")
        return (i.join(p, "product_id").join(pcm, "product_id", "left")
                .join(s, "store_id", "left").join(dc, "dc_id", "left")
                .select("inventory_id", "product_id", "sku", "product_name", "category_name", "location_type",
                        "store_id", "store_name", "dc_id", "dc_name", "quantity_on_hand", "quantity_reserved",
                        "quantity_available", "reorder_point", "max_stock",
                        (F.col("quantity_on_hand") * F.col("current_unit_cost")).alias("inventory_value_cost"),
                        stock_status().alias("stock_status")))
    return cat.memo("m07", build)


# M08
def fact_return_line(cat: Catalog) -> DataFrame:
    def build():
        ri = cat.return_items
        r = cat.returns.select("return_id", "return_date", "order_id", "customer_id", "return_status")
        o = cat.orders.select("order_id", "order_date", "store_id", "channel_id")
        return (ri.join(r, "return_id").join(o, "order_id")
                .select("return_item_id", "return_id", "return_date", "order_id", "customer_id", "return_status",
                        "order_item_id", "product_id", "quantity_returned", "unit_refund_amount",
                        (F.col("quantity_returned") * F.col("unit_refund_amount")).alias("refund_line_amount"),
                        "restock_flag", "return_reason_code", "order_date", "store_id", "channel_id",
                        days_between("return_date", "order_date").alias("days_to_return")))
    return cat.memo("m08", build)


# M09
def supplier_performance(cat: Catalog) -> DataFrame:
    """Reference join semantics (D9): PO x items, receipts joined per PO and
    receipt items per (receipt, PO item).

    The joins carry keys and numbers only. Receipt items are summed per (receipt, PO item) first, with the number of
    their rows as the weight of the joined row; a PO is counted at one of its rows, told while they lie by PO;
    supplier attributes meet the sums.
    """
    def build():
        def first(*keys):  # by the sort that the joins need anyway
            return F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])) == 1
        by_po = "purchase_order_id"
        po = (cat.purchase_orders.select(by_po, "supplier_id", F.col("order_date").alias("po_date"))
              .repartition(by_po).withColumn("_po", first(by_po, "supplier_id")))
        s = cat.suppliers.select("supplier_id", "supplier_code", "supplier_name", "supplier_tier",
                                 F.col("lead_time_days_avg").alias("contracted_lead_time_days"), "reliability_score")
        poi = cat.purchase_order_items.select(by_po, "po_item_id", "quantity_ordered").withColumn("_poi", first(by_po))
        gr = cat.goods_receipts.select(by_po, "receipt_id", "receipt_date", "is_on_time").withColumn("_gr", first(by_po))
        gri = cat.goods_receipt_items.groupBy("receipt_id", "po_item_id").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("quantity_received").alias("_received"))
        j = (po.join(poi, by_po).join(gr, by_po, "left")
             .select("supplier_id", "receipt_id", "po_item_id", "quantity_ordered", "is_on_time",
                     days_between("receipt_date", "po_date").alias("_lead"),
                     (F.col("_po") & F.col("_poi") & F.coalesce("_gr", F.lit(True))).alias("_counts"))
             .join(gri, ["receipt_id", "po_item_id"], "left"))
        n = F.coalesce("_n", F.lit(1))
        sums = j.groupBy("supplier_id").agg(
            F.count(F.when(F.col("_counts"), 1)).alias("_pos"), F.sum(F.col("quantity_ordered") * n).alias("_ordered"),
            F.sum("_received").alias("_received"), F.sum(F.when(F.col("is_on_time"), n).otherwise(0)).alias("_on_time"),
            F.sum(n).alias("_rows"), F.sum(F.col("_lead") * n).alias("_lead"),
            F.sum(F.when(F.col("_lead").isNotNull(), n).otherwise(0)).alias("_led"))
        ordered = F.sum("_ordered")
        received = F.coalesce(F.sum("_received"), F.lit(0))
        return (sums.join(s, "supplier_id")
                .groupBy("supplier_id", "supplier_code", "supplier_name", "supplier_tier",
                         "contracted_lead_time_days", "reliability_score")
                # equal supplier rows are one group: their sums add up, their POs are the same
                .agg(F.max("_pos").alias("po_count"), ordered.alias("units_ordered"),
                     received.alias("units_received"),
                     F.when(ordered == 0, F.lit(None))
                     .otherwise(ratio(received, ordered, 4)).alias("fill_rate"),
                     # AVG(CASE WHEN on_time THEN 1.0 ELSE 0.0 END): NULL counts as 0
                     xdiv(F.sum("_on_time"), F.sum("_rows")).alias("on_time_rate"),
                     xdiv(F.sum("_lead"), F.sum("_led")).alias("avg_actual_lead_time_days")))
    return cat.memo("m09", build)


# M10
def campaign_performance(cat: Catalog) -> DataFrame:
    def build():
        spend = cat.marketing_campaigns.select(
            "campaign_id", "campaign_code", "campaign_name", "campaign_type", "start_date", "end_date",
            "budget_amount", "actual_spend", "objective_code", "status_code")
        rt = F.col("response_type")
        resp = cat.campaign_responses.groupBy("campaign_id").agg(
            F.count(F.when(rt == "Sent", 1)).alias("sent_count"),
            F.count(F.when(rt == "Open", 1)).alias("open_count"),
            F.count(F.when(rt == "Click", 1)).alias("click_count"),
            F.count(F.when(rt == "Convert", 1)).alias("convert_count"),
            F.coalesce(F.sum(F.when(rt == "Convert", F.col("attributed_revenue"))), F.lit(0)).alias("attributed_revenue"))
        # all statuses (D10); order grain first, so distinct orders = count
        o = cat.orders.where(F.col("campaign_id").isNotNull()).select("order_id", "campaign_id", "customer_id")
        attr = (order_totals(cat).join(o, "order_id").groupBy("campaign_id").agg(
            F.sum("net_sales").alias("order_net_sales"),
            (F.sum("net_sales") - F.sum("cogs_amount")).alias("order_gross_profit"),
            F.count(F.lit(1)).alias("attributed_orders"),
            F.countDistinct("customer_id").alias("attributed_customers")))
        j = spend.join(resp, "campaign_id", "left").join(attr, "campaign_id", "left")
        z = F.lit(0)
        sent = F.coalesce("sent_count", z)
        gp = F.coalesce("order_gross_profit", z)
        return j.select(
            "campaign_id", "campaign_code", "campaign_name", "campaign_type", "start_date", "end_date",
            "budget_amount", "actual_spend", "objective_code", "status_code",
            sent.alias("sent_count"), F.coalesce("open_count", z).alias("open_count"),
            F.coalesce("click_count", z).alias("click_count"), F.coalesce("convert_count", z).alias("convert_count"),
            F.coalesce("attributed_revenue", z).alias("response_attributed_revenue"),
            F.coalesce("order_net_sales", z).alias("order_net_sales"), gp.alias("order_gross_profit"),
            F.coalesce("attributed_orders", z).alias("attributed_orders"),
            F.coalesce("attributed_customers", z).alias("attributed_customers"),
            F.when(sent == 0, F.lit(None))
            .otherwise(ratio(F.coalesce("convert_count", z), "sent_count", 4))
            .alias("conversion_rate"),
            F.when(F.coalesce("actual_spend", z) == 0, F.lit(None))
            .otherwise(ratio(gp - F.col("actual_spend"), "actual_spend", 4)).alias("campaign_roi"))
    return cat.memo("m10", build)


def delay_flag(ship="ship_date", lead="fulfillment_lead_time_days", delivery="delivery_date", transit="transit_days"):
    return (F.when(F.col(ship).isNull(), "Not Shipped")
            .when(F.col(lead) > 5, "Delayed Ship")
            .when(F.col(delivery).isNotNull() & (F.col(transit) > 7), "Delayed Delivery")
            .otherwise("On Track"))


# M11
def shipment_performance(cat: Catalog) -> DataFrame:
    def build():
        sh = cat.shipments
        o = cat.orders.select("order_id", "order_date")
        dc = cat.distribution_centers.select("dc_id", "dc_code", "dc_name")
        j = (sh.join(o, "order_id").join(dc, "dc_id", "left")
             .withColumn("fulfillment_lead_time_days", days_between("ship_date", "order_date"))
             .withColumn("transit_days", days_between("delivery_date", "ship_date")))
        return j.select("shipment_id", "order_id", "order_date", "dc_id", "dc_code", "dc_name", "store_id",
                        "carrier_name", "shipment_status", "ship_date", "delivery_date", "fulfillment_lead_time_days",
                        "transit_days", delay_flag().alias("delay_flag"))
    return cat.memo("m11", build)


# M12
def executive_daily_kpis(cat: Catalog) -> DataFrame:
    def build():
        sales = sales_daily(cat).groupBy("order_date").agg(
            F.sum("net_sales").alias("net_sales"), F.sum("gross_profit").alias("gross_profit"),
            F.sum("order_count").alias("order_count"), F.sum("units_sold").alias("units_sold"))
        rets = fact_return_line(cat).groupBy(F.col("return_date").alias("order_date")).agg(
            F.sum("refund_line_amount").alias("refund_amount"), F.sum("quantity_returned").alias("units_returned"))
        stock = cat.inventory_snapshots.groupBy(F.col("snapshot_date").alias("order_date")).agg(
            F.count(F.when(F.col("quantity_on_hand") == 0, 1)).alias("stockout_positions"),
            F.count(F.lit(1)).alias("snapshot_positions"))
        j = sales.join(rets, "order_date", "left").join(stock, "order_date", "left")
        z = F.lit(0)
        return j.select(
            "order_date", "net_sales", "gross_profit",
            F.when(F.col("net_sales") == 0, F.lit(None)).otherwise(ratio("gross_profit", "net_sales", 4))
            .alias("margin_pct"),
            "order_count", "units_sold",
            F.when(F.col("order_count") == 0, F.lit(None)).otherwise(ratio("net_sales", "order_count", 2))
            .alias("aov"),
            F.coalesce("refund_amount", z).alias("refund_amount"), F.coalesce("units_returned", z).alias("units_returned"),
            F.coalesce("stockout_positions", z).alias("stockout_positions"),
            F.coalesce("snapshot_positions", z).alias("snapshot_positions"))
    return cat.memo("m12", build)


# M13
def payment_mix(cat: Catalog) -> DataFrame:
    def build():
        p = cat.payments.where(F.col("payment_status") == "Captured")
        pm = cat.payment_methods.select("payment_method_id", "method_code", "method_name", "method_group")
        return (p.join(B(pm), "payment_method_id")
                .groupBy("payment_method_id", "method_code", "method_name", "method_group",
                         month_start(F.to_date("payment_timestamp")).alias("payment_month"))
                .agg(F.count(F.lit(1)).alias("payment_count"), F.sum("payment_amount").alias("payment_amount")))
    return cat.memo("m13", build)


MARTS_BASIC = {
    "m01": product_category_map, "m02": fact_sales_line, "m03": sales_daily, "m04": sales_monthly,
    "m05": customer_360, "m06": customer_rfm, "m07": inventory_health, "m08": fact_return_line,
    "m09": supplier_performance, "m10": campaign_performance, "m11": shipment_performance,
    "m12": executive_daily_kpis, "m13": payment_mix,
}


def materialize(cat: Catalog, root: str, names=("m02", "m03", "m05")) -> dict[str, str]:
    """Write the named marts under ``root`` (shared storage) and make ``cat`` serve them from there."""
    from shelfwise.sources.mart_store import MartStore
    store = MartStore(cat.spark, root)
    written = store.save(cat, names)
    for name in names:
        cat._extras[store.marts[name].key(name, cat)] = store.frame(name)
    return written
