"""Foundational views V01-V17 (L1): joins and derived columns over the catalog.

Small fixed dimensions (regions, channels, payment methods, calendar) are
broadcast explicitly; their row counts are bounded by definition. Joins
between fact-sized tables are left to the planner (sort-merge or AQE's
runtime broadcast once a side is measured small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expr import days_between, is_sold
from shelfwise.sources.catalog import Catalog

B = F.broadcast


def dim_store_base(cat: Catalog) -> DataFrame:  # V01
    s, r = cat.stores, cat.regions
    return s.join(B(r.select("region_id", "region_code", "region_name")), "region_id").select(
        "store_id", "store_code", "store_name", "store_format", "region_id", "region_code", "region_name",
        "city", "state_code", "selling_sq_ft", "open_date", "close_date", "is_active")


def dim_product_base(cat: Catalog) -> DataFrame:  # V02
    p = cat.products
    c = cat.product_categories.select("category_id", "category_code", "category_name", "category_level",
                                      "parent_category_id")
    s = cat.suppliers.select(F.col("supplier_id").alias("primary_supplier_id"), "supplier_code", "supplier_name")
    return (p.join(c, "category_id").join(s, "primary_supplier_id", "left")
            .select("product_id", "sku", "product_name", "brand_name", "category_id", "category_code",
                    "category_name", "category_level", "parent_category_id", "primary_supplier_id",
                    "supplier_code", "supplier_name", "current_list_price", "current_unit_cost", "popularity_score", "is_active",
                    "launch_date", "discontinue_date"))


def dim_customer_base(cat: Catalog) -> DataFrame:  # V03
    cu = cat.customers
    ch = cat.channels.select(F.col("channel_id").alias("acquisition_channel_id"),
                             F.col("channel_name").alias("acquisition_channel_name"))
    la = cat.loyalty_accounts.select("customer_id", "loyalty_account_id", "loyalty_number",
                                     F.col("tier_code").alias("loyalty_tier"), "points_balance",
                                     F.col("status_code").alias("loyalty_status"))
    return (cu.join(B(ch), "acquisition_channel_id", "left").join(la, "customer_id", "left")
            .select("customer_id", "customer_number", "customer_type", "registration_date",
                    "acquisition_channel_id", "acquisition_channel_name", "preferred_store_id", "is_active",
                    "loyalty_account_id", "loyalty_number", "loyalty_tier", "points_balance", "loyalty_status"))


def order_header(cat: Catalog) -> DataFrame:  # V04
    o = cat.orders
    ch = cat.channels.select("channel_id", "channel_code", "channel_name")
    d = cat.calendar_date.select(F.col("full_date").alias("order_date"), "year_number", "month_number",
                                 "quarter_number", "season_name")
    return (o.join(B(ch), "channel_id").join(B(d), "order_date")
            .select("order_id", "order_number", "customer_id", "store_id", "channel_id", "channel_code",
                    "channel_name", "order_date", "order_timestamp", "order_status", "gross_amount",
                    "discount_amount", "net_amount", "tax_amount", "shipping_amount", "total_amount",
                    "employee_id", "campaign_id", "year_number", "month_number", "quarter_number", "season_name"))


def order_lines(cat: Catalog) -> DataFrame:  # V05 (all statuses)
    oi = cat.order_items
    o = cat.orders.select("order_id", "order_number", "order_date", "customer_id", "store_id", "channel_id",
                          "campaign_id")
    return oi.join(o, "order_id").select(
        "order_item_id", "order_id", "order_number", "order_date", "customer_id", "store_id", "channel_id",
        "campaign_id", "line_number", "product_id", "quantity", "unit_price", "unit_cost", "discount_amount",
        "line_gross_amount", "line_net_amount", "line_cogs_amount",
        (F.col("line_net_amount") - F.col("line_cogs_amount")).alias("line_gross_profit"),
        "promotion_id", "is_gift")


def sales_daily_base(cat: Catalog) -> DataFrame:  # V06
    o = cat.orders.where(is_sold()).select("order_id", "order_date", "store_id", "channel_id")
    oi = cat.order_items
    # per-order partial sums first: the join and the distinct order count both
    # then work on order grain (H2) and reuse the order_id partitioning
    per_order = oi.groupBy("order_id").agg(
        F.count("order_item_id").alias("line_count"), F.sum("quantity").alias("units_sold"),
        F.sum("line_gross_amount").alias("gross_sales"), F.sum("discount_amount").alias("discount_amount"),
        F.sum("line_net_amount").alias("net_sales"), F.sum("line_cogs_amount").alias("cogs_amount"))
    return (per_order.join(o, "order_id")
            .groupBy("order_date", "store_id", "channel_id")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("line_count").alias("line_count"),
                 F.sum("units_sold").alias("units_sold"), F.sum("gross_sales").alias("gross_sales"),
                 F.sum("discount_amount").alias("discount_amount"), F.sum("net_sales").alias("net_sales"),
                 F.sum("cogs_amount").alias("cogs_amount"),
                 (F.sum("net_sales") - F.sum("cogs_amount")).alias("gross_profit")))


def payments_base(cat: Catalog) -> DataFrame:  # V07
    p = cat.payments
    o = cat.orders.select("order_id", "order_date", "customer_id", "store_id", "channel_id")
    pm = cat.payment_methods.select("payment_method_id", "method_code", "method_name")
    return p.join(o, "order_id").join(B(pm), "payment_method_id").select(
        "payment_id", "order_id", "order_date", "customer_id", "store_id", "channel_id", "payment_method_id",
        "method_code", "method_name", "payment_timestamp", "payment_amount", "payment_status")


def shipments_base(cat: Catalog) -> DataFrame:  # V08
    s = cat.shipments
    o = cat.orders.select("order_id", "order_date")
    return s.join(o, "order_id").select(
        "shipment_id", "order_id", "order_date", "dc_id", "store_id", "carrier_name", "shipment_status",
        "ship_date", "delivery_date", days_between("ship_date", "order_date").alias("fulfillment_lead_time_days"))


def returns_base(cat: Catalog) -> DataFrame:  # V09
    r = cat.returns
    o = cat.orders.select("order_id", "order_date")
    return r.join(o, "order_id").select(
        "return_id", "order_id", "customer_id", "return_date", "return_status", "refund_amount", "order_date",
        days_between("return_date", "order_date").alias("days_to_return"))


def return_lines(cat: Catalog) -> DataFrame:  # V10
    ri = cat.return_items
    r = cat.returns.select("return_id", "return_date", "order_id", "customer_id")
    return ri.join(r, "return_id").select(
        "return_item_id", "return_id", "return_date", "order_id", "customer_id", "order_item_id", "product_id",
        "quantity_returned", "unit_refund_amount",
        (F.col("quantity_returned") * F.col("unit_refund_amount")).alias("refund_line_amount"),
        "restock_flag", "return_reason_code")


def inventory_current(cat: Catalog) -> DataFrame:  # V11
    i = cat.inventory
    p = cat.products.select("product_id", "current_unit_cost")
    return i.join(p, "product_id").select(
        "inventory_id", "product_id", "location_type", "store_id", "dc_id", "quantity_on_hand",
        "quantity_reserved", "quantity_available", "reorder_point", "max_stock", "current_unit_cost",
        (F.col("quantity_on_hand") * F.col("current_unit_cost")).alias("inventory_value_cost"), "as_of_timestamp")


def inventory_snapshots_base(cat: Catalog) -> DataFrame:  # V12
    s = cat.inventory_snapshots
    d = cat.calendar_date.select(F.col("full_date").alias("snapshot_date"), "year_number", "month_number",
                                 "week_of_year")
    return s.join(B(d), "snapshot_date").select(
        "snapshot_id", "snapshot_date", "product_id", "location_type", "store_id", "dc_id", "quantity_on_hand",
        "quantity_reserved", "quantity_available", "inventory_value_cost", "year_number", "month_number",
        "week_of_year")


def purchase_order_lines(cat: Catalog) -> DataFrame:  # V13
    poi = cat.purchase_order_items
    po = cat.purchase_orders.select("purchase_order_id", "po_number", "supplier_id", "dc_id", "order_date",
                                    "expected_receipt_date", "po_status")
    return poi.join(po, "purchase_order_id").select(
        "po_item_id", "purchase_order_id", "po_number", "supplier_id", "dc_id", "order_date",
        "expected_receipt_date", "po_status", "line_number", "product_id", "quantity_ordered", "unit_cost",
        (F.col("quantity_ordered") * F.col("unit_cost")).alias("ordered_amount"))


def receipt_lines(cat: Catalog) -> DataFrame:  # V14
    gri = cat.goods_receipt_items
    gr = cat.goods_receipts.select("receipt_id", "purchase_order_id", "dc_id", "receipt_date", "is_on_time")
    return gri.join(gr, "receipt_id").select(
        "receipt_item_id", "receipt_id", "purchase_order_id", "dc_id", "receipt_date", "is_on_time",
        "po_item_id", "product_id", "quantity_received")


def campaigns_base(cat: Catalog) -> DataFrame:  # V15
    c = cat.marketing_campaigns
    ch = cat.channels.select("channel_id", "channel_name")
    return c.join(B(ch), "channel_id", "left").select(
        "campaign_id", "campaign_code", "campaign_name", "campaign_type", "channel_id", "channel_name",
        "start_date", "end_date", "budget_amount", "actual_spend", "objective_code", "lift_factor", "status_code")


def campaign_responses_base(cat: Catalog) -> DataFrame:  # V16
    cr = cat.campaign_responses
    c = cat.marketing_campaigns.select("campaign_id", "campaign_code")
    return cr.join(c, "campaign_id").select(
        "campaign_response_id", "campaign_id", "campaign_code", "customer_id", "response_timestamp",
        "response_type", "order_id", "attributed_revenue")


def calendar_view(cat: Catalog) -> DataFrame:  # V17
    return cat.calendar_date.select(
        "date_id", "full_date", "day_of_week", "day_name", "week_of_year", "month_number", "month_name",
        "quarter_number", "year_number", "fiscal_year", "fiscal_quarter", "is_weekend", "is_holiday",
        "holiday_name", "season_name")


VIEWS = {
    "v01": dim_store_base, "v02": dim_product_base, "v03": dim_customer_base, "v04": order_header,
    "v05": order_lines, "v06": sales_daily_base, "v07": payments_base, "v08": shipments_base,
    "v09": returns_base, "v10": return_lines, "v11": inventory_current, "v12": inventory_snapshots_base,
    "v13": purchase_order_lines, "v14": receipt_lines, "v15": campaigns_base, "v16": campaign_responses_base,
    "v17": calendar_view,
}
