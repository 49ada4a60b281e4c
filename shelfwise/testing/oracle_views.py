"""DuckDB oracle text for the foundational views V01-V17 and the marts.

V01-V16 are generated relations: a base table, the columns shown and the tables its
rows refer to. M14 brings three feeds under one set of names before it fills them
in; M15 holds each table's measures against a list of checks.
"""

from __future__ import annotations

from shelfwise.testing.oracle_marts import SOLD
from shelfwise.testing.relations import relation
from shelfwise.testing.sqlhelp import R

ORDER = "orders.order_id=order_id!"

V: dict[str, str] = {
    "v01": relation("stores", "store_id store_code store_name store_format region_id r.region_code r.region_name city state_code selling_sq_ft "
                              "open_date close_date is_active", r="regions.region_id=region_id!"),
    "v02": relation("products", "product_id sku product_name brand_name category_id c.category_code c.category_name c.category_level "
                                "c.parent_category_id primary_supplier_id s.supplier_code s.supplier_name current_list_price current_unit_cost "
                                "popularity_score is_active launch_date discontinue_date",
                    c="product_categories.category_id=category_id!", s="suppliers.supplier_id=primary_supplier_id"),
    "v03": relation("customers", "customer_id customer_number customer_type registration_date acquisition_channel_id *acquisition_channel_name "
                                 "preferred_store_id is_active l.loyalty_account_id l.loyalty_number *loyalty_tier l.points_balance *loyalty_status",
                    c="channels.channel_id=acquisition_channel_id", l="loyalty_accounts.customer_id=customer_id",
                    computed={"acquisition_channel_name": "c.channel_name", "loyalty_tier": "l.tier_code", "loyalty_status": "l.status_code"}),
    "v04": relation("orders", "order_id order_number customer_id store_id channel_id c.channel_code c.channel_name order_date order_timestamp "
                              "order_status gross_amount discount_amount net_amount tax_amount shipping_amount total_amount employee_id campaign_id "
                              "d.year_number d.month_number d.quarter_number d.season_name",
                    c="channels.channel_id=channel_id!", d="calendar_date.full_date=order_date!"),
    "v05": relation("order_items", "order_item_id order_id o.order_number o.order_date o.customer_id o.store_id o.channel_id o.campaign_id line_number "
                                   "product_id quantity unit_price unit_cost discount_amount line_gross_amount line_net_amount line_cogs_amount "
                                   "*line_gross_profit promotion_id is_gift", o=ORDER,
                    computed={"line_gross_profit": "b.line_net_amount - b.line_cogs_amount"}),
    "v07": relation("payments", "payment_id order_id o.order_date o.customer_id o.store_id o.channel_id payment_method_id m.method_code m.method_name "
                                "payment_timestamp payment_amount payment_status", o=ORDER, m="payment_methods.payment_method_id=payment_method_id!"),
    "v08": relation("shipments", "shipment_id order_id o.order_date dc_id store_id carrier_name shipment_status ship_date delivery_date", o=ORDER,
                    computed={"fulfillment_lead_time_days": "b.ship_date - o.order_date"}),
    "v09": relation("returns", "return_id order_id customer_id return_date return_status refund_amount o.order_date", o=ORDER,
                    computed={"days_to_return": "b.return_date - o.order_date"}),
    "v10": relation("return_items", "return_item_id return_id r.return_date r.order_id r.customer_id order_item_id product_id quantity_returned "
                                    "unit_refund_amount *refund_line_amount restock_flag return_reason_code", r="returns.return_id=return_id!",
                    computed={"refund_line_amount": "b.quantity_returned * b.unit_refund_amount"}),
    "v11": relation("inventory", "inventory_id product_id location_type store_id dc_id quantity_on_hand quantity_reserved quantity_available "
                                 "reorder_point max_stock p.current_unit_cost *inventory_value_cost as_of_timestamp", p="products.product_id=product_id!",
                    computed={"inventory_value_cost": "b.quantity_on_hand * p.current_unit_cost"}),
    "v12": relation("inventory_snapshots", "snapshot_id snapshot_date product_id location_type store_id dc_id quantity_on_hand quantity_reserved "
                                           "quantity_available inventory_value_cost d.year_number d.month_number d.week_of_year",
                    d="calendar_date.full_date=snapshot_date!"),
    "v13": relation("purchase_order_items", "po_item_id purchase_order_id p.po_number p.supplier_id p.dc_id p.order_date p.expected_receipt_date "
                                            "p.po_status line_number product_id quantity_ordered unit_cost",
                    p="purchase_orders.purchase_order_id=purchase_order_id!", computed={"ordered_amount": "b.quantity_ordered * b.unit_cost"}),
    "v14": relation("goods_receipt_items", "receipt_item_id receipt_id g.purchase_order_id g.dc_id g.receipt_date g.is_on_time po_item_id product_id "
                                           "quantity_received", g="goods_receipts.receipt_id=receipt_id!"),
    "v15": relation("marketing_campaigns", "campaign_id campaign_code campaign_name campaign_type channel_id c.channel_name start_date end_date "
                                           "budget_amount actual_spend objective_code lift_factor status_code", c="channels.channel_id=channel_id"),
    "v16": relation("campaign_responses", "campaign_response_id campaign_id c.campaign_code customer_id response_timestamp response_type order_id "
                                          "attributed_revenue", c="marketing_campaigns.campaign_id=campaign_id!"),
    "v17": relation("calendar_date", "date_id full_date day_of_week day_name week_of_year month_number month_name quarter_number year_number "
                                     "fiscal_year fiscal_quarter is_weekend is_holiday holiday_name season_name"),
}
# by day, store and channel: sums over the lines of the sold orders, an order counted by its first line
V["v06"] = f"""
SELECT order_date, store_id, channel_id, count(*) FILTER (opens_order) AS order_count, count(*) AS line_count, sum(quantity) AS units_sold,
       sum(line_gross_amount) AS gross_sales, sum(discount_amount) AS discount_amount, sum(line_net_amount) AS net_sales,
       sum(line_cogs_amount) AS cogs_amount, sum(line_gross_profit) AS gross_profit
FROM line WHERE order_status IN {SOLD} GROUP BY ALL"""

# marts: the mart CTE itself; unrounded quotients are compared at 6 places
MARTS = {"m01": "product_category_map", "m02": "fact_sales_line", "m03": "sales_daily", "m04": "sales_monthly", "m05": "customer_360",
         "m06": "customer_rfm", "m07": "inventory_health", "m08": "fact_return_line", "m09": "supplier_performance",
         "m10": "campaign_performance", "m11": "shipment_performance", "m12": "executive_daily_kpis", "m13": "payment_mix"}
SIX_PLACES = {"m05": ["avg_order_value"], "m09": ["on_time_rate", "avg_actual_lead_time_days"]}
for _m, _name in MARTS.items():
    _rounded = ", ".join(f"round({c}, 6) AS {c}" for c in SIX_PLACES.get(_m, []))
    V[_m] = f"SELECT *{f' REPLACE ({_rounded})' if _rounded else ''} FROM vw_{_name}"

V["m14"] = """
SELECT coalesce(nullif(trim(called), ''), nullif(trim(horizon), ''), stand_in) AS model_name, entity_type,
       coalesce(CAST(id AS VARCHAR), strftime(day, '%Y-%m-%d')) AS entity_id, CAST(customer_id AS VARCHAR) AS customer_id,
       coalesce(probability, CAST(impact AS DOUBLE)) AS score, if(entity_type = 'customer', probability, NULL) AS churn_probability,
       coalesce(list_extract(labels, CAST(2 - flag AS BIGINT)), only_label) AS label, coalesce(day, CAST(loaded_at AS DATE)) AS prediction_date,
       CAST(loaded_at AS DATE) AS as_of_date, CAST(NULL AS DOUBLE) AS confidence,
       coalesce(nullif(trim(called), ''), stand_in) AS model_version, 'stg_' || feed || '_predictions' AS prediction_source, title,
       horizon AS explanation, CAST(impact AS DECIMAL(38,10)) AS estimated_impact
FROM (
  SELECT 'churn' AS feed, customer_id AS id, customer_id, churn_probability AS probability, churn_predicted AS flag, model_name AS called, loaded_at
  FROM stg_churn WHERE customer_id IS NOT NULL
  UNION ALL BY NAME
  SELECT 'profit' AS feed, order_id AS id, customer_id, profit_probability AS probability, profit_predicted AS flag, model_name AS called,
         order_date AS day, net_sales AS impact, loaded_at
  FROM stg_profit WHERE order_id IS NOT NULL
  UNION ALL BY NAME
  SELECT 'sales_forecast' AS feed, ds AS day, coalesce(yhat, ml_xgboost, sarimax, seasonal_naive) AS impact, model_used AS called,
         forecast_horizon AS horizon, loaded_at
  FROM stg_forecast WHERE ds IS NOT NULL)
JOIN (VALUES ('churn', 'customer', 'churn_model', ['churn', 'retain'], NULL, NULL),
             ('profit', 'order', 'profit_model', ['profitable', 'unprofitable'], NULL, NULL),
             ('sales_forecast', 'forecast', 'sales_forecast', [], 'sales_forecast', 'Sales forecast'))
  kinds(feed, entity_type, stand_in, labels, only_label, title) USING (feed)"""

D6 = "DECIMAL(38,6)"
# table, key, what a row must have, date of its last change
PROFILED = [("customers", "customer_id", "nullif(trim(email_hash), '') IS NOT NULL", "updated_at"),
            ("orders", "order_id", "customer_id IS NOT NULL AND channel_id IS NOT NULL", "updated_at"),
            ("order_items", "order_item_id", "order_id IS NOT NULL AND product_id IS NOT NULL",
             "(SELECT updated_at FROM oltp_orders o WHERE o.order_id = t.order_id)"),
            ("products", "product_id", "nullif(trim(sku), '') IS NOT NULL", "updated_at"),
            ("inventory", None, "product_id IS NOT NULL", "as_of_timestamp")]
# check, measure that scores it, limits of critical and of high, message and its value, description
CHECKS = [("completeness", "completeness", 0.7, 0.9, "Missing critical fields pct=", "missing_value_pct", "Share of rows with required fields populated"),
          ("duplicates", "consistency", 0.7, 0.9, "Duplicate key pct=", "duplicate_pct", "Primary-key uniqueness pressure (approx)"),
          ("freshness", "freshness", 0.5, 0.8, "Last updated=", "last_updated", "Recency of source table updates (30-day decay)"),
          ("validity", "validity", 0.7, 0.9, "Invalid/missing critical=", "missing_value_pct", "Validity derived from required-field population"),
          ("table_score", "score", 0.7, 0.9, "Composite DQ score=", "score", "Mean of available completeness/validity/consistency/freshness")]


def _share(part: str, whole: str = "n") -> str:
    return f"CAST({R(part, whole, 6)} AS {D6})"


def _quality() -> str:
    counted = "\nUNION ALL\n".join(
        f"SELECT 'oltp.{t}' AS entity_name, count(*) AS n, count(*) FILTER ({filled}) AS filled, "
        f"{f'count(DISTINCT {key})' if key else 'count(*)'} AS keys, max({changed}) AS last_updated FROM oltp_{t} t"
        for t, key, filled, changed in PROFILED)
    checks = ", ".join(f"('{c}', '{m}', {lo}, {hi}, '{text}', '{told}', '{about}')" for c, m, lo, hi, text, told, about in CHECKS)
    age = "(epoch(CAST((SELECT as_of FROM params) AS TIMESTAMP)) - epoch(last_updated))"
    grade = "coalesce(list_extract(['critical', 'high', 'info'], 1 + CAST({0} >= {1} AS INTEGER) + CAST({0} >= {2} AS INTEGER)), 'unknown')"
    told = "missing_value_pct, duplicate_pct, freshness, validity, consistency, completeness"
    return f"""
WITH counted AS ({counted}),
measured AS (
  SELECT entity_name, n, last_updated, {_share('filled')} AS completeness, {_share('filled')} AS validity, {_share('keys')} AS consistency,
         {_share('n - filled')} AS missing_value_pct, {_share('n - keys')} AS duplicate_pct,
         CAST(greatest(0, {R(f'2592000 - {age}', '2592000', 6)}) AS {D6}) AS freshness
  FROM counted),
long AS (FROM (UNPIVOT measured ON completeness, validity, consistency, freshness INTO NAME measure VALUE value)),
scored AS (
  SELECT m.*, CAST(s.score AS {D6}) AS score
  FROM measured m JOIN (SELECT entity_name, {R('sum(value)', 'count(*)', 6)} AS score FROM long GROUP BY entity_name) s USING (entity_name)),
total AS (SELECT CAST({R('sum(score)', 'count(score)', 6)} AS {D6}) AS overall_score FROM scored),
checks(check_name, measure, lo, hi, text, told, description) AS (VALUES {checks}),
rows AS (
  SELECT check_name, entity_name, 'table' AS namespace, description, {told}, n AS invalid_records, lo, hi, text,
         CASE measure WHEN 'completeness' THEN completeness WHEN 'consistency' THEN consistency WHEN 'freshness' THEN freshness
                      WHEN 'validity' THEN validity ELSE scored.score END AS score,
         CASE told WHEN 'missing_value_pct' THEN CAST(missing_value_pct AS VARCHAR) WHEN 'duplicate_pct' THEN CAST(duplicate_pct AS VARCHAR)
                   WHEN 'last_updated' THEN CAST(last_updated AS VARCHAR) ELSE CAST(scored.score AS VARCHAR) END AS said
  FROM scored, checks
  UNION ALL BY NAME
  SELECT 'overall_score' AS check_name, 'analytics.platform' AS entity_name, 'overall' AS namespace,
         'Average of per-table composite scores (NULL when no oltp rows)' AS description, 0.7 AS lo, 0.9 AS hi,
         'Platform overall DQ score=' AS text, overall_score AS score, CAST(overall_score AS VARCHAR) AS said
  FROM total)
SELECT as_of AS check_date, as_of AS as_of_date, check_name, entity_name, namespace, score, {grade.format('score', 'lo', 'hi')} AS severity,
       text || coalesce(said, 'n/a') AS message, description, overall_score, overall_score AS dq_score, overall_score AS quality_score,
       'Data Platform' AS owner, {told}, invalid_records
FROM rows, total, params"""


V["m15"] = _quality()
