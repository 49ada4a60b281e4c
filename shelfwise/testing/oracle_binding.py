"""DuckDB text of the TPC-H -> retail binding (oracle side).

Each retail table is a CTE named ``oltp_<table>`` over the driver's views
(``region nation customer supplier part orders lineitem events``). The rules
mirror ``shelfwise.sources.tpch_binding`` one for one. Exact half-up division
of positive money by an integer is written with integer arithmetic, because
DuckDB turns DECIMAL division into DOUBLE.
"""

from __future__ import annotations


def _exact_div2(x: str, q: str) -> str:
    """round(x / q, 2) half-up, exact, for positive DECIMAL(…,2) x and integer q > 0."""
    return (f"CAST(CAST((CAST({x} * 100 AS BIGINT) * 2 + {q}) // (2 * {q}) AS DECIMAL(18,0)) * 0.01 "
            f"AS DECIMAL(18,2))")


def _pick(key: str, labels: list[str]) -> str:
    n = len(labels)
    whens = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(labels))
    return f"(CASE ({key}) % {n} {whens} END)"


CARRIERS = ["UPS", "FedEx", "USPS", "DHL"]
RETURN_REASONS = ["SIZE", "DEFECT", "CHANGED_MIND", "LATE", "WRONG_ITEM", "OTHER"]
CAMPAIGN_TYPES = ["Email", "SMS", "Social", "Display", "InStore", "Promo"]
OBJECTIVES = ["AWARENESS", "ACQUISITION", "RETENTION"]

BINDING_CTES = f"""
oltp_regions AS (
  SELECT r_regionkey AS region_id, substring(r_name, 1, 3) AS region_code, r_name AS region_name,
         'US' AS country_code, TRUE AS is_active
  FROM region),
oltp_channels AS (
  SELECT * FROM (VALUES
    (1, 'URGENT', 'Store Express', 'Physical', TRUE),
    (2, 'HIGH', 'Store Standard', 'Physical', TRUE),
    (3, 'MEDIUM', 'Web', 'Digital', TRUE),
    (4, 'NOT SPECIFIED', 'Mobile App', 'Digital', TRUE),
    (5, 'LOW', 'Marketplace', 'Digital', TRUE))
    AS t(channel_id, channel_code, channel_name, channel_group, is_active)),
oltp_payment_methods AS (
  SELECT * FROM (VALUES
    (1, 'CARD', 'Credit Card', 'Card', TRUE),
    (2, 'DEBIT', 'Debit Card', 'Card', TRUE),
    (3, 'CASH', 'Cash', 'Cash', TRUE),
    (4, 'WALLET', 'Mobile Wallet', 'Digital', TRUE),
    (5, 'GIFT', 'Gift Card', 'Stored Value', TRUE),
    (6, 'BNPL', 'Buy Now Pay Later', 'Credit', TRUE))
    AS t(payment_method_id, method_code, method_name, method_group, is_active)),
oltp_stores AS (
  SELECT n_nationkey AS store_id, n_name AS store_code, n_name || ' Store' AS store_name,
         n_regionkey AS region_id,
         CASE n_nationkey % 3 WHEN 0 THEN 'Flagship' WHEN 1 THEN 'Standard' ELSE 'Outlet' END AS store_format,
         n_name AS city, 'S' || lpad(CAST(n_nationkey AS VARCHAR), CAST(greatest(length(CAST(n_nationkey AS VARCHAR)), 2) AS INTEGER), '0') AS state_code,
         5000 + n_nationkey * 1000 AS selling_sq_ft,
         CAST(DATE '1995-01-01' + to_months(n_nationkey * 4) AS DATE) AS open_date,
         CASE WHEN n_nationkey % 7 = 6 THEN CAST(DATE '1995-01-01' + to_months(n_nationkey * 4 + 12) AS DATE) END
           AS close_date,
         n_nationkey % 7 <> 6 AS is_active
  FROM nation),
oltp_distribution_centers AS (
  SELECT n_nationkey AS dc_id, 'DC' || lpad(CAST(n_nationkey AS VARCHAR), CAST(greatest(length(CAST(n_nationkey AS VARCHAR)), 2) AS INTEGER), '0') AS dc_code,
         'DC ' || n_name AS dc_name, n_regionkey AS region_id, n_name AS city,
         'S' || lpad(CAST(n_nationkey AS VARCHAR), CAST(greatest(length(CAST(n_nationkey AS VARCHAR)), 2) AS INTEGER), '0') AS state_code, 100000 AS capacity_units,
         TRUE AS is_active
  FROM nation),
oltp_calendar_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, d AS full_date,
         CAST(isodow(d) AS SMALLINT) AS day_of_week, dayname(d) AS day_name,
         CAST(weekofyear(d) AS SMALLINT) AS week_of_year, CAST(month(d) AS SMALLINT) AS month_number,
         monthname(d) AS month_name, CAST(quarter(d) AS SMALLINT) AS quarter_number,
         CAST(year(d) AS INTEGER) AS year_number, CAST(year(d) AS INTEGER) AS fiscal_year,
         CAST(quarter(d) AS SMALLINT) AS fiscal_quarter, isodow(d) >= 6 AS is_weekend,
         hol IS NOT NULL AS is_holiday, hol AS holiday_name,
         CASE WHEN month(d) >= 11 OR (month(d) = 1 AND day(d) <= 15) THEN 'Holiday'
              WHEN month(d) IN (2, 3) THEN 'WinterClearance'
              WHEN month(d) IN (4, 5) THEN 'Spring'
              WHEN month(d) IN (6, 7, 8) THEN 'Summer'
              WHEN month(d) IN (9, 10) THEN 'BackToSchool'
              ELSE 'Regular' END AS season_name
  FROM (SELECT d,
          CASE WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving'
               WHEN month(d) = 1 AND day(d) = 1 THEN 'New Year''s Day'
               WHEN month(d) = 7 AND day(d) = 4 THEN 'Independence Day'
               WHEN month(d) = 11 AND day(d) = 11 THEN 'Veterans Day'
               WHEN month(d) = 12 AND day(d) = 25 THEN 'Christmas Day' END AS hol
        FROM (SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS d
              FROM (SELECT least(DATE '1994-12-01', coalesce(min(CAST(o_orderdate AS DATE)), DATE '1994-12-01')) AS first_day,
                           greatest(DATE '2002-12-31', coalesce(max(CAST(o_orderdate AS DATE) + CAST(greatest(3 + o_orderkey % 25,
                             o_orderkey % 9 + o_orderkey % 11) AS INTEGER)), DATE '2002-12-31')) AS last_day
                    FROM orders)))),
cat_l1 AS (
  SELECT p_type AS l1_code, CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS l1_id
  FROM (SELECT DISTINCT p_type FROM part)),
oltp_product_categories AS (
  SELECT l1_id AS category_id, l1_code AS category_code, l1_code AS category_name,
         CAST(NULL AS INTEGER) AS parent_category_id, CAST(1 AS SMALLINT) AS category_level, TRUE AS is_active
  FROM cat_l1
  UNION ALL
  SELECT l1_id * 1000 + CAST(split_part(p_brand, '#', 2) AS INTEGER), concat_ws('-', p_type, p_brand),
         concat_ws(' ', p_type, p_brand), l1_id, CAST(2 AS SMALLINT), TRUE
  FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN cat_l1 ON p_type = l1_code),
oltp_products AS (
  SELECT p_partkey AS product_id, 'SKU-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(length(CAST(p_partkey AS VARCHAR)), 8) AS INTEGER), '0') AS sku,
         p_name AS product_name, p_brand AS brand_name,
         CASE WHEN p_partkey % 50 = 7 THEN l1_id
              ELSE l1_id * 1000 + CAST(split_part(p_brand, '#', 2) AS INTEGER) END AS category_id,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 10 AS INTEGER) END AS primary_supplier_id,
         'EA' AS unit_of_measure,
         CAST(p_retailprice AS DECIMAL(18,2)) AS current_list_price,
         CAST(round(CAST(p_retailprice AS DECIMAL(18,2))
                    * CAST('0.' || CAST(50 + p_partkey % 20 AS VARCHAR) AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))
           AS current_unit_cost,
         CAST(1 + (p_partkey % 100) * 0.01 AS DECIMAL(12,8)) AS popularity_score, p_partkey % 12 <> 0 AS is_active,
         DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS launch_date,
         CASE WHEN p_partkey % 12 = 0 THEN DATE '1994-01-01' + CAST(p_partkey % 365 + 2000 AS INTEGER) END AS discontinue_date,
         TIMESTAMP '2001-06-01 00:00:00' AS updated_at
  FROM part JOIN cat_l1 ON p_type = l1_code),
oltp_suppliers AS (
  SELECT CAST(s_suppkey AS INTEGER) AS supplier_id, 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(length(CAST(s_suppkey AS VARCHAR)), 5) AS INTEGER), '0') AS supplier_code,
         s_name AS supplier_name, {_pick('s_suppkey', ['Strategic', 'Preferred', 'Standard'])} AS supplier_tier,
         'US' AS country_code, 30 AS payment_terms_days, CAST(5 + s_suppkey % 10 AS INTEGER) AS lead_time_days_avg,
         CAST('0.' || CAST(50 + s_suppkey % 50 AS VARCHAR) AS DECIMAL(5,4)) AS reliability_score, TRUE AS is_active
  FROM supplier),
oltp_customers_all AS (
  SELECT c_custkey AS customer_id, 'C' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 9) AS INTEGER), '0') AS customer_number,
         CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Loyalty'
              WHEN c_mktsegment = 'MACHINERY' THEN 'Corporate' ELSE 'Guest' END AS customer_type,
         c_name AS first_name,
         CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE sha256(c_name) END AS email_hash,
         DATE '1995-01-01' - CAST(c_custkey % 365 AS INTEGER) AS registration_date,
         CAST(c_custkey % 5 + 1 AS INTEGER) AS acquisition_channel_id,
         CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(c_custkey % 25 AS INTEGER) END AS preferred_store_id,
         c_acctbal >= 0 AS is_active, c_acctbal AS acctbal,
         CAST(DATE '2001-08-01' - CAST(c_custkey % 40 AS INTEGER) AS TIMESTAMP) AS updated_at
  FROM customer),
oltp_customers AS (SELECT * EXCLUDE (acctbal) FROM oltp_customers_all),
oltp_loyalty_accounts AS (
  SELECT customer_id AS loyalty_account_id, customer_id, 'L' || CAST(customer_id AS VARCHAR) AS loyalty_number,
         CASE WHEN acctbal < 2500 THEN 'Bronze' WHEN acctbal < 5000 THEN 'Silver'
              WHEN acctbal < 7500 THEN 'Gold' ELSE 'Platinum' END AS tier_code,
         registration_date AS enroll_date, CAST(greatest(floor(acctbal), 0) AS INTEGER) AS points_balance,
         'Active' AS status_code
  FROM oltp_customers_all WHERE customer_type = 'Loyalty'),
oltp_orders AS (
  SELECT o_orderkey AS order_id, 'SO-' || CAST(o_orderkey AS VARCHAR) AS order_number,
         o_custkey AS customer_id,
         CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INTEGER) <= 2 AND o_custkey % 41 <> 0
              THEN CAST(o_custkey % 25 AS INTEGER) END AS store_id,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS channel_id,
         CAST(o_orderdate AS DATE) AS order_date, o_orderdate AS order_timestamp,
         CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderkey % 7 = 0 THEN 'Returned' ELSE 'Completed' END)
              WHEN o_orderstatus = 'P' THEN 'PartiallyReturned'
              ELSE (CASE WHEN o_orderkey % 10 = 0 THEN 'Cancelled' ELSE 'Pending' END) END AS order_status,
         'USD' AS currency_code,
         CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount, CAST(0 AS DECIMAL(18,2)) AS discount_amount,
         CAST(0 AS DECIMAL(18,2)) AS tax_amount, CAST(0 AS DECIMAL(18,2)) AS shipping_amount,
         CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CAST(NULL AS INTEGER) AS employee_id,
         CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_orderkey // 5) % 100 AS INTEGER) END AS campaign_id,
         o_orderdate AS updated_at
  FROM orders),
oltp_lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_shipdate,
         l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS order_item_id,
         quantity, gross AS line_gross_amount, discount_amount, net AS line_net_amount, cogs AS line_cogs_amount,
         {_exact_div2('gross', 'quantity')} AS unit_price,
         {_exact_div2('cogs', 'quantity')} AS unit_cost,
         {_exact_div2('net', 'quantity')} AS unit_net,
         CASE WHEN l_discount = 0 THEN NULL ELSE CAST(disc * 100 AS INTEGER) END AS promotion_id
  FROM (SELECT *, CAST(gross - discount_amount AS DECIMAL(18,2)) AS net
        FROM (SELECT *, CAST(round(gross * disc, 2) AS DECIMAL(18,2)) AS discount_amount,
                     CAST(round(gross * CAST('0.' || CAST(50 + l_partkey % 20 AS VARCHAR) AS DECIMAL(4,2)), 2)
                          AS DECIMAL(18,2)) AS cogs
              FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
                           CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_quantity AS INTEGER) AS quantity
                    FROM lineitem)))),
oltp_order_items AS (
  SELECT order_item_id, l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
         quantity, unit_price, unit_cost, discount_amount, line_gross_amount, line_net_amount,
         line_cogs_amount, promotion_id, FALSE AS is_gift
  FROM oltp_lines),
oltp_payments AS (
  SELECT o_orderkey AS payment_id, o_orderkey AS order_id, CAST(o_orderkey % 6 + 1 AS INTEGER) AS payment_method_id,
         o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS payment_timestamp,
         CAST(o_totalprice AS DECIMAL(18,2)) AS payment_amount, 'A' || CAST(o_orderkey AS VARCHAR) AS authorization_code,
         CASE WHEN o_orderkey % 17 = 0 THEN 'Failed' ELSE 'Captured' END AS payment_status
  FROM orders),
ship_dates AS (
  SELECT order_id, order_date, order_timestamp,
         CASE WHEN order_id % 31 = 0 THEN NULL ELSE order_date + CAST(order_id % 9 AS INTEGER) END AS ship_date
  FROM oltp_orders WHERE channel_id >= 3),
oltp_shipments AS (
  SELECT order_id AS shipment_id, order_id,
         CASE WHEN order_id % 29 = 0 THEN NULL ELSE CAST(order_id % 25 AS INTEGER) END AS dc_id,
         CAST(NULL AS INTEGER) AS store_id, {_pick('order_id', CARRIERS)} AS carrier_name,
         'TRK' || CAST(order_id AS VARCHAR) AS tracking_number,
         CASE WHEN ship_date IS NULL THEN 'Pending' WHEN delivery_date IS NULL THEN 'InTransit'
              ELSE 'Delivered' END AS shipment_status,
         ship_date, delivery_date, order_timestamp AS created_at
  FROM (SELECT *, CASE WHEN ship_date IS NULL OR order_id % 37 = 0 THEN NULL
                       ELSE ship_date + CAST(order_id % 11 AS INTEGER) END AS delivery_date
        FROM ship_dates)),
oltp_return_items AS (
  SELECT order_item_id AS return_item_id, l_orderkey AS return_id, order_item_id, l_partkey AS product_id,
         CAST(1 + (quantity - 1) % 3 AS INTEGER) AS quantity_returned, unit_net AS unit_refund_amount,
         l_partkey % 3 <> 0 AS restock_flag, {_pick('l_partkey', RETURN_REASONS)} AS return_reason_code
  FROM oltp_lines WHERE l_returnflag = 'R'),
oltp_returns AS (
  SELECT ri.return_id, o.order_id, o.customer_id,
         o.order_date + CAST(3 + o.order_id % 25 AS INTEGER) AS return_date, 'Completed' AS return_status,
         ri.refund_amount, o.order_timestamp AS created_at
  FROM (SELECT return_id, CAST(sum(quantity_returned * unit_refund_amount) AS DECIMAL(18,2)) AS refund_amount
        FROM oltp_return_items GROUP BY return_id) ri
  JOIN oltp_orders o ON ri.return_id = o.order_id),
inv_positions AS (
  SELECT l_partkey, s_nationkey, sum(CAST(l_quantity AS INTEGER)) AS qty_sum
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_partkey, s_nationkey),
oltp_inventory AS (
  SELECT l_partkey * 100 + s_nationkey AS inventory_id, l_partkey AS product_id,
         CASE WHEN s_nationkey % 2 = 0 THEN 'STORE' ELSE 'DC' END AS location_type,
         CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS store_id,
         CASE WHEN s_nationkey % 2 <> 0 THEN s_nationkey END AS dc_id,
         on_hand AS quantity_on_hand, on_hand % 4 AS quantity_reserved, on_hand - on_hand % 4 AS quantity_available,
         CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 10 END AS reorder_point,
         CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 50 END AS max_stock,
         TIMESTAMP '2001-07-15 00:00:00' AS as_of_timestamp
  FROM (SELECT *, CAST(qty_sum % 60 AS INTEGER) AS on_hand FROM inv_positions)),
oltp_inventory_snapshots AS (
  SELECT inventory_id * 100 + datediff('month', DATE '2000-09-01', snapshot_date) AS snapshot_id,
         snapshot_date, s.product_id, location_type, store_id, dc_id, quantity_on_hand,
         quantity_on_hand % 4 AS quantity_reserved, quantity_on_hand - quantity_on_hand % 4 AS quantity_available,
         CAST(quantity_on_hand * p.current_unit_cost AS DECIMAL(18,2)) AS inventory_value_cost
  FROM (SELECT *, CAST((product_id + month(snapshot_date) + coalesce(store_id, dc_id)) % 60 AS INTEGER) AS quantity_on_hand
        FROM (SELECT inventory_id, product_id, location_type, store_id, dc_id,
                     CAST(unnest(generate_series(DATE '2000-09-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE)
                       AS snapshot_date
              FROM oltp_inventory)) s
  JOIN oltp_products p ON s.product_id = p.product_id),
oltp_purchase_orders AS (
  SELECT l_orderkey * 10000000 + l_suppkey AS purchase_order_id,
         'PO-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS po_number,
         CAST(l_suppkey AS INTEGER) AS supplier_id, CAST(l_orderkey % 25 AS INTEGER) AS dc_id,
         order_date, order_date + 14 AS expected_receipt_date,
         CASE WHEN l_orderkey % 13 = 0 THEN 'Open' ELSE 'Closed' END AS po_status
  FROM (SELECT l_orderkey, l_suppkey, min(CAST(l_shipdate AS DATE)) - 20 AS order_date
        FROM oltp_lines GROUP BY l_orderkey, l_suppkey)),
oltp_purchase_order_items AS (
  SELECT order_item_id AS po_item_id, l_orderkey * 10000000 + l_suppkey AS purchase_order_id,
         l_linenumber AS line_number, l_partkey AS product_id, quantity AS quantity_ordered, unit_cost
  FROM oltp_lines),
oltp_goods_receipts AS (
  SELECT purchase_order_id AS receipt_id, purchase_order_id, dc_id,
         order_date + CAST(supplier_id % 30 AS INTEGER) AS receipt_date,
         CASE WHEN supplier_id % 30 = 29 THEN NULL ELSE supplier_id % 30 <= 14 END AS is_on_time
  FROM oltp_purchase_orders WHERE po_status = 'Closed'),
oltp_goods_receipt_items AS (
  SELECT order_item_id AS receipt_item_id, l_orderkey * 10000000 + l_suppkey AS receipt_id,
         order_item_id AS po_item_id, l_partkey AS product_id,
         greatest(quantity - l_linenumber % 3, 0) AS quantity_received
  FROM oltp_lines WHERE l_orderkey % 13 <> 0),
campaign_ids AS (
  SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS campaign_id FROM events
  WHERE json_extract_string(props, '$.k') IS NOT NULL),
oltp_marketing_campaigns AS (
  SELECT campaign_id, 'CMP' || lpad(CAST(campaign_id AS VARCHAR), CAST(greatest(length(CAST(campaign_id AS VARCHAR)), 3) AS INTEGER), '0') AS campaign_code,
         'Campaign ' || CAST(campaign_id AS VARCHAR) AS campaign_name,
         {_pick('campaign_id', CAMPAIGN_TYPES)} AS campaign_type,
         CASE WHEN campaign_id % 10 = 9 THEN NULL ELSE CAST(campaign_id % 5 + 1 AS INTEGER) END AS channel_id,
         DATE '2024-01-01' AS start_date, DATE '2024-01-31' AS end_date,
         CASE WHEN campaign_id % 20 = 19 THEN NULL ELSE CAST(1000 + (campaign_id % 8) * 250 AS DECIMAL(18,2)) END
           AS budget_amount,
         CASE WHEN campaign_id % 20 = 19 THEN NULL WHEN campaign_id % 25 = 24 THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(500 + (campaign_id % 13) * 100 AS DECIMAL(18,2)) END AS actual_spend,
         {_pick('campaign_id', OBJECTIVES)} AS objective_code,
         CAST(1 AS DECIMAL(6,4)) AS lift_factor, 'Completed' AS status_code
  FROM campaign_ids),
oltp_campaign_responses AS (
  SELECT event_id AS campaign_response_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS campaign_id,
         user_id AS customer_id, ts AS response_timestamp,
         CASE event_type WHEN 'view' THEN 'Sent' WHEN 'signup' THEN 'Open' WHEN 'error' THEN 'Click'
                         WHEN 'purchase' THEN 'Convert' WHEN 'click' THEN 'Unsubscribe' END AS response_type,
         CAST(NULL AS BIGINT) AS order_id,
         CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS attributed_revenue
  FROM events),
oltp_store_labor_hours AS (
  SELECT CAST(n_nationkey * 1000 + datediff('month', DATE '1995-01-01', work_date) AS BIGINT) AS labor_hours_id,
         n_nationkey AS store_id, CAST(NULL AS INTEGER) AS employee_id, work_date,
         CAST(100 + n_nationkey AS DECIMAL(8,2)) AS labor_hours,
         CAST(CAST(100 + n_nationkey AS DECIMAL(8,2)) * 20 AS DECIMAL(18,2)) AS labor_cost
  FROM (SELECT n_nationkey,
               CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS work_date
        FROM nation)),
oltp_stg_churn_predictions AS (
  SELECT customer_id, CAST(floor(least(DATE '2001-08-01' - max(order_date), 720) * 10000 / 720) AS BIGINT) / 10000.0
           AS churn_probability_raw
  FROM oltp_orders WHERE order_status IN ('Completed', 'Returned', 'PartiallyReturned') GROUP BY customer_id),
stg_churn AS (
  SELECT customer_id, CAST(churn_probability_raw AS DOUBLE) AS churn_probability,
         CASE WHEN churn_probability_raw >= 0.5 THEN 1 ELSE 0 END AS churn_predicted,
         CAST(NULL AS INTEGER) AS churn_actual,
         CASE WHEN customer_id % 11 = 0 THEN '  ' ELSE 'churn_gbm' END AS model_name,
         0.5 AS threshold, TIMESTAMP '2001-08-02 06:00:00' AS loaded_at
  FROM oltp_stg_churn_predictions),
stg_profit AS (
  SELECT order_id, customer_id, order_date, CAST(net_amount AS DECIMAL(38,10)) AS net_sales,
         CAST(NULL AS DOUBLE) AS margin_pct, 1 AS is_profitable,
         CAST(order_id % 100 AS DOUBLE) / 100.0 AS profit_probability,
         CASE WHEN CAST(order_id % 100 AS DOUBLE) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS profit_predicted,
         CASE WHEN order_id % 13 = 0 THEN NULL ELSE 'profit_xgb' END AS model_name,
         TIMESTAMP '2001-08-02 06:00:00' AS loaded_at
  FROM oltp_orders WHERE order_status IN ('Completed', 'Returned', 'PartiallyReturned')),
stg_forecast_m AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS ds, CAST(sum(net_amount) AS DECIMAL(38,10)) AS y_true
  FROM oltp_orders WHERE order_status IN ('Completed', 'Returned', 'PartiallyReturned') GROUP BY 1),
stg_forecast AS (
  SELECT ds, y_true, seasonal_naive, CAST(NULL AS DECIMAL(38,10)) AS sarimax,
         CAST(NULL AS DECIMAL(38,10)) AS sarimax_lower, CAST(NULL AS DECIMAL(38,10)) AS sarimax_upper,
         CAST(NULL AS DECIMAL(38,10)) AS ml_xgboost,
         CASE WHEN ds >= DATE '2000-01-01' THEN 'backtest' ELSE 'history' END AS forecast_horizon,
         CASE WHEN ds >= DATE '2000-01-01' THEN seasonal_naive END AS yhat,
         CAST(NULL AS DECIMAL(38,10)) AS yhat_lower, CAST(NULL AS DECIMAL(38,10)) AS yhat_upper,
         CASE WHEN ds >= DATE '2000-01-01' THEN 'seasonal_naive' ELSE ' ' END AS model_used,
         TIMESTAMP '2001-08-02 06:00:00' AS loaded_at
  FROM (SELECT *, lag(y_true, 12) OVER (ORDER BY ds) AS seasonal_naive FROM stg_forecast_m)),
params AS (SELECT max(order_date) AS as_of FROM oltp_orders)
"""
