"""SQL surface: catalog tables and marts as temp views, and the table
functions as session SQL functions (``CREATE TEMPORARY FUNCTION … RETURNS
TABLE``), for users who query with ``spark.sql``.

The bodies follow the same plan shape as the Python functions: line
measures are summed per order before the join with ``orders``, bounds are
scalar subqueries (no cross join), and ratios divide in DECIMAL(38,18).
``fn_customer_rfm_asof`` is not offered in SQL: a SQL ``NTILE() OVER (ORDER BY
…)`` runs in a single task, so RFM scoring stays on the distributed ranking
operator (``table_functions.customer_rfm_asof``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfwise.plans import marts as M
from shelfwise.sources.catalog import Catalog

SOLD = "('Completed', 'Returned', 'PartiallyReturned')"

MART_VIEWS = {
    "vw_product_category_map": M.product_category_map, "vw_fact_sales_line": M.fact_sales_line,
    "vw_sales_daily": M.sales_daily, "vw_sales_monthly": M.sales_monthly, "vw_customer_360": M.customer_360,
    "vw_inventory_health": M.inventory_health, "vw_fact_return_line": M.fact_return_line,
    "vw_supplier_performance": M.supplier_performance, "vw_campaign_performance": M.campaign_performance,
    "vw_shipment_performance": M.shipment_performance, "vw_executive_daily_kpis": M.executive_daily_kpis,
    "vw_payment_mix": M.payment_mix,
}


def register_views(cat: Catalog, marts: bool = True) -> list[str]:
    """Every catalog table (and optionally every mart) as a temp view."""
    names = []
    for name in cat.names():
        cat[name].createOrReplaceTempView(name)
        names.append(name)
    if marts:
        for view, fn in MART_VIEWS.items():
            fn(cat).createOrReplaceTempView(view)
            names.append(view)
    return names


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DECIMAL(38,18)) / NULLIF({b}, 0)"


PER_ORDER = f"""
  per_order AS (
    SELECT order_id, sum(line_net_amount) AS net, sum(line_cogs_amount) AS cogs, sum(quantity) AS units
    FROM order_items GROUP BY order_id),
  facts AS (
    SELECT o.order_id, o.order_date, o.store_id, o.customer_id, p.net, p.cogs, p.units
    FROM per_order p JOIN orders o ON o.order_id = p.order_id
    WHERE o.order_status IN {SOLD})"""

FUNCTIONS = {
    "fn_monthly_revenue": f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_monthly_revenue(p_start DATE DEFAULT NULL, p_end DATE DEFAULT NULL)
RETURNS TABLE (year_number INT, month_number SMALLINT, month_start DATE, net_sales DECIMAL(38,2),
               gross_profit DECIMAL(38,2), order_count BIGINT, yoy_net_sales DECIMAL(38,2), yoy_growth_pct DECIMAL(38,4))
RETURN
WITH {PER_ORDER},
  monthly AS (
    SELECT d.year_number, d.month_number, trunc(f.order_date, 'MM') AS month_start, sum(f.net) AS net,
           sum(f.net) - sum(f.cogs) AS gp, count(1) AS order_count
    FROM facts f JOIN calendar_date d ON d.full_date = f.order_date
    WHERE f.order_date BETWEEN coalesce(p_start, (SELECT min(order_date) FROM orders))
                           AND coalesce(p_end, (SELECT max(order_date) FROM orders))
    GROUP BY 1, 2, 3),
  lagged AS (SELECT *, lag(net, 12) OVER (ORDER BY month_start) AS prior FROM monthly)
SELECT year_number, month_number, month_start, round(net, 2), round(gp, 2), order_count, round(prior, 2),
       round({_div('net - prior', 'prior')}, 4)
FROM lagged""",
    "fn_store_performance": f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_store_performance(p_start DATE, p_end DATE)
RETURNS TABLE (store_id INT, store_code STRING, store_name STRING, region_name STRING, net_sales DECIMAL(38,2),
               gross_profit DECIMAL(38,2), margin_pct DECIMAL(38,4), order_count BIGINT, aov DECIMAL(38,2),
               units_sold BIGINT, sales_rank INT, sales_per_sqft DECIMAL(38,2))
RETURN
WITH {PER_ORDER},
  per_store AS (
    SELECT store_id, sum(net) AS net, sum(cogs) AS cogs, count(1) AS orders, sum(units) AS units
    FROM facts WHERE store_id IS NOT NULL AND order_date BETWEEN p_start AND p_end GROUP BY store_id)
SELECT s.store_id, s.store_code, s.store_name, r.region_name, round(ps.net, 2), round(ps.net - ps.cogs, 2),
       round({_div('ps.net - ps.cogs', 'ps.net')}, 4), ps.orders, round({_div('ps.net', 'ps.orders')}, 2), ps.units,
       rank() OVER (ORDER BY ps.net DESC NULLS FIRST), round({_div('ps.net', 's.selling_sq_ft')}, 2)
FROM per_store ps JOIN stores s ON s.store_id = ps.store_id JOIN regions r ON r.region_id = s.region_id""",
    "fn_category_contribution": f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_category_contribution(p_start DATE, p_end DATE)
RETURNS TABLE (category_code STRING, category_name STRING, net_sales DECIMAL(38,2), gross_profit DECIMAL(38,2),
               units_sold BIGINT, contribution_pct DECIMAL(38,4), sales_rank INT, cumulative_pct DECIMAL(38,4))
RETURN
WITH per_product AS (
    SELECT oi.product_id, sum(oi.line_net_amount) AS net, sum(oi.line_cogs_amount) AS cogs, sum(oi.quantity) AS units
    FROM order_items oi JOIN orders o ON o.order_id = oi.order_id
    WHERE o.order_status IN {SOLD} AND o.order_date BETWEEN p_start AND p_end
    GROUP BY oi.product_id),
  cat AS (
    SELECT m.category_code, m.category_name, sum(p.net) AS net, sum(p.cogs) AS cogs, sum(p.units) AS units
    FROM per_product p JOIN vw_product_category_map m ON m.product_id = p.product_id
    GROUP BY m.category_code, m.category_name),
  w AS (SELECT *, sum(net) OVER () AS total, sum(net) OVER (ORDER BY net DESC NULLS FIRST) AS cum,
               rank() OVER (ORDER BY net DESC NULLS FIRST) AS rnk FROM cat)
SELECT category_code, category_name, round(net, 2), round(net - cogs, 2), units, round({_div('net', 'total')}, 4), rnk,
       round({_div('cum', 'total')}, 4)
FROM w""",
    "fn_executive_scorecard": f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_executive_scorecard(p_start DATE, p_end DATE)
RETURNS TABLE (net_sales DECIMAL(38,2), prior_period_net_sales DECIMAL(38,2), sales_growth_pct DECIMAL(38,4),
               gross_profit DECIMAL(38,2), margin_pct DECIMAL(38,4), order_count BIGINT, aov DECIMAL(38,2),
               active_customers BIGINT, return_rate_value DECIMAL(38,4), avg_fulfillment_days DECIMAL(38,2))
RETURN
WITH {PER_ORDER},
  tagged AS (
    -- label both windows in one pass (parameters may not appear inside aggregates)
    SELECT net, cogs, customer_id, order_date >= p_start AS is_cur FROM facts
    WHERE order_date BETWEEN date_sub(p_start, datediff(p_end, p_start) + 1) AND p_end),
  win AS (
    SELECT sum(CASE WHEN is_cur THEN net END) AS net, sum(CASE WHEN NOT is_cur THEN net END) AS prior_net,
           sum(CASE WHEN is_cur THEN net END) - sum(CASE WHEN is_cur THEN cogs END) AS gp,
           count(CASE WHEN is_cur THEN 1 END) AS orders,
           count(DISTINCT CASE WHEN is_cur THEN customer_id END) AS customers
    FROM tagged),
  rets AS (
    SELECT coalesce(sum(ri.quantity_returned * ri.unit_refund_amount), 0) AS refund
    FROM return_items ri JOIN returns r ON r.return_id = ri.return_id
    WHERE r.return_date BETWEEN p_start AND p_end),
  ship AS (
    SELECT sum(datediff(sh.ship_date, o.order_date)) AS lead_sum, count(sh.ship_date) AS lead_n
    FROM shipments sh JOIN orders o ON o.order_id = sh.order_id
    WHERE o.order_date BETWEEN p_start AND p_end AND sh.ship_date IS NOT NULL)
SELECT round((SELECT net FROM win), 2), round((SELECT prior_net FROM win), 2),
       round({_div('(SELECT net - prior_net FROM win)', '(SELECT prior_net FROM win)')}, 4),
       round((SELECT gp FROM win), 2), round({_div('(SELECT gp FROM win)', '(SELECT net FROM win)')}, 4),
       (SELECT orders FROM win), round({_div('(SELECT net FROM win)', '(SELECT orders FROM win)')}, 2),
       (SELECT customers FROM win), round({_div('(SELECT refund FROM rets)', '(SELECT net FROM win)')}, 4),
       round({_div('(SELECT lead_sum FROM ship)', '(SELECT lead_n FROM ship)')}, 2)""",
}


def register_table_functions(spark: SparkSession) -> list[str]:
    for ddl in FUNCTIONS.values():
        spark.sql(ddl)
    return list(FUNCTIONS)


def install(cat: Catalog) -> None:
    """Views + functions for ``cat`` in its session."""
    register_views(cat)
    register_table_functions(cat.spark)
