"""DuckDB oracle text for the KPI roll-ups K01-K29 (default parameters).

Period windows: end = latest date of the source, start = end - 29 days, prior
window of the same length just before. Written per KPI at row grain with
FILTER aggregates, independent of the Spark plans.
"""

from __future__ import annotations

from shelfwise.testing.sqlhelp import R

AS_OF = "(SELECT as_of FROM params)"
K: dict[str, str] = {}


def trend(d: str) -> str:
    return f"(CASE WHEN {d} IS NULL THEN NULL WHEN {d} > 0.001 THEN 'up' WHEN {d} < -0.001 THEN 'down' ELSE 'flat' END)"


def growth(cur: str, prior: str) -> str:
    return R(f"{cur} - {prior}", prior, 6)


def formatted(value: str, fmt: str) -> str:
    v = f"CAST({value} AS DECIMAL(38,6))"
    if fmt == "currency":
        return f"('$' || format('{{:,}}', CAST(round({v}, 0) AS BIGINT)))"
    if fmt == "percent":
        return f"(CAST(round({v} * 100, 1) AS VARCHAR) || '%')"
    return (f"(CASE WHEN {v} = floor({v}) THEN format('{{:,}}', CAST({v} AS BIGINT)) "
            f"ELSE format('{{:,.1f}}', round({v}, 1)) END)")


def cards_sql(ctes: str, src: str, specs: list[tuple]) -> str:
    rows = []
    for mid, label, value, delta, fmt, avail in specs:
        d = delta or "CAST(NULL AS DOUBLE)"
        rows.append(f"SELECT '{mid}' AS metric_id, '{label}' AS label, CAST({value} AS DOUBLE) AS value, "
                    f"{formatted(value, fmt)} AS formatted_value, "
                    f"CAST({d} AS DOUBLE) AS delta, {trend(d)} AS trend, '{fmt}' AS format, ({avail}) AS available "
                    f"FROM {src}")
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(rows)


def period_ctes(table: str, date_col: str, name: str = "pw") -> str:
    return (f"{name} AS (SELECT e, e - 29 AS s, e - 30 AS pe, e - 59 AS ps "
            f"FROM (SELECT max({date_col}) AS e FROM {table}))")


def cur(col: str, pw: str = "pw") -> str:
    return f"{col} BETWEEN {pw}.s AND {pw}.e"


def pri(col: str, pw: str = "pw") -> str:
    return f"{col} BETWEEN {pw}.ps AND {pw}.pe"


# ------------------------------------------------------------------ dashboard
K["k01_dashboard_overview"] = cards_sql(
    f"""{period_ctes('vw_executive_daily_kpis', 'order_date')},
a AS (SELECT sum(net_sales) FILTER (WHERE {cur('order_date')}) AS rev,
             sum(gross_profit) FILTER (WHERE {cur('order_date')}) AS gp,
             sum(net_sales) FILTER (WHERE {pri('order_date')}) AS prior_rev,
             sum(stockout_positions) FILTER (WHERE {cur('order_date')}) AS so,
             sum(snapshot_positions) FILTER (WHERE {cur('order_date')}) AS pos,
             count(*) FILTER (WHERE {cur('order_date')}) AS n
      FROM vw_executive_daily_kpis, pw),
dq AS (SELECT max(overall_score) AS dq FROM ({{DQ}}) WHERE check_name = 'overall_score'),
ml AS (SELECT {R("sum(score) FILTER (WHERE lower(model_name) LIKE '%churn%')",
                 "count(score) FILTER (WHERE lower(model_name) LIKE '%churn%')", 6)} AS churn,
              count(DISTINCT customer_id) FILTER (WHERE entity_type = 'customer') AS active
       FROM ({{ML}})),
j AS (SELECT * FROM a, dq, ml)""",
    "j",
    [("revenue", "Revenue", "CASE WHEN n > 0 THEN round(rev, 2) END", growth("rev", "prior_rev"), "currency", "n > 0"),
     ("profit", "Profit", "CASE WHEN n > 0 THEN round(gp, 2) END", None, "currency", "n > 0"),
     ("profit_margin", "Profit Margin", R("gp", "rev", 6), None, "percent", f"{R('gp', 'rev', 6)} IS NOT NULL"),
     ("revenue_growth", "Revenue Growth", growth("rev", "prior_rev"), growth("rev", "prior_rev"), "percent",
      f"{growth('rev', 'prior_rev')} IS NOT NULL"),
     ("active_customers", "Active Customers", "CASE WHEN active > 0 THEN active END", None, "number", "active > 0"),
     ("inventory_health", "Inventory Health", R("pos - so", "pos", 6), None, "percent",
      f"{R('pos - so', 'pos', 6)} IS NOT NULL"),
     ("dq_score", "DQ Score", "dq", None, "percent", "dq IS NOT NULL"),
     ("overall_churn_risk", "Overall Churn Risk", "churn", None, "percent", "churn IS NOT NULL")])

K["k02_dashboard_trends"] = """
SELECT order_date AS date, net_sales AS revenue, gross_profit AS profit, order_count AS orders
FROM vw_executive_daily_kpis ORDER BY order_date DESC LIMIT 90"""

REGION = "coalesce(region_name, region_code, 'Unknown')"

K["k03_dashboard_regional"] = f"""
WITH {period_ctes('vw_sales_daily', 'order_date')},
g AS (SELECT {REGION} AS region, sum(net_sales) FILTER (WHERE {cur('order_date')}) AS revenue,
             sum(gross_profit) FILTER (WHERE {cur('order_date')}) AS profit,
             sum(order_count) FILTER (WHERE {cur('order_date')}) AS orders,
             sum(net_sales) FILTER (WHERE {pri('order_date')}) AS prior_rev,
             count(*) FILTER (WHERE {cur('order_date')}) AS n
      FROM vw_sales_daily, pw GROUP BY 1)
SELECT region, round(revenue, 2) AS revenue, round(profit, 2) AS profit, {growth('revenue', 'prior_rev')} AS growth,
       orders AS order_count
FROM g WHERE n > 0"""


def _priority(s: str) -> str:
    return (f"(CASE WHEN {s} IS NULL THEN 'medium' WHEN {s} >= 0.85 THEN 'critical' WHEN {s} >= 0.7 THEN 'high' "
            f"WHEN {s} >= 0.4 THEN 'medium' ELSE 'low' END)")


def _pct_text(x: str) -> str:
    return f"(CAST(round(CAST({x} AS DECIMAL(38,10)) * 100, 1) AS VARCHAR) || '%')"


K["k04_top_risks"] = f"""
WITH dq AS ({{DQ}}), ml AS ({{ML}}),
items AS (
  SELECT 1 AS grp, CAST(score AS DOUBLE) AS k1, check_name AS k2, entity_name AS k3,
         'dq-' || check_name || '-' || entity_name AS id, check_name AS title,
         coalesce(message, description) AS description,
         {_priority('CASE WHEN score IS NOT NULL THEN 1 - score ELSE 0.75 END')} AS priority,
         coalesce(nullif(lower(severity), ''), 'data quality') AS impact, coalesce(owner, 'Data Platform') AS owner,
         'data_quality_summary' AS source
  FROM dq WHERE lower(severity) IN ('critical', 'high', 'error', 'fail') OR score < 0.7
  UNION ALL
  SELECT 2, -coalesce(score, 0.0), entity_id, '', 'ml-risk-' || entity_id,
         coalesce(title, 'Elevated risk signal (' || entity_id || ')'), coalesce(explanation, model_name),
         {_priority('score')}, {_pct_text('score')}, 'Customer Analytics', 'machine_learning_predictions'
  FROM ml WHERE entity_type = 'customer'
    AND (lower(model_name) LIKE '%churn%' OR lower(model_name) LIKE '%risk%' OR lower(label) IN ('churn', 'high_risk', 'at_risk'))
  UNION ALL
  SELECT 3, 0.0, '', '', 'inventory-stockout-pressure', 'Inventory stockout pressure',
         CAST(stockout_positions AS VARCHAR) || ' of ' || CAST(snapshot_positions AS VARCHAR)
           || ' positions stocked out on latest scorecard day',
         {_priority(R('stockout_positions', 'snapshot_positions', 10))},
         {_pct_text(R('stockout_positions', 'snapshot_positions', 10))}, 'Operations', 'executive_scorecard'
  FROM (SELECT * FROM vw_executive_daily_kpis ORDER BY order_date DESC LIMIT 1)
  WHERE snapshot_positions > 0 AND CAST(stockout_positions AS DOUBLE) / snapshot_positions >= 0.05)
SELECT id, title, description, priority, impact, owner, source,
       row_number() OVER (ORDER BY grp, k1 ASC NULLS FIRST, k2, k3) AS rank
FROM items ORDER BY grp, k1 ASC NULLS FIRST, k2, k3"""

TOKENS = ("uplift", "propensity", "recommend", "opportunity", "growth", "cross_sell")
_opp = " OR ".join(f"lower(model_name) LIKE '%{t}%' OR lower(label) LIKE '%{t}%'" for t in TOKENS)

K["k05_opportunities"] = f"""
WITH ml AS ({{ML}}),
last14 AS (SELECT * FROM vw_executive_daily_kpis WHERE margin_pct IS NOT NULL ORDER BY order_date DESC LIMIT 14),
ends AS (SELECT count(*) AS n, min_by(margin_pct, order_date) AS m0, max_by(margin_pct, order_date) AS m1 FROM last14),
items AS (
  SELECT 1 AS grp, -coalesce(score, 0.0) AS k1, entity_id AS k2, 'ml-opp-' || entity_id AS id,
         coalesce(title, 'Growth opportunity (' || entity_id || ')') AS title,
         coalesce(explanation, model_name) AS description, CAST(estimated_impact AS VARCHAR) AS estimated_impact,
         CASE WHEN coalesce(score, 0) >= 0.7 THEN 'high' WHEN coalesce(score, 0) >= 0.4 THEN 'medium' ELSE 'low' END
           AS priority, 'machine_learning_predictions' AS source
  FROM ml WHERE {_opp}
  UNION ALL
  SELECT 2, 0.0, '', 'margin-expansion', 'Margin expansion trajectory',
         'Recent scorecard margin exceeds the start of the trailing window', {_pct_text('m1 - m0')}, 'medium',
         'executive_scorecard'
  FROM ends WHERE n >= 4 AND m1 > m0)
SELECT id, title, description, estimated_impact, priority, source FROM items ORDER BY grp, k1, k2"""

# ------------------------------------------------------------------ sales
K["k06_sales_overview"] = cards_sql(
    f"""{period_ctes('vw_sales_daily', 'order_date')},
a AS (SELECT sum(net_sales) FILTER (WHERE {cur('order_date')}) AS rev,
             sum(gross_profit) FILTER (WHERE {cur('order_date')}) AS gp,
             sum(order_count) FILTER (WHERE {cur('order_date')}) AS orders,
             sum(net_sales) FILTER (WHERE {pri('order_date')}) AS prior_rev,
             count(*) FILTER (WHERE {cur('order_date')}) AS n
      FROM vw_sales_daily, pw)""",
    "a",
    [("revenue", "Revenue", "CASE WHEN n > 0 THEN round(rev, 2) END", growth("rev", "prior_rev"), "currency", "n > 0"),
     ("orders", "Orders", "CASE WHEN n > 0 THEN orders END", None, "number", "n > 0"),
     ("aov", "Average Order Value", f"CASE WHEN n > 0 THEN {R('rev', 'orders', 6)} END", None, "currency",
      f"n > 0 AND {R('rev', 'orders', 6)} IS NOT NULL"),
     ("gross_profit", "Gross Profit", "CASE WHEN n > 0 THEN round(gp, 2) END", None, "currency", "n > 0"),
     ("profit_margin", "Profit Margin", f"CASE WHEN n > 0 THEN {R('gp', 'rev', 6)} END", None, "percent",
      f"n > 0 AND {R('gp', 'rev', 6)} IS NOT NULL"),
     ("growth", "Growth", growth("rev", "prior_rev"), growth("rev", "prior_rev"), "percent",
      f"{growth('rev', 'prior_rev')} IS NOT NULL")])

K["k07_sales_trends"] = """
SELECT strftime(order_date, '%Y-%m-%d') AS period, sum(net_sales) AS revenue, sum(order_count) AS orders, sum(gross_profit) AS profit
FROM vw_sales_daily GROUP BY ALL"""
K["k07_sales_trends_weekly"] = """
SELECT CAST(isoyear(order_date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(order_date) AS VARCHAR), 2, '0') AS period,
       sum(net_sales) AS revenue, sum(order_count) AS orders, sum(gross_profit) AS profit
FROM vw_sales_daily GROUP BY 1"""

LINES_CAT = """(SELECT f.order_id, f.order_date, f.store_id, f.product_id, f.quantity, f.line_net_amount,
                       f.line_gross_profit, pcm.sku, pcm.product_name, pcm.category_name
                FROM vw_fact_sales_line f LEFT JOIN vw_product_category_map pcm ON pcm.product_id = f.product_id)"""

K["k08_category_performance"] = f"""
WITH lc AS (SELECT *, coalesce(category_name, 'Uncategorized') AS category FROM {LINES_CAT}),
{period_ctes('lc', 'order_date')},
g AS (SELECT category, sum(line_net_amount) FILTER (WHERE {cur('order_date')}) AS revenue,
             count(DISTINCT order_id) FILTER (WHERE {cur('order_date')}) AS orders,
             sum(line_gross_profit) FILTER (WHERE {cur('order_date')}) AS profit,
             sum(line_net_amount) FILTER (WHERE {pri('order_date')}) AS prior_rev
      FROM lc, pw GROUP BY category)
SELECT category, round(revenue, 2) AS revenue, CAST(orders AS DOUBLE) AS orders, {growth('revenue', 'prior_rev')} AS growth,
       {R('profit', 'revenue', 6)} AS margin
FROM g WHERE orders > 0"""

K["k09_product_performance"] = f"""
WITH lc AS {LINES_CAT}, {period_ctes('lc', 'order_date')},
g AS (SELECT product_id, sum(line_net_amount) FILTER (WHERE {cur('order_date')}) AS revenue,
             count(DISTINCT order_id) FILTER (WHERE {cur('order_date')}) AS orders,
             sum(quantity) FILTER (WHERE {cur('order_date')}) AS units,
             sum(line_gross_profit) FILTER (WHERE {cur('order_date')}) AS profit,
             sum(line_net_amount) FILTER (WHERE {pri('order_date')}) AS prior_rev
      FROM lc, pw GROUP BY product_id),
r AS (SELECT CAST(g.product_id AS VARCHAR) AS product_id, coalesce(m.product_name, CAST(g.product_id AS VARCHAR)) AS product,
             m.sku, m.category_name AS category, round(revenue, 2) AS revenue, CAST(orders AS DOUBLE) AS orders,
             CAST(units AS DOUBLE) AS units, {R('profit', 'revenue', 6)} AS margin,
             {growth('revenue', 'prior_rev')} AS growth, g.product_id AS pid
      FROM g LEFT JOIN vw_product_category_map m ON m.product_id = g.product_id WHERE orders > 0),
t AS (SELECT count(*) AS total_items, CAST(floor((count(*) + 19) / 20) AS BIGINT) AS total_pages FROM r)
SELECT product_id, product, sku, category, revenue, orders, units, margin, growth, total_items, total_pages
FROM (SELECT * FROM r ORDER BY coalesce(revenue, 0) DESC, pid LIMIT 20) p, t"""

K["k10_regional_performance"] = f"""
WITH {period_ctes('vw_sales_daily', 'order_date')},
g AS (SELECT {REGION} AS region, sum(net_sales) FILTER (WHERE {cur('order_date')}) AS revenue,
             sum(order_count) FILTER (WHERE {cur('order_date')}) AS orders,
             sum(net_sales) FILTER (WHERE {pri('order_date')}) AS prior_rev,
             count(*) FILTER (WHERE {cur('order_date')}) AS n
      FROM vw_sales_daily, pw GROUP BY 1)
SELECT region, round(revenue, 2) AS revenue, {growth('revenue', 'prior_rev')} AS growth, orders FROM g WHERE n > 0"""

K["k11_top_customers"] = """
SELECT coalesce(customer_number, CAST(customer_id AS VARCHAR), 'Unknown') AS customer,
       CAST(customer_id AS VARCHAR) AS customer_id, lifetime_net_sales AS revenue, CAST(order_count AS DOUBLE) AS orders,
       lifetime_net_sales AS lifetime_value, lifetime_net_sales IS NOT NULL AS lifetime_value_available
FROM vw_customer_360 ORDER BY lifetime_net_sales DESC NULLS LAST, customer_id LIMIT 10"""

# ------------------------------------------------------------------ customers
CUST = f"""(SELECT c.*, CASE WHEN c.preferred_store_id IS NULL THEN 'Unknown'
                             ELSE coalesce(r.region_name, r.region_code, 'Unknown') END AS region
            FROM vw_customer_360 c LEFT JOIN oltp_stores s ON s.store_id = c.preferred_store_id
            LEFT JOIN oltp_regions r ON r.region_id = s.region_id)"""
CPW = f"cpw AS (SELECT {AS_OF} AS e, {AS_OF} - 29 AS s, {AS_OF} - 30 AS pe, {AS_OF} - 59 AS ps)"
FIRST = "coalesce(first_order_date, registration_date)"
ACTIVE = ("(lower(coalesce(lifecycle_status, '')) = 'active' OR (is_active AND lower(coalesce(lifecycle_status, '')) "
          "NOT IN ('churn risk', 'never purchased')))")

K["k12_customer_overview"] = cards_sql(
    f"""{CPW},
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE {ACTIVE}) AS active,
             count(*) FILTER (WHERE {FIRST} BETWEEN cpw.s AND cpw.e) AS new,
             count(*) FILTER (WHERE {FIRST} BETWEEN cpw.ps AND cpw.pe) AS prior_new,
             count(*) FILTER (WHERE coalesce(order_count, 0) > 1) AS rep,
             {R('sum(lifetime_net_sales)', 'count(lifetime_net_sales)', 2)} AS avg_ltv,
             count(*) FILTER (WHERE first_order_date < cpw.s) AS base,
             count(*) FILTER (WHERE first_order_date < cpw.s AND last_order_date >= cpw.s) AS retained,
             count(*) FILTER (WHERE lower(lifecycle_status) IN ('churn risk', 'at risk')) AS at_risk
      FROM {CUST}, cpw)""",
    "a",
    [("active_customers", "Active Customers", "CASE WHEN n > 0 THEN active END", None, "number", "n > 0"),
     ("new_customers", "New Customers", "CASE WHEN n > 0 THEN new END",
      f"CASE WHEN n > 0 THEN {growth('new', 'prior_new')} END", "number", "n > 0"),
     ("repeat_customers", "Repeat Customers", "CASE WHEN n > 0 THEN rep END", None, "number", "n > 0"),
     ("avg_ltv", "Average Lifetime Value", "avg_ltv", None, "currency", "avg_ltv IS NOT NULL"),
     ("retention_rate", "Retention Rate", R("retained", "base", 6), None, "percent",
      f"{R('retained', 'base', 6)} IS NOT NULL"),
     ("churn_risk_summary", "Churn Risk Summary", R("at_risk", "n", 6), None, "percent",
      f"{R('at_risk', 'n', 6)} IS NOT NULL")])

_REV = "coalesce(r.lifetime_net_sales, c.lifetime_net_sales, 0)"
_ORD = "coalesce(r.order_count, c.order_count, 0)"
_AOV = f"coalesce(c.avg_order_value, CASE WHEN {_ORD} <> 0 THEN {R(_REV, _ORD, 10)} END)"
_LAST = "coalesce(r.last_order_date, c.last_order_date)"

K["k13_rfm_segments"] = f"""
WITH {CPW},
g AS (SELECT coalesce(r.rfm_segment, 'Unknown') AS segment, count(*) AS customer_count, sum({_REV}) AS revenue,
             {R(f'sum({_AOV})', f'count({_AOV})', 6)} AS average_order_value,
             sum({_REV}) FILTER (WHERE {_LAST} BETWEEN cpw.s AND cpw.e) AS cur_rev,
             sum({_REV}) FILTER (WHERE {_LAST} BETWEEN cpw.ps AND cpw.pe) AS prior_rev
      FROM vw_customer_rfm r LEFT JOIN vw_customer_360 c ON c.customer_id = r.customer_id, cpw
      GROUP BY 1)
SELECT segment, CAST(customer_count AS DOUBLE) AS customer_count, round(revenue, 2) AS revenue, average_order_value,
       CASE WHEN cur_rev IS NOT NULL THEN {growth('cur_rev', 'prior_rev')} END AS growth
FROM g"""

K["k14_cohorts"] = f"""
WITH c AS (SELECT CAST(date_trunc('month', first_order_date) AS DATE) AS cohort_start, last_order_date
           FROM {CUST} WHERE first_order_date IS NOT NULL),
latest AS (SELECT DISTINCT cohort_start FROM c),
cells AS (SELECT c.cohort_start, c.last_order_date, k AS month_offset
          FROM c JOIN latest USING (cohort_start), range(0, 6) t(k)),
g AS (SELECT cohort_start, month_offset, count(*) AS cohort_size,
             count(*) FILTER (WHERE last_order_date >= cohort_start + to_months(CAST(month_offset AS INTEGER)))
               AS customer_count
      FROM cells GROUP BY 1, 2)
SELECT strftime(cohort_start, '%Y-%m') AS cohort, CAST(cohort_size AS DOUBLE) AS cohort_size, month_offset,
       {R('customer_count', 'cohort_size', 6)} AS retention_pct, CAST(customer_count AS DOUBLE) AS customer_count
FROM g"""

K["k15_customer_distribution"] = f"""
WITH {CPW},
g AS (SELECT region, count(*) AS customer_count, sum(coalesce(lifetime_net_sales, 0)) AS revenue,
             count(*) FILTER (WHERE {FIRST} BETWEEN cpw.s AND cpw.e) AS cur_new,
             count(*) FILTER (WHERE {FIRST} BETWEEN cpw.ps AND cpw.pe) AS prior_new
      FROM {CUST}, cpw GROUP BY region)
SELECT region, CAST(customer_count AS DOUBLE) AS customer_count, round(revenue, 2) AS revenue,
       CASE WHEN cur_new > 0 THEN {growth('cur_new', 'prior_new')} END AS growth
FROM g"""

K["k16_top_customers_detail"] = f"""
WITH r AS (
  SELECT CAST(c.customer_id AS VARCHAR) AS customer_id, coalesce(c.customer_number, CAST(c.customer_id AS VARCHAR)) AS customer,
         f.rfm_segment AS segment, CASE WHEN c.preferred_store_id IS NOT NULL THEN c.region END AS region,
         c.lifetime_net_sales AS lifetime_value, CAST(c.order_count AS DOUBLE) AS orders,
         round(c.avg_order_value, 6) AS average_order_value, c.lifecycle_status, c.last_order_date, c.customer_id AS cid
  FROM {CUST} c LEFT JOIN vw_customer_rfm f ON f.customer_id = c.customer_id),
t AS (SELECT count(*) AS total_items, CAST(floor((count(*) + 19) / 20) AS BIGINT) AS total_pages FROM r)
SELECT customer_id, customer, segment, region, lifetime_value, orders, average_order_value, lifecycle_status,
       last_order_date, total_items, total_pages
FROM (SELECT * FROM r ORDER BY coalesce(lifetime_value, 0) DESC, cid LIMIT 20) p, t"""

K["k17_churn_risk"] = f"""
WITH ml AS ({{ML}}),
p AS (SELECT ml.*, c.lifetime_net_sales FROM ml LEFT JOIN vw_customer_360 c ON CAST(c.customer_id AS VARCHAR) = ml.entity_id
      WHERE ml.entity_type = 'customer'
        AND (lower(model_name) LIKE '%churn%' OR lower(label) LIKE '%churn%' OR lower(model_name) LIKE '%risk%'
             OR score >= 0.3)),
g AS (SELECT CASE WHEN score IS NULL THEN 'Medium' WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Medium'
                  ELSE 'Low' END AS risk_level,
             count(*) AS n, sum(coalesce(coalesce(estimated_impact, lifetime_net_sales), 0)) AS rev,
             {R('sum(confidence)', 'count(confidence)', 6)} AS confidence
      FROM p GROUP BY 1),
levels AS (SELECT * FROM (VALUES ('High'), ('Medium'), ('Low')) t(risk_level))
SELECT l.risk_level, CAST(coalesce(n, 0) AS DOUBLE) AS customer_count,
       CASE WHEN coalesce(n, 0) > 0 THEN round(rev, 2) END AS predicted_revenue_at_risk, confidence,
       confidence IS NOT NULL AS confidence_available
FROM levels l LEFT JOIN g ON g.risk_level = l.risk_level"""

# ------------------------------------------------------------------ operations
K["k18_operations_overview"] = cards_sql(
    f"""inv AS (SELECT sum(inventory_value_cost) AS inv_value, count(*) AS n_inv,
                  count(*) FILTER (WHERE lower(stock_status) = 'healthy') AS healthy,
                  sum(quantity_on_hand) AS on_hand FROM vw_inventory_health),
sup AS (SELECT {R('sum(on_time_rate)', 'count(on_time_rate)', 6)} AS supplier_perf FROM vw_supplier_performance),
rets AS (SELECT sum(quantity_returned) AS returned FROM vw_fact_return_line),
ship AS (SELECT count(*) AS n_ship,
                count(*) FILTER (WHERE lower(delay_flag) = 'on track'
                                 OR lower(shipment_status) IN ('delivered', 'completed', 'shipped')) AS fulfilled
         FROM vw_shipment_performance),
units AS (SELECT sum(units_sold) AS sales_units FROM vw_sales_daily),
j AS (SELECT * FROM inv, sup, rets, ship, units)""",
    "j",
    [("inventory_value", "Inventory Value", "CASE WHEN n_inv > 0 THEN round(inv_value, 2) END", None, "currency",
      "n_inv > 0"),
     ("inventory_health", "Inventory Health", R("healthy", "n_inv", 6), None, "percent",
      f"{R('healthy', 'n_inv', 6)} IS NOT NULL"),
     ("stock_turnover", "Stock Turnover", R("sales_units", "on_hand", 6), None, "number",
      f"{R('sales_units', 'on_hand', 6)} IS NOT NULL"),
     ("supplier_performance", "Supplier Performance", "supplier_perf", None, "percent", "supplier_perf IS NOT NULL"),
     ("return_rate", "Return Rate", f"CASE WHEN returned IS NOT NULL THEN {R('returned', 'sales_units', 6)} END", None,
      "percent", f"returned IS NOT NULL AND {R('returned', 'sales_units', 6)} IS NOT NULL"),
     ("fulfillment_rate", "Fulfillment Rate", R("fulfilled", "n_ship", 6), None, "percent",
      f"{R('fulfilled', 'n_ship', 6)} IS NOT NULL")])

K["k19_inventory"] = f"""
WITH g AS (SELECT {R('(SELECT sum(units_sold) FROM vw_sales_daily)', 'sum(quantity_on_hand)', 6)} AS turn
           FROM vw_inventory_health),
r AS (SELECT coalesce(product_name, sku, CAST(product_id AS VARCHAR), 'Unknown') AS product,
             CAST(product_id AS VARCHAR) AS product_id, sku, category_name AS category,
             CAST(quantity_on_hand AS DOUBLE) AS stock, CAST(reorder_point AS DOUBLE) AS safety_stock,
             CASE WHEN quantity_on_hand IS NOT NULL THEN g.turn END AS turnover,
             inventory_value_cost AS inventory_value, stock_status, inventory_id AS iid
      FROM vw_inventory_health, g),
t AS (SELECT count(*) AS total_items, CAST(floor((count(*) + 19) / 20) AS BIGINT) AS total_pages FROM r)
SELECT product, product_id, sku, category, stock, safety_stock, turnover, inventory_value, stock_status, total_items,
       total_pages
FROM (SELECT * FROM r ORDER BY coalesce(inventory_value, 0) DESC, iid LIMIT 20) p, t"""

_Q = "CASE WHEN reliability_score > 1 THEN reliability_score / 100 ELSE reliability_score END"
_OT = "round(on_time_rate, 6)"
_MEAN = (f"(coalesce(CAST({_OT} AS DOUBLE), 0) + coalesce(CAST({_Q} AS DOUBLE), 0)) / "
         f"nullif((CASE WHEN {_OT} IS NULL THEN 0 ELSE 1 END) + (CASE WHEN {_Q} IS NULL THEN 0 ELSE 1 END), 0)")

K["k20_supplier_performance"] = f"""
SELECT coalesce(supplier_name, supplier_code, 'Unknown') AS supplier, CAST(supplier_id AS VARCHAR) AS supplier_id,
       {_OT} AS on_time_pct, round({_Q}, 6) AS quality_score,
       round(coalesce(avg_actual_lead_time_days, contracted_lead_time_days), 6) AS lead_time,
       CAST(units_ordered AS DOUBLE) AS purchase_volume,
       CASE WHEN ({_MEAN}) IS NULL THEN 'Unknown' WHEN ({_MEAN}) < 0.5 THEN 'High' WHEN ({_MEAN}) < 0.75 THEN 'Medium'
            ELSE 'Low' END AS risk_level
FROM vw_supplier_performance"""

K["k21_returns_by_category"] = f"""
WITH r AS (SELECT f.*, coalesce(pcm.category_name, 'Uncategorized') AS category
           FROM vw_fact_return_line f LEFT JOIN vw_product_category_map pcm ON pcm.product_id = f.product_id),
{period_ctes('r', 'return_date')},
g AS (SELECT category, sum(quantity_returned) FILTER (WHERE {cur('return_date')}) AS cnt,
             sum(refund_line_amount) FILTER (WHERE {cur('return_date')}) AS cost,
             sum(quantity_returned) FILTER (WHERE {pri('return_date')}) AS prior_cnt,
             count(*) FILTER (WHERE {cur('return_date')}) AS n
      FROM r, pw GROUP BY category)
SELECT category, CAST(cnt AS DOUBLE) AS return_count, {R('cnt', 'sum(cnt) OVER ()', 6)} AS return_pct,
       round(cost, 2) AS return_cost, {trend(growth('cnt', 'prior_cnt'))} AS trend
FROM g WHERE n > 0"""

K["k22_warehouse_performance"] = f"""
WITH inv AS (SELECT coalesce(dc_name, store_name, 'Unknown') AS warehouse, sum(coalesce(inventory_value_cost, 0)) AS inventory,
                    count(*) FILTER (WHERE lower(stock_status) = 'stockout') AS stockouts
             FROM vw_inventory_health GROUP BY 1),
sh AS (SELECT coalesce(dc_name, dc_code, 'Unknown') AS warehouse, count(*) AS total,
              count(*) FILTER (WHERE lower(delay_flag) = 'on track') AS fulfilled,
              {R('sum(fulfillment_lead_time_days)', 'count(fulfillment_lead_time_days)', 6)} AS lead
       FROM vw_shipment_performance GROUP BY 1)
SELECT coalesce(inv.warehouse, sh.warehouse) AS warehouse, round(inventory, 2) AS inventory,
       {R('fulfilled', 'total', 6)} AS fulfillment, CAST(stockouts AS DOUBLE) AS stockouts, lead AS average_processing_time
FROM inv FULL OUTER JOIN sh ON inv.warehouse = sh.warehouse"""

K["k23_operational_risks"] = f"""
WITH inv AS (SELECT count(*) FILTER (WHERE lower(stock_status) = 'stockout') AS so,
                    count(*) FILTER (WHERE lower(stock_status) = 'below reorder') AS below FROM vw_inventory_health),
rets AS ({{K21}}),
items AS (
  SELECT 1 AS grp, '' AS k, CAST(so AS VARCHAR) || ' stockout positions' AS risk,
         CASE WHEN so >= 10 THEN 'critical' ELSE 'high' END AS severity, 'Inventory Operations' AS owner,
         'Expedite replenishment for stocked-out SKUs and review safety stock.' AS recommendation
  FROM inv WHERE so > 0
  UNION ALL
  SELECT 2, '', CAST(below AS VARCHAR) || ' SKUs below reorder point', 'medium', 'Inventory Planning',
         'Trigger purchase orders for below-reorder items.' FROM inv WHERE below > 0
  UNION ALL
  SELECT 3, supplier_code, 'Low on-time delivery: ' || coalesce(supplier_name, 'Supplier'),
         CASE WHEN on_time_rate < 0.5 THEN 'high' ELSE 'medium' END, 'Procurement',
         'Engage supplier on lead-time recovery or dual-source critical SKUs.'
  FROM vw_supplier_performance WHERE on_time_rate < 0.7
  UNION ALL
  SELECT 4, category, 'Rising returns in ' || category, 'medium', 'Quality / CX',
         'Inspect return reasons and tighten quality checks for the category.'
  FROM rets WHERE trend = 'up')
SELECT risk, severity, owner, recommendation FROM items ORDER BY grp, k"""

# ------------------------------------------------------------------ finance
K["k24_finance_overview"] = cards_sql(
    f"""{period_ctes('vw_sales_daily', 'order_date')},
s AS (SELECT sum(net_sales) FILTER (WHERE {cur('order_date')}) AS rev,
             sum(gross_profit) FILTER (WHERE {cur('order_date')}) AS gp,
             sum(cogs_amount) FILTER (WHERE {cur('order_date')}) AS cogs,
             sum(discount_amount) FILTER (WHERE {cur('order_date')}) AS disc,
             count(*) FILTER (WHERE {cur('order_date')}) AS n FROM vw_sales_daily, pw),
rf AS (SELECT coalesce(sum(refund_line_amount) FILTER (WHERE {cur('return_date')}), 0) AS refunds
       FROM vw_fact_return_line, pw),
j AS (SELECT *, CASE WHEN n > 0 THEN cogs + disc + refunds END AS opcost FROM s, rf)""",
    "j",
    [("revenue", "Revenue", "CASE WHEN n > 0 THEN round(rev, 2) END", None, "currency", "n > 0"),
     ("gross_profit", "Gross Profit", "CASE WHEN n > 0 THEN round(gp, 2) END", None, "currency", "n > 0"),
     ("net_profit", "Net Profit", "CASE WHEN n > 0 THEN round(gp - refunds, 2) END", None, "currency", "n > 0"),
     ("profit_margin", "Profit Margin", f"CASE WHEN n > 0 THEN {R('gp', 'rev', 6)} END", None, "percent",
      f"n > 0 AND {R('gp', 'rev', 6)} IS NOT NULL"),
     ("operating_cost", "Operating Cost", "round(opcost, 2)", None, "currency", "opcost IS NOT NULL"),
     ("cost_ratio", "Cost Ratio", R("opcost", "rev", 6), None, "percent", f"{R('opcost', 'rev', 6)} IS NOT NULL")])

K["k25_profitability_by_region"] = f"""
WITH {period_ctes('vw_sales_daily', 'order_date')},
g AS (SELECT {REGION} AS region, sum(net_sales) FILTER (WHERE {cur('order_date')}) AS revenue,
             sum(cogs_amount) FILTER (WHERE {cur('order_date')}) AS cost,
             sum(gross_profit) FILTER (WHERE {cur('order_date')}) AS profit,
             sum(net_sales) FILTER (WHERE {pri('order_date')}) AS prior_rev,
             count(*) FILTER (WHERE {cur('order_date')}) AS n
      FROM vw_sales_daily, pw GROUP BY 1)
SELECT region, round(revenue, 2) AS revenue, round(cost, 2) AS cost, round(profit, 2) AS profit,
       {R('profit', 'revenue', 6)} AS margin, {growth('revenue', 'prior_rev')} AS growth
FROM g WHERE n > 0"""

K["k26_cost_breakdown"] = f"""
WITH {period_ctes('vw_sales_daily', 'order_date')},
s AS (SELECT sum(cogs_amount) FILTER (WHERE {cur('order_date')}) AS c_cogs,
             sum(cogs_amount) FILTER (WHERE {pri('order_date')}) AS p_cogs,
             sum(discount_amount) FILTER (WHERE {cur('order_date')}) AS c_disc,
             sum(discount_amount) FILTER (WHERE {pri('order_date')}) AS p_disc FROM vw_sales_daily, pw),
rf AS (SELECT sum(refund_line_amount) FILTER (WHERE {cur('return_date')}) AS c_ref,
              sum(refund_line_amount) FILTER (WHERE {pri('return_date')}) AS p_ref FROM vw_fact_return_line, pw),
items AS (
  SELECT 'COGS' AS cost_category, coalesce(c_cogs, 0) AS amount, coalesce(p_cogs, 0) AS prior FROM s
  UNION ALL SELECT 'Discounts', coalesce(c_disc, 0), coalesce(p_disc, 0) FROM s
  UNION ALL SELECT 'Refunds', coalesce(c_ref, 0), coalesce(p_ref, 0) FROM rf),
t AS (SELECT *, sum(amount) OVER () AS total FROM items)
SELECT cost_category, round(amount, 2) AS amount, {R('amount', 'total', 6)} AS percentage,
       {trend(growth('amount', 'prior'))} AS trend
FROM t WHERE total > 0"""

K["k27_cashflow"] = f"""
WITH pay AS (SELECT strftime(payment_month, '%Y-%m') AS period, sum(payment_amount) AS inflows FROM vw_payment_mix GROUP BY 1),
bm AS (SELECT strftime(order_date, '%Y-%m') AS period, sum(cogs_amount + discount_amount) AS out_sales,
              sum(gross_profit) AS profit, sum(net_sales) AS revenue FROM vw_sales_daily GROUP BY 1),
rf AS (SELECT strftime(order_date, '%Y-%m') AS period, sum(refund_amount) AS out_ref FROM vw_executive_daily_kpis GROUP BY 1),
hp AS (SELECT count(*) > 0 AS has_pay FROM pay),
j AS (SELECT coalesce(bm.period, rf.period, pay.period) AS period, bm.out_sales, bm.profit, bm.revenue, rf.out_ref,
             pay.inflows
      FROM bm FULL OUTER JOIN rf ON rf.period = bm.period
      FULL OUTER JOIN pay ON pay.period = coalesce(bm.period, rf.period)),
k AS (SELECT j.*, CASE WHEN hp.has_pay THEN coalesce(inflows, 0) ELSE coalesce(revenue, 0) END AS inflow,
             coalesce(out_sales, 0) + coalesce(out_ref, 0) AS outflow FROM j, hp)
SELECT period, round(inflow, 2) AS inflows, round(outflow, 2) AS outflows, round(inflow - outflow, 2) AS net_cashflow,
       round(profit, 2) AS profit, CASE WHEN profit IS NOT NULL THEN {R('profit', 'revenue', 6)} END AS margin
FROM k"""

K["k29_budget_variance"] = f"""
WITH g AS (SELECT coalesce(campaign_type, objective_code, 'Unassigned') AS department,
                  sum(coalesce(budget_amount, 0)) AS budget, sum(coalesce(actual_spend, 0)) AS actual
           FROM vw_campaign_performance GROUP BY 1)
SELECT department, round(budget, 2) AS budget, round(actual, 2) AS actual, round(actual - budget, 2) AS variance,
       {R('actual - budget', 'budget', 6)} AS variance_pct
FROM g"""

K["k28_financial_risks"] = """
WITH prof AS ({K25}), costs AS ({K26}), budget AS ({K29}), ov AS ({K24}),
items AS (
  SELECT 1 AS grp, region AS k, 0 AS sub, 'Low margin in ' || region AS risk,
         CASE WHEN margin < 0.05 THEN 'high' ELSE 'medium' END AS severity, profit AS estimated_impact,
         'Finance / Regional Ops' AS owner, 'Review pricing, mix, and COGS for the region.' AS recommendation
  FROM prof WHERE margin < 0.15
  UNION ALL
  SELECT 1, region, 1, 'Revenue contraction in ' || region, 'high', revenue, 'Commercial Finance',
         'Investigate demand and discounting pressure in the region.' FROM prof WHERE growth < -0.1
  UNION ALL
  SELECT 2, cost_category, 0, 'Rising ' || cost_category || ' share', 'medium', amount, 'Cost Controllers',
         'Contain ' || cost_category || ' growth versus prior period.'
  FROM costs WHERE trend = 'up' AND coalesce(percentage, 0) >= 0.3
  UNION ALL
  SELECT 3, department, 0, 'Budget overrun: ' || department,
         CASE WHEN variance_pct > 0.25 THEN 'critical' ELSE 'high' END, variance, 'FP&A',
         'Re-forecast spend and enforce budget controls.' FROM budget WHERE variance_pct > 0.1
  UNION ALL
  SELECT 4, '', 0, 'Enterprise margin below 20%', 'medium', NULL, 'CFO Office',
         'Prioritize margin expansion initiatives across regions.'
  FROM ov WHERE metric_id = 'profit_margin' AND available AND value < 0.2)
SELECT risk, severity, estimated_impact, owner, recommendation FROM items ORDER BY grp, k, sub"""


def _expand(sql: str) -> str:
    from shelfwise.testing.oracle_views import V
    return (sql.replace("{DQ}", V["m15"]).replace("{ML}", V["m14"]).replace("{K21}", K["k21_returns_by_category"])
            .replace("{K25}", K["k25_profitability_by_region"]).replace("{K26}", K["k26_cost_breakdown"])
            .replace("{K29}", K["k29_budget_variance"]).replace("{K24}", K["k24_finance_overview"]))


for _k in list(K):
    K[_k] = _expand(K[_k])


# ------------------------------------------------------------------ parameterised variants
def _with_base(sql: str, table: str, where: str) -> str:
    body = sql.replace(table, "base")
    return body.replace("WITH ", f"WITH base AS (SELECT * FROM {table} WHERE {where}), ", 1)


_SEARCH = ("(store_code ILIKE '%NATION_2%' OR store_name ILIKE '%NATION_2%' OR region_name ILIKE '%NATION_2%' "
           "OR channel_name ILIKE '%NATION_2%')")
K["k06_sales_overview_filtered"] = _with_base(K["k06_sales_overview"], "vw_sales_daily",
                                              f"region_name IN ('ASIA', 'EUROPE') AND {_SEARCH}")
K["k07_sales_trends_monthly"] = """
SELECT strftime(order_date, '%Y-%m') AS period, sum(net_sales) AS revenue, sum(order_count) AS orders,
       sum(gross_profit) AS profit
FROM vw_sales_daily WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' GROUP BY 1"""
K["k08_category_performance_filtered"] = K["k08_category_performance"].replace(
    "FROM (SELECT f.order_id", "FROM (SELECT f.order_id", 1).replace(
    "coalesce(category_name, 'Uncategorized') AS category FROM " + LINES_CAT,
    "coalesce(category_name, 'Uncategorized') AS category FROM " + LINES_CAT
    + " WHERE lower(coalesce(category_name, 'Uncategorized')) IN ('small', 'large')")
K["k09_product_performance_margin_p2"] = K["k09_product_performance"].replace(
    "ORDER BY coalesce(revenue, 0) DESC, pid LIMIT 20", "ORDER BY coalesce(margin, 0) ASC, pid LIMIT 25 OFFSET 25"
).replace("(count(*) + 19) / 20", "(count(*) + 24) / 25")
K["k16_top_customers_detail_orders_p3"] = K["k16_top_customers_detail"].replace(
    "ORDER BY coalesce(lifetime_value, 0) DESC, cid LIMIT 20", "ORDER BY coalesce(orders, 0) ASC, cid LIMIT 50 OFFSET 100"
).replace("(count(*) + 19) / 20", "(count(*) + 49) / 50")

K["k13_rfm_segments_filtered"] = K["k13_rfm_segments"].replace(
    "FROM vw_customer_rfm r LEFT JOIN vw_customer_360 c ON c.customer_id = r.customer_id, cpw\n      GROUP BY 1",
    "FROM vw_customer_rfm r LEFT JOIN vw_customer_360 c ON c.customer_id = r.customer_id, cpw\n"
    "      WHERE lower(r.rfm_segment) IN ('champions', 'loyal')\n      GROUP BY 1")
K["k14_cohorts_3m"] = K["k14_cohorts"].replace("range(0, 6)", "range(0, 3)")
K["k19_inventory_by_product_p2"] = K["k19_inventory"].replace(
    "ORDER BY coalesce(inventory_value, 0) DESC, iid LIMIT 20", "ORDER BY lower(coalesce(product, '')) ASC, iid LIMIT 30 OFFSET 30"
).replace("(count(*) + 19) / 20", "(count(*) + 29) / 30")
K["k21_returns_by_category_filtered"] = K["k21_returns_by_category"].replace(
    "FROM vw_fact_return_line f LEFT JOIN vw_product_category_map pcm ON pcm.product_id = f.product_id)",
    "FROM vw_fact_return_line f LEFT JOIN vw_product_category_map pcm ON pcm.product_id = f.product_id\n"
    "           WHERE lower(coalesce(pcm.category_name, 'Uncategorized')) IN ('small', 'medium'))")
# every variant must differ from its base text (a failed replace would silently test the default)
for _variant, _base in (("k06_sales_overview_filtered", "k06_sales_overview"),
                        ("k08_category_performance_filtered", "k08_category_performance"),
                        ("k09_product_performance_margin_p2", "k09_product_performance"),
                        ("k13_rfm_segments_filtered", "k13_rfm_segments"), ("k14_cohorts_3m", "k14_cohorts"),
                        ("k16_top_customers_detail_orders_p3", "k16_top_customers_detail"),
                        ("k19_inventory_by_product_p2", "k19_inventory"),
                        ("k21_returns_by_category_filtered", "k21_returns_by_category")):
    assert K[_variant] != K[_base], _variant

K["k17_churn_risk_champions"] = K["k17_churn_risk"].replace(
    "WHERE ml.entity_type = 'customer'",
    "WHERE ml.entity_type = 'customer' AND ml.entity_id IN (SELECT CAST(customer_id AS VARCHAR) FROM vw_customer_rfm "
    "WHERE lower(rfm_segment) IN ('champions'))")
# category, search and region at once: lines, with the columns that the daily sales are searched by
K["k06_sales_overview_category_search"] = _with_base(K["k06_sales_overview"], "vw_sales_daily", "TRUE").replace(
    "WITH base AS (SELECT * FROM vw_sales_daily WHERE TRUE)", """WITH base AS (
  SELECT f.order_date, f.order_id, sum(f.line_net_amount) AS net_sales, sum(f.line_gross_profit) AS gross_profit, 1 AS order_count
  FROM vw_fact_sales_line f JOIN vw_product_category_map m ON m.product_id = f.product_id
  JOIN oltp_channels c ON c.channel_id = f.channel_id LEFT JOIN oltp_stores s ON s.store_id = f.store_id
  LEFT JOIN oltp_regions r ON r.region_id = s.region_id
  WHERE lower(m.category_name) IN ('small', 'large')
    AND contains(lower(concat_ws(chr(1), s.store_code, s.store_name, r.region_name, c.channel_name)), 'web')
  GROUP BY f.order_date, f.order_id)""")
# no prediction holds the text, some customers do: risk by lifecycle
K["k17_churn_risk_lifecycle"] = """
WITH levels(risk_level) AS (VALUES ('High'), ('Medium'), ('Low')),
c AS (SELECT coalesce(list_extract(['High', 'Medium'], list_position(['Churn Risk', 'At Risk'], lifecycle_status)), 'Low') AS risk_level,
             coalesce(lifetime_net_sales, 0) AS sales
      FROM vw_customer_360 WHERE contains(lower(concat_ws(chr(1), customer_number, customer_type, loyalty_tier, lifecycle_status)), 'gold'))
SELECT l.risk_level, CAST(count(c.risk_level) AS DOUBLE) AS customer_count,
       CASE WHEN l.risk_level <> 'Low' THEN coalesce(sum(sales), 0) END AS predicted_revenue_at_risk,
       NULL AS confidence, FALSE AS confidence_available
FROM levels l LEFT JOIN c ON c.risk_level = l.risk_level GROUP BY l.risk_level"""
# the search goes through the figures as well as the texts: of one cost its rise is left
K["k28_financial_risks_search"] = f"SELECT * FROM ({K['k28_financial_risks']}) WHERE contains(lower(risk), 'cogs')"
K["k22_warehouse_performance_search"] = K["k22_warehouse_performance"].replace(
    "FROM vw_inventory_health GROUP BY 1",
    "FROM vw_inventory_health WHERE contains(lower(coalesce(dc_name, store_name, 'Unknown')), 'nation_1') GROUP BY 1"
).replace(
    "FROM vw_shipment_performance GROUP BY 1",
    "FROM vw_shipment_performance WHERE contains(lower(coalesce(dc_name, dc_code, 'Unknown')), 'nation_1') GROUP BY 1")
assert K["k17_churn_risk_champions"] != K["k17_churn_risk"]
assert K["k22_warehouse_performance_search"].count("contains(") == 2
