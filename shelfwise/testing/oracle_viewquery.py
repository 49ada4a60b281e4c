"""DuckDB text for the registered view-query examples (VQ1-VQ4)."""

from __future__ import annotations

M03_COLS = ["order_date", "year_number", "quarter_number", "month_number", "store_id", "store_code", "store_name",
            "store_format", "region_id", "region_code", "region_name", "channel_id", "channel_code", "channel_name",
            "order_count", "units_sold", "gross_sales", "discount_amount", "net_sales", "cogs_amount", "gross_profit"]
_WHERE = ("channel_name IN ('Store Express', 'Store Standard') AND (store_code ILIKE '%NATION_1%' OR "
          "store_name ILIKE '%NATION_1%' OR region_name ILIKE '%NATION_1%' OR channel_name ILIKE '%NATION_1%')")
_ORDER = ", ".join(["net_sales DESC NULLS FIRST"] + [f"{c} ASC NULLS LAST" for c in M03_COLS if c != "net_sales"])

VQ = {
    "vq1_view_query_page": f"SELECT {', '.join(M03_COLS)} FROM vw_sales_daily WHERE {_WHERE} "
                           f"ORDER BY {_ORDER} LIMIT 50 OFFSET 50",
    "vq1_view_query_total": f"SELECT count(*) AS total_items, CAST(floor((count(*) + 49) / 50) AS BIGINT) AS total_pages "
                            f"FROM vw_sales_daily WHERE {_WHERE}",
    "vq2_summarize": "SELECT CAST(sum(lifetime_net_sales) AS DOUBLE) AS lifetime_net_sales, "
                     "CAST(sum(lifetime_gross_profit) AS DOUBLE) AS lifetime_gross_profit, "
                     "CAST(sum(order_count) AS DOUBLE) AS order_count, CAST(sum(lifetime_units) AS DOUBLE) AS lifetime_units "
                     "FROM vw_customer_360 WHERE lifecycle_status IN ('Active', 'At Risk')",
    "vq3_kpi_cards_sales": """
SELECT 'net_sales' AS id, 'Net Sales' AS title, CAST(sum(net_sales) AS DOUBLE) AS value, 'currency' AS format FROM vw_sales_daily
UNION ALL SELECT 'gross_profit', 'Gross Profit', CAST(sum(gross_profit) AS DOUBLE), 'currency' FROM vw_sales_daily
UNION ALL SELECT 'orders', 'Orders', CAST(sum(order_count) AS DOUBLE), 'number' FROM vw_sales_daily
UNION ALL SELECT 'units', 'Units Sold', CAST(sum(units_sold) AS DOUBLE), 'number' FROM vw_sales_daily""",
    "vq3_kpi_cards_finance": """
SELECT 'gross_sales' AS id, 'Gross Sales' AS title, CAST(sum(gross_sales) AS DOUBLE) AS value, 'currency' AS format FROM vw_sales_daily
UNION ALL SELECT 'cogs', 'COGS', CAST(sum(cogs_amount) AS DOUBLE), 'currency' FROM vw_sales_daily
UNION ALL SELECT 'gross_profit', 'Gross Profit', CAST(sum(gross_profit) AS DOUBLE), 'currency' FROM vw_sales_daily
UNION ALL SELECT 'discounts', 'Discounts', CAST(sum(discount_amount) AS DOUBLE), 'currency' FROM vw_sales_daily""",
    "vq3_kpi_cards_customer": """
SELECT 'lifetime_net_sales' AS id, 'Lifetime Net Sales' AS title, CAST(sum(lifetime_net_sales) AS DOUBLE) AS value,
       'currency' AS format FROM vw_customer_360
UNION ALL SELECT 'lifetime_gross_profit', 'Lifetime Gross Profit', CAST(sum(lifetime_gross_profit) AS DOUBLE), 'currency'
FROM vw_customer_360
UNION ALL SELECT 'orders', 'Orders', CAST(sum(order_count) AS DOUBLE), 'number' FROM vw_customer_360
UNION ALL SELECT 'units', 'Units', CAST(sum(lifetime_units) AS DOUBLE), 'number' FROM vw_customer_360""",
    "vq4_time_series": """
SELECT 'revenue' AS series, order_date AS x, CAST(net_sales AS DOUBLE) AS y FROM vw_executive_daily_kpis
UNION ALL SELECT 'profit', order_date, CAST(gross_profit AS DOUBLE) FROM vw_executive_daily_kpis
UNION ALL SELECT 'orders', order_date, CAST(order_count AS DOUBLE) FROM vw_executive_daily_kpis""",
}

VQ["vq1_view_query_dated"] = """
SELECT customer_id, customer_number, first_order_date, last_order_date, lifetime_net_sales FROM vw_customer_360
WHERE first_order_date >= DATE '1998-01-01' AND first_order_date <= DATE '1999-12-31'
ORDER BY last_order_date ASC NULLS LAST, customer_id ASC LIMIT 100"""
