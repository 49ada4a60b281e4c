"""KPI roll-ups K01-K29 (L4), as DataFrame aggregations over whole marts.

The reference computes these in Python loops over at most 500 view rows;
here every roll-up is a grouped/conditional aggregate inside Spark (D1), with
the period windows of ``operators.period``. Result shapes:

* KPI cards: ``metric_id, label, value, delta, trend, format, available``
  (one row per metric, built from one 1-row aggregate with ``inline``);
* tables: one row per key, as in the reference responses;
* paged tables add ``total_items`` and ``total_pages`` columns.

Values: money rounded to 2 places, ratios to 6 (DECIMAL arithmetic), counts
as numbers. Corrections applied: D1, D3, D5, D6, D7, D11 (K24/K26 refunds from
returns), D18, D19, D20, D22. Sort keys that the reference wraps in
``x or 0.0`` use ``coalesce(x, 0)`` and a stable id tie-breaker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.expr import (any_of, format_value, iso_week_key, month_key, percent_text, priority_from_score,
                                      ratio, risk_level, supplier_risk, trend_label, xdiv)
from shelfwise.operators.materialize import attach_scalars
from shelfwise.operators.period import Period, make_period, resolve_period
from shelfwise.operators.ranking import top_n
from shelfwise.plans import marts as M
from shelfwise.plans.predictions import ml_predictions
from shelfwise.plans.quality import data_quality_summary
from shelfwise.sources.catalog import Catalog

B = F.broadcast
R6 = 6

# Owners and recommendation texts of the risk/opportunity feeds.
RISK_TEXT = {
    "stockouts": ("Inventory Operations", "Expedite replenishment for stocked-out SKUs and review safety stock."),
    "below_reorder": ("Inventory Planning", "Trigger purchase orders for below-reorder items."),
    "supplier_on_time": ("Procurement", "Engage supplier on lead-time recovery or dual-source critical SKUs."),
    "rising_returns": ("Quality / CX", "Inspect return reasons and tighten quality checks for the category."),
    "low_margin": ("Finance / Regional Ops", "Review pricing, mix, and COGS for the region."),
    "contraction": ("Commercial Finance", "Investigate demand and discounting pressure in the region."),
    "rising_cost": ("Cost Controllers", "Contain {} growth versus prior period."),
    "budget_overrun": ("FP&A", "Re-forecast spend and enforce budget controls."),
    "enterprise_margin": ("CFO Office", "Prioritize margin expansion initiatives across regions."),
    "ml_risk": ("Customer Analytics", None),
    "stockout_pressure": ("Operations", None),
}
FEED_TITLES = {
    "ml_risk": "Elevated risk signal ({})", "stockout_pressure": "Inventory stockout pressure",
    "ml_opportunity": "Growth opportunity ({})", "margin_expansion": "Margin expansion trajectory",
    "margin_expansion_description": "Recent scorecard margin exceeds the start of the trailing window",
}


def _owner(key):
    return F.lit(RISK_TEXT[key][0]).alias("owner")


def _advice(key):
    return F.lit(RISK_TEXT[key][1]).alias("recommendation")


def _title_text(template, value):
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _title(key, entity):
    return _title_text(FEED_TITLES[key], entity)


def _money(c) -> Column:
    return F.round(c, 2)


def _growth(cur, prior) -> Column:
    """(cur - prior) / prior; NULL when prior is 0 or missing."""
    return ratio(cur - prior, prior, R6)


def cards(row: DataFrame, specs: list[tuple]) -> DataFrame:
    """specs: (metric_id, label, value, delta or None, format, available);
    ``formatted_value`` is the display text of the value (F11)."""
    structs = []
    for mid, label, value, delta, fmt, available in specs:
        d = delta if delta is not None else F.lit(None)
        structs.append(F.struct(
            F.lit(mid).alias("metric_id"), F.lit(label).alias("label"), value.cast("double").alias("value"),
            format_value(value, fmt).alias("formatted_value"),
            d.cast("double").alias("delta"), trend_label(d).alias("trend"), F.lit(fmt).alias("format"),
            available.alias("available")))
    return row.select(F.inline(F.array(*structs)))


def _search(df: DataFrame, text: str | None, columns: list[str]) -> DataFrame:
    """OR of ``col ILIKE %text%`` over the searchable columns (P8, no escaping)."""
    if not text:
        return df
    return df.where(any_of([F.col(c).ilike(f"%{text}%") for c in columns]))


def _isin_ci(c: str, values: list[str] | None) -> Column | None:
    if not values:
        return None
    return F.lower(F.col(c)).isin([v.lower() for v in values])


def _paged(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """Offset pagination with total count."""
    if page < 1 or not (1 <= page_size <= 500):
        raise ValueError("page must be >= 1 and page_size in 1..500")
    total = df.agg(F.count(F.lit(1)).alias("total_items"))
    page_rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    total = total.withColumn("total_pages", F.floor((F.col("total_items") + page_size - 1) / page_size).cast("long"))
    return attach_scalars(page_rows, total)


def _region_name() -> Column:
    return F.coalesce(F.col("region_name"), F.col("region_code"), F.lit("Unknown"))


def _sales_summary(cat, region=None, search=None) -> DataFrame:
    df = M.sales_daily(cat)
    if region:
        df = df.where(F.col("region_name").isin(region))
    return _search(df, search, ["store_code", "store_name", "region_name", "channel_name"])


# ============================================================ dashboard
def k01_dashboard_overview(cat: Catalog, days: int = 30) -> DataFrame:
    sc = M.executive_daily_kpis(cat)
    p = resolve_period(sc, "order_date", days=days)
    cur, pri = p.current("order_date"), p.prior("order_date")
    agg = sc.agg(
        F.sum(F.when(cur, F.col("net_sales"))).alias("rev"), F.sum(F.when(cur, F.col("gross_profit"))).alias("gp"),
        F.sum(F.when(pri, F.col("net_sales"))).alias("prior_rev"),
        F.sum(F.when(cur, F.col("stockout_positions"))).alias("stockouts"),
        F.sum(F.when(cur, F.col("snapshot_positions"))).alias("positions"),
        F.count(F.when(cur, 1)).alias("n_cur"))
    dq = (data_quality_summary(cat).where(F.col("check_name") == "overall_score")
          .agg(F.max("overall_score").alias("dq")))
    pred = ml_predictions(cat)
    ml = pred.agg(
        F.round(xdiv(F.sum(F.when(F.lower("model_name").contains("churn"), F.col("score"))),
                     F.count(F.when(F.lower("model_name").contains("churn"), F.col("score")))), R6).alias("churn"),
        # Distinct customers, not distinct entity ids
        F.countDistinct(F.when(F.col("entity_type") == "customer", F.col("customer_id"))).alias("active"))
    from shelfwise.plans.business import one_row_join
    j = one_row_join(agg, dq, ml)
    has = F.col("n_cur") > 0
    growth = _growth(F.col("rev"), F.col("prior_rev"))
    health = F.round(F.lit(1) - xdiv("stockouts", "positions"), R6)
    active = F.when(F.col("active") > 0, F.col("active"))
    return cards(j, [
        ("revenue", "Revenue", F.when(has, _money(F.col("rev"))), growth, "currency", has),
        ("profit", "Profit", F.when(has, _money(F.col("gp"))), None, "currency", has),
        ("profit_margin", "Profit Margin", ratio("gp", "rev", R6), None, "percent", ratio("gp", "rev", R6).isNotNull()),
        ("revenue_growth", "Revenue Growth", growth, growth, "percent", growth.isNotNull()),
        ("active_customers", "Active Customers", active, None, "number", active.isNotNull()),
        ("inventory_health", "Inventory Health", health, None, "percent", health.isNotNull()),
        ("dq_score", "DQ Score", F.col("dq"), None, "percent", F.col("dq").isNotNull()),
        ("overall_churn_risk", "Overall Churn Risk", F.col("churn"), None, "percent", F.col("churn").isNotNull()),
    ])


def k02_dashboard_trends(cat: Catalog, days: int = 90) -> DataFrame:
    sc = M.executive_daily_kpis(cat)
    last = sc.orderBy(F.col("order_date").desc()).limit(days)
    return last.select(F.col("order_date").alias("date"), F.col("net_sales").alias("revenue"),
                       F.col("gross_profit").alias("profit"), F.col("order_count").alias("orders")).orderBy("date")


def _regional(df: DataFrame, p: Period, with_profit: bool) -> DataFrame:
    cur, pri = p.current("order_date"), p.prior("order_date")
    g = df.groupBy(_region_name().alias("region")).agg(
        F.sum(F.when(cur, F.col("net_sales"))).alias("revenue"),
        F.sum(F.when(cur, F.col("gross_profit"))).alias("profit"),
        F.sum(F.when(cur, F.col("order_count"))).alias("orders"),
        F.sum(F.when(pri, F.col("net_sales"))).alias("prior_rev"),
        F.count(F.when(cur, 1)).alias("n_cur"))
    g = g.where(F.col("n_cur") > 0)
    cols = [F.col("region"), _money(F.col("revenue")).alias("revenue")]
    if with_profit:
        cols.append(_money(F.col("profit")).alias("profit"))
    cols += [_growth(F.col("revenue"), F.col("prior_rev")).alias("growth"),
             F.col("orders").alias("order_count" if with_profit else "orders")]
    return g.select(*cols).orderBy(F.col("revenue").desc(), "region")


def k03_dashboard_regional(cat: Catalog, days: int = 30) -> DataFrame:
    df = M.sales_daily(cat)
    p = resolve_period(df, "order_date", days=days)
    return _regional(df, p, with_profit=True)


def k04_top_risks(cat: Catalog, limit: int | None = None) -> DataFrame:
    dq = data_quality_summary(cat)
    sev = F.lower(F.col("severity"))
    dq_items = dq.where(sev.isin("critical", "high", "error", "fail") | (F.col("score") < 0.7)).select(
        F.lit(1).alias("_grp"), F.col("score").cast("double").alias("_k1"), F.col("check_name").alias("_k2"),
        F.col("entity_name").alias("_k3"),
        F.concat(F.lit("dq-"), F.col("check_name"), F.lit("-"), F.col("entity_name")).alias("id"),
        F.col("check_name").alias("title"), F.coalesce("message", "description").alias("description"),
        priority_from_score(F.when(F.col("score").isNotNull(), F.lit(1) - F.col("score")).otherwise(F.lit(0.75)))
        .alias("priority"),
        F.coalesce(F.nullif(sev, F.lit("")), F.lit("data quality")).alias("impact"),
        F.coalesce("owner", F.lit("Data Platform")).alias("owner"), F.lit("data_quality_summary").alias("source"))
    pred = ml_predictions(cat).where(F.col("entity_type") == "customer")  # D6
    model, label = F.lower("model_name"), F.lower("label")
    risky = model.contains("churn") | model.contains("risk") | label.isin("churn", "high_risk", "at_risk")
    ml_items = pred.where(risky).select(
        F.lit(2).alias("_grp"), (-F.coalesce("score", F.lit(0.0))).alias("_k1"), F.col("entity_id").alias("_k2"),
        F.lit("").alias("_k3"),
        F.concat(F.lit("ml-risk-"), F.col("entity_id")).alias("id"),
        F.coalesce("title", _title("ml_risk", F.col("entity_id"))).alias("title"),
        F.coalesce("explanation", F.col("model_name")).alias("description"),
        priority_from_score(F.col("score")).alias("priority"),
        percent_text("score").alias("impact"),
        _owner("ml_risk"), F.lit("machine_learning_predictions").alias("source"))
    sc = M.executive_daily_kpis(cat)
    latest = sc.orderBy(F.col("order_date").desc()).limit(1)
    r = xdiv("stockout_positions", "snapshot_positions")
    stock_items = latest.where(r >= 0.05).select(
        F.lit(3).alias("_grp"), F.lit(0.0).alias("_k1"), F.lit("").alias("_k2"), F.lit("").alias("_k3"),
        F.lit("inventory-stockout-pressure").alias("id"), F.lit(FEED_TITLES["stockout_pressure"]).alias("title"),
        F.concat(F.col("stockout_positions").cast("string"), F.lit(" of "), F.col("snapshot_positions").cast("string"),
                 F.lit(" positions stocked out on latest scorecard day")).alias("description"),
        priority_from_score(r).alias("priority"), percent_text(r).alias("impact"), _owner("stockout_pressure"), F.lit("executive_scorecard").alias("source"))
    items = dq_items.unionByName(ml_items).unionByName(stock_items)
    order = [F.col("_grp"), F.col("_k1").asc_nulls_first(), F.col("_k2"), F.col("_k3")]
    return top_n(items, order, limit, "rank").drop("_grp", "_k1", "_k2", "_k3")


# Prediction tokens that mark an opportunity.
OPPORTUNITY_TOKENS = ("uplift", "propensity", "recommend", "opportunity", "growth", "cross_sell")


def k05_opportunities(cat: Catalog, limit: int | None = None) -> DataFrame:
    pred = ml_predictions(cat)
    model, label = F.lower("model_name"), F.lower("label")
    is_opp = any_of([model.contains(t) | label.contains(t) for t in OPPORTUNITY_TOKENS])
    s = F.coalesce("score", F.lit(0.0))
    ml_items = pred.where(is_opp).select(
        F.lit(1).alias("_grp"), (-s).alias("_k1"), F.col("entity_id").alias("_k2"),
        F.concat(F.lit("ml-opp-"), F.col("entity_id")).alias("id"),
        F.coalesce("title", _title("ml_opportunity", F.col("entity_id"))).alias("title"),
        F.coalesce("explanation", F.col("model_name")).alias("description"),
        F.col("estimated_impact").cast("string").alias("estimated_impact"),
        F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low").alias("priority"),
        F.lit("machine_learning_predictions").alias("source"))
    # margin trajectory over the latest 14 scorecard days (D1: latest, not oldest)
    sc = M.executive_daily_kpis(cat).where(F.col("margin_pct").isNotNull())
    last14 = sc.orderBy(F.col("order_date").desc()).limit(14)
    ends = last14.agg(F.count(F.lit(1)).alias("n"), F.min_by("margin_pct", "order_date").alias("m0"),
                      F.max_by("margin_pct", "order_date").alias("m1"))
    margin_item = ends.where((F.col("n") >= 4) & (F.col("m1") > F.col("m0"))).select(
        F.lit(2).alias("_grp"), F.lit(0.0).alias("_k1"), F.lit("").alias("_k2"), F.lit("margin-expansion").alias("id"),
        F.lit(FEED_TITLES["margin_expansion"]).alias("title"),
        F.lit(FEED_TITLES["margin_expansion_description"]).alias("description"),
        percent_text(F.col("m1") - F.col("m0")).alias("estimated_impact"),
        F.lit("medium").alias("priority"), F.lit("executive_scorecard").alias("source"))
    items = ml_items.unionByName(margin_item)
    return top_n(items, [F.col("_grp"), F.col("_k1"), F.col("_k2")], limit).drop("_grp", "_k1", "_k2")


# ============================================================ sales
def k06_sales_overview(cat: Catalog, date_from=None, date_to=None, region=None, category=None,
                       search=None) -> DataFrame:
    if category:  # D19: a real category filter needs line grain
        lines = M.fact_sales_line(cat).join(M.product_category_map(cat).select("product_id", "category_name"), "product_id", "left")
        lines = lines.where(_isin_ci("category_name", category))
        if region or search:  # by the same columns as the daily sales; online orders have no store
            st = cat.stores.select("store_id", "store_code", "store_name", "region_id")
            rg = cat.regions.select("region_id", "region_name")
            ch = cat.channels.select("channel_id", "channel_name")
            lines = lines.join(st, "store_id", "left").join(rg, "region_id", "left").join(ch, "channel_id")
            lines = _sales_summary_filter(lines, region, search)
        base = lines.groupBy("order_date", "order_id").agg(
            F.sum("line_net_amount").alias("net_sales"), F.sum("line_gross_profit").alias("gross_profit")) \
            .withColumn("order_count", F.lit(1))
    else:
        base = _sales_summary(cat, region, search)
    p = resolve_period(base, "order_date", date_from, date_to, default=cat.as_of)
    cur, pri = p.current("order_date"), p.prior("order_date")
    agg = base.agg(F.sum(F.when(cur, F.col("net_sales"))).alias("rev"),
                   F.sum(F.when(cur, F.col("gross_profit"))).alias("gp"),
                   F.sum(F.when(cur, F.col("order_count"))).alias("orders"),
                   F.sum(F.when(pri, F.col("net_sales"))).alias("prior_rev"),
                   F.count(F.when(cur, 1)).alias("n"))
    has = F.col("n") > 0
    growth = _growth(F.col("rev"), F.col("prior_rev"))
    aov, margin = ratio("rev", "orders", R6), ratio("gp", "rev", R6)
    return cards(agg, [
        ("revenue", "Revenue", F.when(has, _money(F.col("rev"))), growth, "currency", has),
        ("orders", "Orders", F.when(has, F.col("orders")), None, "number", has),
        ("aov", "Average Order Value", F.when(has, aov), None, "currency", has & aov.isNotNull()),
        ("gross_profit", "Gross Profit", F.when(has, _money(F.col("gp"))), None, "currency", has),
        ("profit_margin", "Profit Margin", F.when(has, margin), None, "percent", has & margin.isNotNull()),
        ("growth", "Growth", growth, growth, "percent", growth.isNotNull()),
    ])


def _sales_summary_filter(df, region, search):
    if region:
        df = df.where(F.col("region_name").isin(region))
    return _search(df, search, ["store_code", "store_name", "region_name", "channel_name"])


def k07_sales_trends(cat: Catalog, grain: str = "daily", date_from=None, date_to=None, region=None,
                     search=None) -> DataFrame:
    df = _sales_summary(cat, region, search)
    if date_from:
        df = df.where(F.col("order_date") >= F.lit(date_from))
    if date_to:
        df = df.where(F.col("order_date") <= F.lit(date_to))
    key = {"weekly": iso_week_key("order_date"), "monthly": month_key("order_date")}.get(
        grain, F.date_format("order_date", "yyyy-MM-dd"))
    return (df.groupBy(key.alias("period"))
            .agg(F.sum("net_sales").alias("revenue"), F.sum("order_count").alias("orders"),
                 F.sum("gross_profit").alias("profit")).orderBy("period"))


def _lines_with_category(cat) -> DataFrame:
    pcm = M.product_category_map(cat).select("product_id", "sku", "product_name", "category_name")
    return M.fact_sales_line(cat).select("order_id", "order_date", "store_id", "product_id", "quantity",
                                         "line_net_amount", "line_gross_profit").join(pcm, "product_id", "left")


def _line_period(cat, lines, date_from, date_to) -> Period:
    return resolve_period(lines, "order_date", date_from, date_to, default=cat.as_of)


def _region_filter_lines(cat, lines, region):
    if not region:
        return lines
    s = cat.stores.select("store_id", "region_id").join(cat.regions.select("region_id", "region_name"), "region_id")
    keep = s.where(F.col("region_name").isin(region)).select("store_id")
    return lines.join(keep, "store_id", "left_semi")


def k08_category_performance(cat: Catalog, date_from=None, date_to=None, region=None, category=None,
                             search=None) -> DataFrame:
    lines = _lines_with_category(cat).withColumn("category", F.coalesce("category_name", F.lit("Uncategorized")))
    lines = _region_filter_lines(cat, lines, region)  # D19
    if category:
        lines = lines.where(_isin_ci("category", category))
    if search:
        lines = lines.where(F.lower("category").contains(search.lower()))
    p = _line_period(cat, lines, date_from, date_to)
    cur, pri = p.current("order_date"), p.prior("order_date")
    per_order = lines.where(p.either("order_date")).groupBy("category", "order_id").agg(
        F.sum(F.when(cur, F.col("line_net_amount"))).alias("rev"),
        F.sum(F.when(cur, F.col("line_gross_profit"))).alias("gp"),
        F.sum(F.when(pri, F.col("line_net_amount"))).alias("prior_rev"),
        F.max(cur).alias("in_cur"))
    g = per_order.groupBy("category").agg(
        F.sum("rev").alias("revenue"), F.count(F.when(F.col("in_cur"), 1)).alias("orders"),
        F.sum("gp").alias("profit"), F.sum("prior_rev").alias("prior_rev")).where(F.col("orders") > 0)
    return g.select("category", _money(F.col("revenue")).alias("revenue"), F.col("orders").cast("double").alias("orders"),
                    _growth(F.col("revenue"), F.col("prior_rev")).alias("growth"),
                    ratio("profit", "revenue", R6).alias("margin")).orderBy(F.col("revenue").desc(), "category")


PRODUCT_SORTS = {"revenue": "revenue", "orders": "orders", "units": "units", "margin": "margin", "growth": "growth"}


def k09_product_performance(cat: Catalog, page: int = 1, page_size: int = 20, sort_by: str = "revenue",
                            sort_dir: str = "desc", search=None, columns=None, date_from=None, date_to=None,
                            category=None) -> DataFrame:
    lines = M.fact_sales_line(cat).select("order_id", "order_date", "product_id", "quantity", "line_net_amount", "line_gross_profit")
    if category or search:  # products are chosen first; their names come after the aggregation
        chosen = M.product_category_map(cat)
        if category:
            chosen = chosen.where(_isin_ci("category_name", category))
        if search:
            s = search.lower()
            chosen = chosen.where(F.lower(F.coalesce("product_name", F.col("product_id").cast("string"))).contains(s)
                                  | F.lower(F.coalesce("sku", F.lit(""))).contains(s))
        lines = lines.join(chosen.select("product_id"), "product_id", "left_semi")
    p = _line_period(cat, lines, date_from, date_to)
    cur, pri = p.current("order_date"), p.prior("order_date")
    per_order = lines.where(p.either("order_date")).groupBy("product_id", "order_id").agg(
        F.sum(F.when(cur, F.col("line_net_amount"))).alias("rev"),
        F.sum(F.when(cur, F.col("line_gross_profit"))).alias("gp"),
        F.sum(F.when(cur, F.col("quantity"))).alias("units"),
        F.sum(F.when(pri, F.col("line_net_amount"))).alias("prior_rev"), F.max(cur).alias("in_cur"))
    g = per_order.groupBy("product_id").agg(
        F.sum("rev").alias("revenue"), F.count(F.when(F.col("in_cur"), 1)).alias("orders"),
        F.sum("units").alias("units"), F.sum("gp").alias("profit"), F.sum("prior_rev").alias("prior_rev")
    ).where(F.col("orders") > 0)
    meta = M.product_category_map(cat).select("product_id", "product_name", "sku", "category_name")
    rows = g.join(meta, "product_id", "left").select(
        F.col("product_id").cast("string").alias("product_id"),
        F.coalesce("product_name", F.col("product_id").cast("string")).alias("product"), "sku",
        F.col("category_name").alias("category"), _money(F.col("revenue")).alias("revenue"),
        F.col("orders").cast("double").alias("orders"), F.col("units").cast("double").alias("units"),
        ratio("profit", "revenue", R6).alias("margin"), _growth(F.col("revenue"), F.col("prior_rev")).alias("growth"),
        F.col("product_id").alias("_pid"))
    if sort_by == "product":
        key = F.lower("product")
    else:
        key = F.coalesce(F.col(PRODUCT_SORTS.get(sort_by, "revenue")), F.lit(0))
    order = [key.desc() if sort_dir == "desc" else key.asc(), F.col("_pid").asc()]
    out = _paged(rows, order, page, page_size).drop("_pid")
    if columns:  # P13: unrequested fields become NULL, the product label is always kept
        keep = set(columns) | {"product", "total_items", "total_pages"}
        out = out.select(*[F.col(c) if c in keep else F.lit(None).cast(out.schema[c].dataType).alias(c)
                           for c in out.columns])
    return out


def k10_regional_performance(cat: Catalog, date_from=None, date_to=None, region=None, search=None) -> DataFrame:
    df = _sales_summary(cat, region, search)
    return _regional(df, resolve_period(df, "order_date", date_from, date_to, default=cat.as_of), with_profit=False)


def k11_top_customers(cat: Catalog, limit: int = 10, search=None) -> DataFrame:
    c = M.customer_360(cat)
    c = _search(c, search, ["customer_number", "customer_type", "loyalty_tier", "lifecycle_status"])
    top = c.orderBy(F.col("lifetime_net_sales").desc_nulls_last(), F.col("customer_id").asc()).limit(limit)
    return top.select(
        F.coalesce("customer_number", F.col("customer_id").cast("string"), F.lit("Unknown")).alias("customer"),
        F.col("customer_id").cast("string").alias("customer_id"), F.col("lifetime_net_sales").alias("revenue"),
        F.col("order_count").cast("double").alias("orders"), F.col("lifetime_net_sales").alias("lifetime_value"),
        F.col("lifetime_net_sales").isNotNull().alias("lifetime_value_available"))


# ============================================================ customers
def _customers(cat, region=None, segment=None, search=None) -> DataFrame:
    c = M.customer_360(cat)
    c = _search(c, search, ["customer_number", "customer_type", "loyalty_tier", "lifecycle_status"])
    s = cat.stores.select(F.col("store_id").alias("preferred_store_id"), "region_id")
    r = cat.regions.select("region_id", "region_name", "region_code")
    c = (c.join(s, "preferred_store_id", "left").join(B(r), "region_id", "left")
         .withColumn("region", F.when(F.col("preferred_store_id").isNull(), F.lit("Unknown")).otherwise(_region_name()))
         .drop("region_id", "region_code"))
    if segment:  # D18: the segment filter really filters
        seg = M.customer_rfm(cat).where(_isin_ci("rfm_segment", segment)).select("customer_id")
        c = c.join(seg, "customer_id", "left_semi")
    if region:
        c = c.where(_isin_ci("region", region))
    return c


def _is_active() -> Column:
    status = F.lower(F.coalesce("lifecycle_status", F.lit("")))
    return (status == "active") | (F.col("is_active") & ~status.isin("churn risk", "never purchased"))


def k12_customer_overview(cat: Catalog, date_from=None, date_to=None, region=None, segment=None,
                          search=None) -> DataFrame:
    c = _customers(cat, region, segment, search)
    p = make_period(date_to or cat.as_of, date_from)
    first = F.coalesce("first_order_date", "registration_date")
    base = F.col("first_order_date") < F.lit(p.start)
    agg = c.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(_is_active(), 1)).alias("active"),
        F.count(F.when(p.current(first), 1)).alias("new"), F.count(F.when(p.prior(first), 1)).alias("prior_new"),
        F.count(F.when(F.coalesce("order_count", F.lit(0)) > 1, 1)).alias("repeat"),
        F.round(xdiv(F.sum("lifetime_net_sales"), F.count("lifetime_net_sales")), 2).alias("avg_ltv"),
        # Retained customers are counted inside the base
        F.count(F.when(base, 1)).alias("base"),
        F.count(F.when(base & (F.col("last_order_date") >= F.lit(p.start)), 1)).alias("retained"),
        F.count(F.when(F.lower("lifecycle_status").isin("churn risk", "at risk"), 1)).alias("at_risk"))
    has = F.col("n") > 0
    growth = _growth(F.col("new"), F.col("prior_new"))
    retention, churn = ratio("retained", "base", R6), ratio("at_risk", "n", R6)
    return cards(agg, [
        ("active_customers", "Active Customers", F.when(has, F.col("active")), None, "number", has),
        ("new_customers", "New Customers", F.when(has, F.col("new")), F.when(has, growth), "number", has),
        ("repeat_customers", "Repeat Customers", F.when(has, F.col("repeat")), None, "number", has),
        ("avg_ltv", "Average Lifetime Value", F.col("avg_ltv"), None, "currency", F.col("avg_ltv").isNotNull()),
        ("retention_rate", "Retention Rate", retention, None, "percent", retention.isNotNull()),
        ("churn_risk_summary", "Churn Risk Summary", churn, None, "percent", churn.isNotNull()),
    ])


def k13_rfm_segments(cat: Catalog, date_from=None, date_to=None, segment=None, search=None) -> DataFrame:
    rfm = M.customer_rfm(cat)
    rfm = _search(rfm, search, ["rfm_segment"])
    if segment:
        rfm = rfm.where(_isin_ci("rfm_segment", segment))
    prof = M.customer_360(cat).select("customer_id", F.col("avg_order_value").alias("p_aov"),
                                      F.col("lifetime_net_sales").alias("p_ltv"), F.col("order_count").alias("p_orders"),
                                      F.col("last_order_date").alias("p_last"))
    p = make_period(date_to or cat.as_of, date_from)
    j = rfm.join(prof, "customer_id", "left")
    revenue = F.coalesce("lifetime_net_sales", "p_ltv", F.lit(0))  # D20: coalesce, not `or`
    orders = F.coalesce("order_count", "p_orders", F.lit(0))
    aov = F.coalesce(F.col("p_aov"), F.when(orders != 0, xdiv(revenue, orders)))
    last = F.coalesce("last_order_date", "p_last")
    g = j.groupBy(F.coalesce("rfm_segment", F.lit("Unknown")).alias("segment")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum(revenue).alias("revenue"),
        F.round(xdiv(F.sum(aov), F.count(aov)), R6).alias("average_order_value"),
        F.sum(F.when(p.current(last), revenue)).alias("cur_rev"), F.sum(F.when(p.prior(last), revenue)).alias("prior_rev"))
    return g.select("segment", F.col("customer_count").cast("double").alias("customer_count"),
                    _money(F.col("revenue")).alias("revenue"), "average_order_value",
                    F.when(F.col("cur_rev").isNotNull(), _growth(F.col("cur_rev"), F.col("prior_rev"))).alias("growth")
                    ).orderBy(F.col("revenue").desc(), "segment")


def k14_cohorts(cat: Catalog, date_from=None, date_to=None, region=None, segment=None, search=None,
                max_months: int = 6, max_cohorts: int | None = None) -> DataFrame:
    c = _customers(cat, region, segment, search).where(F.col("first_order_date").isNotNull())
    if date_from:
        c = c.where(F.col("first_order_date") >= F.lit(date_from))
    if date_to:
        c = c.where(F.col("first_order_date") <= F.lit(date_to))
    c = c.select(F.trunc("first_order_date", "MM").alias("cohort_start"), "last_order_date")
    if max_cohorts is not None:  # the latest cohorts: distinct months, top-N, broadcast back
        latest = c.select("cohort_start").distinct().orderBy(F.col("cohort_start").desc()).limit(max_cohorts)
        c = c.join(B(latest), "cohort_start")
    cells = c.select("cohort_start", "last_order_date",
                     F.explode(F.sequence(F.lit(0), F.lit(max_months - 1))).alias("month_offset"))
    still = F.col("last_order_date") >= F.add_months("cohort_start", F.col("month_offset"))
    g = cells.groupBy("cohort_start", "month_offset").agg(
        F.count(F.lit(1)).alias("cohort_size"), F.count(F.when(still, 1)).alias("customer_count"))
    return g.select(F.date_format("cohort_start", "yyyy-MM").alias("cohort"),
                    F.col("cohort_size").cast("double").alias("cohort_size"), "month_offset",
                    ratio("customer_count", "cohort_size", R6).alias("retention_pct"),
                    F.col("customer_count").cast("double").alias("customer_count")).orderBy("cohort", "month_offset")


def k15_customer_distribution(cat: Catalog, date_from=None, date_to=None, region=None, segment=None,
                              search=None) -> DataFrame:
    c = _customers(cat, region, segment, search)
    p = make_period(date_to or cat.as_of, date_from)
    first = F.coalesce("first_order_date", "registration_date")
    g = c.groupBy("region").agg(
        F.count(F.lit(1)).alias("customer_count"), F.sum(F.coalesce("lifetime_net_sales", F.lit(0))).alias("revenue"),
        F.count(F.when(p.current(first), 1)).alias("cur_new"), F.count(F.when(p.prior(first), 1)).alias("prior_new"))
    cur = F.when(F.col("cur_new") > 0, F.col("cur_new"))
    return g.select("region", F.col("customer_count").cast("double").alias("customer_count"),
                    _money(F.col("revenue")).alias("revenue"),
                    F.when(cur.isNotNull(), _growth(cur, F.col("prior_new"))).alias("growth")
                    ).orderBy(F.col("revenue").desc(), "region")


CUSTOMER_SORTS = {"lifetime_value": "lifetime_value", "orders": "orders", "average_order_value": "average_order_value"}


def k16_top_customers_detail(cat: Catalog, page: int = 1, page_size: int = 20, sort_by: str = "lifetime_value",
                             sort_dir: str = "desc", search=None, columns=None, region=None,
                             segment=None) -> DataFrame:
    c = _customers(cat, region, segment, search)
    seg = M.customer_rfm(cat).select("customer_id", F.col("rfm_segment").alias("segment"))
    rows = c.join(seg, "customer_id", "left").select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.coalesce("customer_number", F.col("customer_id").cast("string")).alias("customer"), "segment",
        F.when(F.col("preferred_store_id").isNotNull(), F.col("region")).alias("region"),
        F.col("lifetime_net_sales").alias("lifetime_value"), F.col("order_count").cast("double").alias("orders"),
        F.round("avg_order_value", R6).alias("average_order_value"), "lifecycle_status", "last_order_date",
        F.col("customer_id").alias("_cid"))
    if sort_by in ("customer", "segment"):
        key = F.lower(F.coalesce(sort_by, F.lit("")))
    else:
        key = F.coalesce(F.col(CUSTOMER_SORTS.get(sort_by, "lifetime_value")), F.lit(0))
    order = [key.desc() if sort_dir == "desc" else key.asc(), F.col("_cid").asc()]
    out = _paged(rows, order, page, page_size).drop("_cid")
    if columns:
        keep = set(columns) | {"customer", "total_items", "total_pages"}
        out = out.select(*[F.col(c) if c in keep else F.lit(None).cast(out.schema[c].dataType).alias(c)
                           for c in out.columns])
    return out


LEVELS = ("High", "Medium", "Low")


def k17_churn_risk(cat: Catalog, search=None, segment=None) -> DataFrame:
    """Customers by risk level from the predictions; where none of them matches, from the customers' lifecycle.

    The choice is part of the plan: each side is kept or dropped by the number of predictions that match.
    """
    pred = ml_predictions(cat).where(F.col("entity_type") == "customer")  # D6
    pred = _search(pred, search, ["model_name", "label", "entity_id"])
    model, label = F.lower("model_name"), F.lower("label")
    is_churn = model.contains("churn") | label.contains("churn") | model.contains("risk")
    pred = pred.where(is_churn | (F.col("score") >= 0.3))
    matched = pred.agg(F.count(F.lit(1)).alias("matched"))  # before the segment, which then may leave none
    if segment:
        seg = M.customer_rfm(cat).where(_isin_ci("rfm_segment", segment)).select(
            F.col("customer_id").cast("string").alias("entity_id"))
        pred = pred.join(seg, "entity_id", "left_semi")
    ltv = M.customer_360(cat).select(F.col("customer_id").cast("string").alias("entity_id"), "lifetime_net_sales")
    impact = F.coalesce(F.col("estimated_impact"), F.col("lifetime_net_sales"), F.lit(0))
    z = F.lit(0)
    by_score = pred.join(ltv, "entity_id", "left").groupBy(risk_level("score").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(impact).alias("rev"),
        F.round(xdiv(F.sum("confidence"), F.count("confidence")), R6).alias("confidence"))
    status = F.lower("lifecycle_status")
    by_life = _customers(cat, None, segment, search).groupBy(
        F.when(status == "churn risk", "High").when(status == "at risk", "Medium").otherwise("Low").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("lifetime_net_sales", z)).alias("rev"))
    levels = cat.spark.range(1).select(F.explode(F.array(*map(F.lit, LEVELS))).alias("risk_level"))
    scored = attach_scalars(levels.join(by_score, "risk_level", "left"), matched).where("matched > 0")
    known = by_life.agg(F.coalesce(F.sum("n"), z).alias("customers"))  # no customer: no rows
    lived = attach_scalars(attach_scalars(levels.join(by_life, "risk_level", "left"), matched), known).where("matched = 0 and customers > 0")
    n = F.coalesce("n", z)
    scored = scored.select("risk_level", n.cast("double").alias("customer_count"),
                           F.when(n > 0, _money(F.col("rev"))).alias("predicted_revenue_at_risk"), "confidence")
    lived = lived.select("risk_level", n.cast("double").alias("customer_count"),
                         F.when(F.col("risk_level") != "Low", _money(F.coalesce("rev", z))).alias("predicted_revenue_at_risk"),
                         F.lit(None).cast(scored.schema["confidence"].dataType).alias("confidence"))
    return scored.unionByName(lived).withColumn("confidence_available", F.col("confidence").isNotNull())


# ============================================================ operations
def _inventory(cat, category=None, search=None, region=None) -> DataFrame:
    inv = M.inventory_health(cat)
    inv = _search(inv, search, ["sku", "product_name", "category_name", "store_name", "dc_name"])
    if category:
        inv = inv.where(_isin_ci("category_name", category))
    if region:
        s = cat.stores.select("store_id", "region_id").join(cat.regions.select("region_id", "region_name"), "region_id")
        inv = inv.join(s.where(F.col("region_name").isin(region)).select("store_id"), "store_id", "left_semi")
    return inv


def _units_sold(cat, date_from=None, date_to=None, region=None) -> DataFrame:
    df = _sales_summary(cat, region, None)
    if date_from:
        df = df.where(F.col("order_date") >= F.lit(date_from))
    if date_to:
        df = df.where(F.col("order_date") <= F.lit(date_to))
    return df.agg(F.sum("units_sold").alias("sales_units"))


def _dated(df, col_name, date_from, date_to):
    if date_from:
        df = df.where(F.col(col_name) >= F.lit(date_from))
    if date_to:
        df = df.where(F.col(col_name) <= F.lit(date_to))
    return df


def k18_operations_overview(cat: Catalog, date_from=None, date_to=None, region=None, category=None, supplier=None,
                            search=None) -> DataFrame:
    inv = _inventory(cat, category, search, region).agg(
        F.sum("inventory_value_cost").alias("inv_value"), F.count(F.lit(1)).alias("n_inv"),
        F.count(F.when(F.lower("stock_status") == "healthy", 1)).alias("healthy"),
        F.sum("quantity_on_hand").alias("on_hand"))
    sup = M.supplier_performance(cat)
    if supplier:
        sup = sup.where(_isin_ci("supplier_name", supplier) | _isin_ci("supplier_code", supplier))
    sup = _search(sup, search, ["supplier_name", "supplier_code", "supplier_tier"]).agg(
        F.round(xdiv(F.sum("on_time_rate"), F.count("on_time_rate")), R6).alias("supplier_perf"))
    rets = _dated(M.fact_return_line(cat), "return_date", date_from, date_to).agg(
        F.sum("quantity_returned").alias("returned"))
    ship = _dated(M.shipment_performance(cat), "order_date", date_from, date_to)
    ok = (F.lower("delay_flag") == "on track") | F.lower("shipment_status").isin("delivered", "completed", "shipped")
    ship = ship.agg(F.count(F.lit(1)).alias("n_ship"), F.count(F.when(ok, 1)).alias("fulfilled"))
    from shelfwise.plans.business import one_row_join
    j = one_row_join(inv, sup, rets, ship, _units_sold(cat, date_from, date_to, region))
    has_inv = F.col("n_inv") > 0
    health = ratio("healthy", "n_inv", R6)
    turnover = ratio("sales_units", "on_hand", R6)
    ret_rate = F.when(F.col("returned").isNotNull(), ratio("returned", "sales_units", R6))
    fulfil = ratio("fulfilled", "n_ship", R6)
    return cards(j, [
        ("inventory_value", "Inventory Value", F.when(has_inv, _money(F.col("inv_value"))), None, "currency", has_inv),
        ("inventory_health", "Inventory Health", health, None, "percent", health.isNotNull()),
        ("stock_turnover", "Stock Turnover", turnover, None, "number", turnover.isNotNull()),
        ("supplier_performance", "Supplier Performance", F.col("supplier_perf"), None, "percent",
         F.col("supplier_perf").isNotNull()),
        ("return_rate", "Return Rate", ret_rate, None, "percent", ret_rate.isNotNull()),
        ("fulfillment_rate", "Fulfillment Rate", fulfil, None, "percent", fulfil.isNotNull()),
    ])


INVENTORY_SORTS = {"inventory_value": "inventory_value", "stock": "stock", "safety_stock": "safety_stock",
                   "turnover": "turnover"}


def k19_inventory(cat: Catalog, page: int = 1, page_size: int = 20, sort_by: str = "inventory_value",
                  sort_dir: str = "desc", search=None, columns=None, category=None, region=None) -> DataFrame:
    inv = _inventory(cat, category, search, region)
    tot = inv.agg(F.sum("quantity_on_hand").alias("total_on_hand"))
    # the reference's turnover is one global number for every row (sales units / total on hand)
    glob = attach_scalars(tot, _units_sold(cat, None, None, region)).select(
        ratio("sales_units", "total_on_hand", R6).alias("_turn"))
    rows = attach_scalars(inv, glob).select(
        F.coalesce("product_name", "sku", F.col("product_id").cast("string"), F.lit("Unknown")).alias("product"),
        F.col("product_id").cast("string").alias("product_id"), "sku", F.col("category_name").alias("category"),
        F.col("quantity_on_hand").cast("double").alias("stock"), F.col("reorder_point").cast("double").alias("safety_stock"),
        F.when(F.col("quantity_on_hand").isNotNull(), F.col("_turn")).alias("turnover"),
        F.col("inventory_value_cost").alias("inventory_value"), "stock_status", F.col("inventory_id").alias("_iid"))
    if sort_by in ("product", "category"):
        key = F.lower(F.coalesce(sort_by, F.lit("")))
    else:
        key = F.coalesce(F.col(INVENTORY_SORTS.get(sort_by, "inventory_value")), F.lit(0))
    order = [key.desc() if sort_dir == "desc" else key.asc(), F.col("_iid").asc()]
    out = _paged(rows, order, page, page_size).drop("_iid")
    if columns:
        keep = set(columns) | {"product", "total_items", "total_pages"}
        out = out.select(*[F.col(c) if c in keep else F.lit(None).cast(out.schema[c].dataType).alias(c)
                           for c in out.columns])
    return out


def k20_supplier_performance(cat: Catalog, supplier=None, search=None) -> DataFrame:
    sp = M.supplier_performance(cat)
    if supplier:
        sp = sp.where(_isin_ci("supplier_name", supplier) | _isin_ci("supplier_code", supplier))
    sp = _search(sp, search, ["supplier_name", "supplier_code", "supplier_tier"])
    q = F.col("reliability_score")
    quality = F.when(q > 1, q / 100).otherwise(q)
    on_time = F.round("on_time_rate", R6)
    return sp.select(
        F.coalesce("supplier_name", "supplier_code", F.lit("Unknown")).alias("supplier"),
        F.col("supplier_id").cast("string").alias("supplier_id"), on_time.alias("on_time_pct"),
        F.round(quality, R6).alias("quality_score"),
        F.round(F.coalesce("avg_actual_lead_time_days", "contracted_lead_time_days"), R6).alias("lead_time"),  # D20
        F.col("units_ordered").cast("double").alias("purchase_volume"),
        supplier_risk(on_time, quality).alias("risk_level"), F.col("supplier_id").alias("_sid")
    ).orderBy(F.coalesce(on_time, F.lit(0)).desc(), "_sid").drop("_sid")


def k21_returns_by_category(cat: Catalog, date_from=None, date_to=None, category=None, search=None) -> DataFrame:
    pcm = M.product_category_map(cat).select("product_id", "category_name")
    r = M.fact_return_line(cat).join(pcm, "product_id", "left").withColumn(
        "category", F.coalesce("category_name", F.lit("Uncategorized")))
    if category:
        r = r.where(_isin_ci("category", category))
    if search:
        r = r.where(F.lower("category").contains(search.lower()))
    p = resolve_period(r, "return_date", date_from, date_to, default=cat.as_of)
    cur, pri = p.current("return_date"), p.prior("return_date")
    sums = {"cnt": F.when(cur, F.col("quantity_returned")), "cost": F.when(cur, F.col("refund_line_amount")),
            "prior_cnt": F.when(pri, F.col("quantity_returned")), "n": F.when(cur, F.lit(1))}
    lines = M.fact_return_line(cat) if not (category or search) else r
    by_product = lines.groupBy("product_id").agg(*(F.sum(v).alias(k) for k, v in sums.items()))  # before the categories are joined
    g = (by_product.join(pcm, "product_id", "left").groupBy(F.coalesce("category_name", F.lit("Uncategorized")).alias("category"))
         .agg(*(F.sum(k).alias(k) for k in sums)).where(F.col("n") > 0))
    total = F.sum("cnt").over(Window.partitionBy())  # categories: bounded by the hierarchy
    return g.select("category", F.col("cnt").cast("double").alias("return_count"),
                    ratio(F.col("cnt"), total, R6).alias("return_pct"), _money(F.col("cost")).alias("return_cost"),
                    trend_label(_growth(F.col("cnt"), F.col("prior_cnt"))).alias("trend")
                    ).orderBy(F.col("return_count").desc(), "category")


def k22_warehouse_performance(cat: Catalog, date_from=None, date_to=None, region=None, search=None) -> DataFrame:
    inv = _inventory(cat, None, None, region).withColumn(
        "warehouse", F.coalesce("dc_name", "store_name", F.lit("Unknown")))
    if search:
        inv = inv.where(F.lower("warehouse").contains(search.lower()))
    inv = inv.groupBy("warehouse").agg(
        F.sum(F.coalesce("inventory_value_cost", F.lit(0))).alias("inventory"),
        F.count(F.when(F.lower("stock_status") == "stockout", 1)).alias("stockouts"))
    sh = _dated(M.shipment_performance(cat), "order_date", date_from, date_to).withColumn(
        "warehouse", F.coalesce("dc_name", "dc_code", F.lit("Unknown")))
    if search:
        sh = sh.where(F.lower("warehouse").contains(search.lower()))
    sh = sh.groupBy("warehouse").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.lower("delay_flag") == "on track", 1)).alias("fulfilled"),
        F.round(xdiv(F.sum("fulfillment_lead_time_days"), F.count("fulfillment_lead_time_days")), R6).alias("lead"))
    j = inv.join(sh, "warehouse", "full_outer")  # J13
    return j.select("warehouse", _money(F.col("inventory")).alias("inventory"),
                    ratio("fulfilled", "total", R6).alias("fulfillment"),
                    F.col("stockouts").cast("double").alias("stockouts"),
                    F.col("lead").alias("average_processing_time")).orderBy("warehouse")


def k23_operational_risks(cat: Catalog, category=None, supplier=None, search=None, limit: int | None = None,
                          return_categories: int | None = None) -> DataFrame:
    """``return_categories`` keeps the rising categories with most returns (all of them by default)."""
    inv = _inventory(cat, category, search, None).agg(
        F.count(F.when(F.lower("stock_status") == "stockout", 1)).alias("so"),
        F.count(F.when(F.lower("stock_status") == "below reorder", 1)).alias("below"))
    stock = inv.where(F.col("so") > 0).select(
        F.lit(1).alias("_grp"), F.lit("").alias("_k"),
        F.concat(F.col("so").cast("string"), F.lit(" stockout positions")).alias("risk"),
        F.when(F.col("so") >= 10, "critical").otherwise("high").alias("severity"),
        _owner("stockouts"), _advice("stockouts"))
    below = inv.where(F.col("below") > 0).select(
        F.lit(2).alias("_grp"), F.lit("").alias("_k"),
        F.concat(F.col("below").cast("string"), F.lit(" SKUs below reorder point")).alias("risk"),
        F.lit("medium").alias("severity"), _owner("below_reorder"), _advice("below_reorder"))
    sp = M.supplier_performance(cat)
    if supplier:
        sp = sp.where(_isin_ci("supplier_name", supplier) | _isin_ci("supplier_code", supplier))
    sp = _search(sp, search, ["supplier_name", "supplier_code", "supplier_tier"])
    sup = sp.where(F.col("on_time_rate") < 0.7).select(
        F.lit(3).alias("_grp"), F.col("supplier_code").alias("_k"),
        F.concat(F.lit("Low on-time delivery: "), F.coalesce("supplier_name", F.lit("Supplier"))).alias("risk"),
        F.when(F.col("on_time_rate") < 0.5, "high").otherwise("medium").alias("severity"),
        _owner("supplier_on_time"), _advice("supplier_on_time"))
    rising = k21_returns_by_category(cat, category=category, search=search).where(F.col("trend") == "up")
    if return_categories is not None:
        rising = rising.orderBy(F.col("return_count").desc(), "category").limit(return_categories)
    rets = rising.select(
        F.lit(4).alias("_grp"), F.col("category").alias("_k"),
        F.concat(F.lit("Rising returns in "), F.col("category")).alias("risk"), F.lit("medium").alias("severity"),
        _owner("rising_returns"), _advice("rising_returns"))
    u = stock.unionByName(below).unionByName(sup).unionByName(rets)
    return top_n(u, [F.col("_grp"), F.col("_k")], limit).drop("_grp", "_k")


# ============================================================ finance
def _refunds_by_date(cat) -> DataFrame:
    """Refunds by return date from the returns fact (not from sales days)."""
    return M.fact_return_line(cat).select(F.col("return_date").alias("order_date"),
                                          F.col("refund_line_amount").alias("refund"))


def k24_finance_overview(cat: Catalog, date_from=None, date_to=None, region=None, search=None) -> DataFrame:
    s = _sales_summary(cat, region, search)
    p = resolve_period(s, "order_date", date_from, date_to, default=cat.as_of)
    cur = p.current("order_date")
    sales = s.agg(F.sum(F.when(cur, F.col("net_sales"))).alias("rev"), F.sum(F.when(cur, F.col("gross_profit"))).alias("gp"),
                  F.sum(F.when(cur, F.col("cogs_amount"))).alias("cogs"),
                  F.sum(F.when(cur, F.col("discount_amount"))).alias("disc"), F.count(F.when(cur, 1)).alias("n"))
    ref = _refunds_by_date(cat).agg(F.sum(F.when(cur, F.col("refund"))).alias("refunds"))
    from shelfwise.plans.business import one_row_join
    j = one_row_join(sales, ref)
    has = F.col("n") > 0
    refunds = F.coalesce("refunds", F.lit(0))
    opcost = F.when(has, F.col("cogs") + F.col("disc") + refunds)
    net = F.when(has, F.col("gp") - refunds)
    margin = F.when(has, ratio("gp", "rev", R6))
    cost_ratio = ratio(opcost, F.col("rev"), R6)
    return cards(j, [
        ("revenue", "Revenue", F.when(has, _money(F.col("rev"))), None, "currency", has),
        ("gross_profit", "Gross Profit", F.when(has, _money(F.col("gp"))), None, "currency", has),
        ("net_profit", "Net Profit", _money(net), None, "currency", net.isNotNull()),
        ("profit_margin", "Profit Margin", margin, None, "percent", margin.isNotNull()),
        ("operating_cost", "Operating Cost", _money(opcost), None, "currency", opcost.isNotNull()),
        ("cost_ratio", "Cost Ratio", cost_ratio, None, "percent", cost_ratio.isNotNull()),
    ])


def k25_profitability_by_region(cat: Catalog, date_from=None, date_to=None, region=None, search=None) -> DataFrame:
    s = _sales_summary(cat, region, None).withColumn("region", _region_name())
    if search:
        s = s.where(F.lower("region").contains(search.lower()))
    p = resolve_period(s, "order_date", date_from, date_to, default=cat.as_of)
    cur, pri = p.current("order_date"), p.prior("order_date")
    g = s.groupBy("region").agg(
        F.sum(F.when(cur, F.col("net_sales"))).alias("revenue"), F.sum(F.when(cur, F.col("cogs_amount"))).alias("cost"),
        F.sum(F.when(cur, F.col("gross_profit"))).alias("profit"),
        F.sum(F.when(pri, F.col("net_sales"))).alias("prior_rev"), F.count(F.when(cur, 1)).alias("n")
    ).where(F.col("n") > 0)
    return g.select("region", _money(F.col("revenue")).alias("revenue"), _money(F.col("cost")).alias("cost"),
                    _money(F.col("profit")).alias("profit"), ratio("profit", "revenue", R6).alias("margin"),
                    _growth(F.col("revenue"), F.col("prior_rev")).alias("growth")
                    ).orderBy(F.col("profit").desc(), "region")


COST_CATEGORIES = ("COGS", "Discounts", "Refunds")


def k26_cost_breakdown(cat: Catalog, date_from=None, date_to=None, region=None, cost_category=None,
                       search=None) -> DataFrame:
    s = _sales_summary(cat, region, None)
    p = resolve_period(s, "order_date", date_from, date_to, default=cat.as_of)
    cur, pri = p.current("order_date"), p.prior("order_date")
    sales = s.agg(F.sum(F.when(cur, F.col("cogs_amount"))).alias("c_cogs"),
                  F.sum(F.when(pri, F.col("cogs_amount"))).alias("p_cogs"),
                  F.sum(F.when(cur, F.col("discount_amount"))).alias("c_disc"),
                  F.sum(F.when(pri, F.col("discount_amount"))).alias("p_disc"))
    ref = _refunds_by_date(cat).agg(F.sum(F.when(cur, F.col("refund"))).alias("c_ref"),
                                    F.sum(F.when(pri, F.col("refund"))).alias("p_ref"))
    from shelfwise.plans.business import one_row_join
    j = one_row_join(sales, ref)
    z = F.lit(0)
    items = F.array(*[F.struct(F.lit(n).alias("cost_category"), F.coalesce(c, z).alias("amount"),
                               F.coalesce(pcol, z).alias("prior"))
                      for n, c, pcol in (("COGS", F.col("c_cogs"), F.col("p_cogs")),
                                         ("Discounts", F.col("c_disc"), F.col("p_disc")),
                                         ("Refunds", F.col("c_ref"), F.col("p_ref")))])
    rows = j.select(F.inline(items))
    total = F.sum("amount").over(Window.partitionBy())  # three rows
    rows = rows.withColumn("total", total).where(F.col("total") > 0)
    if cost_category:
        rows = rows.where(_isin_ci("cost_category", cost_category))
    if search:
        rows = rows.where(F.lower("cost_category").contains(search.lower()))
    return rows.select("cost_category", _money(F.col("amount")).alias("amount"),
                       ratio("amount", "total", R6).alias("percentage"),
                       trend_label(_growth(F.col("amount"), F.col("prior"))).alias("trend")
                       ).orderBy(F.col("amount").desc(), "cost_category")


def k27_cashflow(cat: Catalog, date_from=None, date_to=None, region=None) -> DataFrame:
    pay = _dated(M.payment_mix(cat), "payment_month", date_from, date_to)
    sales = _dated(_sales_summary(cat, region, None), "order_date", date_from, date_to)
    inflow_pay = pay.groupBy(month_key("payment_month").alias("period")).agg(F.sum("payment_amount").alias("inflows"))
    by_month = sales.groupBy(month_key("order_date").alias("period")).agg(
        F.sum(F.col("cogs_amount") + F.col("discount_amount")).alias("out_sales"),
        F.sum("gross_profit").alias("profit"), F.sum("net_sales").alias("revenue"))
    sc = _dated(M.executive_daily_kpis(cat), "order_date", date_from, date_to)
    ref = sc.groupBy(month_key("order_date").alias("period")).agg(F.sum("refund_amount").alias("out_ref"))
    # payments present -> they are the inflows; otherwise net sales (decided inside the plan)
    has_pay = inflow_pay.agg((F.count(F.lit(1)) > 0).alias("has_pay"))
    j = attach_scalars(by_month.join(ref, "period", "full_outer").join(inflow_pay, "period", "full_outer"), has_pay)
    z = F.lit(0)
    inflows = F.when(F.col("has_pay"), F.coalesce("inflows", z)).otherwise(F.coalesce("revenue", z))
    outflows = F.coalesce("out_sales", z) + F.coalesce("out_ref", z)
    return j.select("period", _money(inflows).alias("inflows"), _money(outflows).alias("outflows"),
                    _money(inflows - outflows).alias("net_cashflow"), _money(F.col("profit")).alias("profit"),
                    F.when(F.col("profit").isNotNull(), ratio("profit", "revenue", R6)).alias("margin")
                    ).orderBy("period")


def k29_budget_variance(cat: Catalog, department=None, search=None) -> DataFrame:
    c = M.campaign_performance(cat).withColumn(
        "department", F.coalesce("campaign_type", "objective_code", F.lit("Unassigned")))
    if department:
        c = c.where(_isin_ci("department", department))
    if search:
        s = search.lower()
        c = c.where(F.lower("department").contains(s) | F.lower(F.coalesce("campaign_name", F.lit(""))).contains(s))
    z = F.lit(0)
    g = c.groupBy("department").agg(F.sum(F.coalesce("budget_amount", z)).alias("budget"),
                                    F.sum(F.coalesce("actual_spend", z)).alias("actual"))
    var = F.col("actual") - F.col("budget")
    return g.select("department", _money(F.col("budget")).alias("budget"), _money(F.col("actual")).alias("actual"),
                    _money(var).alias("variance"), ratio(var, F.col("budget"), R6).alias("variance_pct")
                    ).orderBy(F.col("actual").desc(), "department")


def k28_financial_risks(cat: Catalog, region=None, department=None, search=None, limit: int | None = None) -> DataFrame:
    prof = k25_profitability_by_region(cat, region=region, search=search)
    low = prof.where(F.col("margin") < 0.15).select(
        F.lit(1).alias("_grp"), F.col("region").alias("_k"), F.lit(0).alias("_sub"),
        F.concat(F.lit("Low margin in "), F.col("region")).alias("risk"),
        F.when(F.col("margin") < 0.05, "high").otherwise("medium").alias("severity"),
        F.col("profit").alias("estimated_impact"), _owner("low_margin"), _advice("low_margin"))
    contraction = prof.where(F.col("growth") < -0.1).select(
        F.lit(1).alias("_grp"), F.col("region").alias("_k"), F.lit(1).alias("_sub"),
        F.concat(F.lit("Revenue contraction in "), F.col("region")).alias("risk"), F.lit("high").alias("severity"),
        F.col("revenue").alias("estimated_impact"), _owner("contraction"), _advice("contraction"))
    costs = k26_cost_breakdown(cat, region=region, search=search)
    rising = costs.where((F.col("trend") == "up") & (F.coalesce("percentage", F.lit(0)) >= 0.3)).select(
        F.lit(2).alias("_grp"), F.col("cost_category").alias("_k"), F.lit(0).alias("_sub"),
        F.concat(F.lit("Rising "), F.col("cost_category"), F.lit(" share")).alias("risk"), F.lit("medium").alias("severity"),
        F.col("amount").alias("estimated_impact"), _owner("rising_cost"),
        _title_text(RISK_TEXT["rising_cost"][1], F.col("cost_category")).alias("recommendation"))
    budget = k29_budget_variance(cat, department=department, search=search)
    over = budget.where(F.col("variance_pct") > 0.1).select(
        F.lit(3).alias("_grp"), F.col("department").alias("_k"), F.lit(0).alias("_sub"),
        F.concat(F.lit("Budget overrun: "), F.col("department")).alias("risk"),
        F.when(F.col("variance_pct") > 0.25, "critical").otherwise("high").alias("severity"),
        F.col("variance").alias("estimated_impact"), _owner("budget_overrun"), _advice("budget_overrun"))
    ov = k24_finance_overview(cat, region=region, search=search).where(
        (F.col("metric_id") == "profit_margin") & F.col("available") & (F.col("value") < 0.2))
    ent = ov.select(
        F.lit(4).alias("_grp"), F.lit("").alias("_k"), F.lit(0).alias("_sub"),
        F.lit("Enterprise margin below 20%").alias("risk"), F.lit("medium").alias("severity"),
        F.lit(None).cast("decimal(38,2)").alias("estimated_impact"), _owner("enterprise_margin"),
        _advice("enterprise_margin"))
    u = reduce(DataFrame.unionByName, [low, contraction, rising, over, ent])
    if search:  # of all that the searched figures give, the risks whose text holds it
        u = u.where(F.lower("risk").contains(search.lower()))
    return top_n(u, [F.col("_grp"), F.col("_k"), F.col("_sub")], limit).drop("_grp", "_k", "_sub")


KPIS = {
    "k01_dashboard_overview": k01_dashboard_overview, "k02_dashboard_trends": k02_dashboard_trends,
    "k03_dashboard_regional": k03_dashboard_regional, "k04_top_risks": k04_top_risks,
    "k05_opportunities": k05_opportunities, "k06_sales_overview": k06_sales_overview,
    "k07_sales_trends": k07_sales_trends, "k08_category_performance": k08_category_performance,
    "k09_product_performance": k09_product_performance, "k10_regional_performance": k10_regional_performance,
    "k11_top_customers": k11_top_customers, "k12_customer_overview": k12_customer_overview,
    "k13_rfm_segments": k13_rfm_segments, "k14_cohorts": k14_cohorts,
    "k15_customer_distribution": k15_customer_distribution, "k16_top_customers_detail": k16_top_customers_detail,
    "k17_churn_risk": k17_churn_risk, "k18_operations_overview": k18_operations_overview,
    "k19_inventory": k19_inventory, "k20_supplier_performance": k20_supplier_performance,
    "k21_returns_by_category": k21_returns_by_category, "k22_warehouse_performance": k22_warehouse_performance,
    "k23_operational_risks": k23_operational_risks, "k24_finance_overview": k24_finance_overview,
    "k25_profitability_by_region": k25_profitability_by_region, "k26_cost_breakdown": k26_cost_breakdown,
    "k27_cashflow": k27_cashflow, "k28_financial_risks": k28_financial_risks,
    "k29_budget_variance": k29_budget_variance,
}

__all__ = ["KPIS", "cards", "make_period"]
