"""Registry of every operator exposed as a query: name -> fn(catalog) -> DataFrame.

``present`` fixes the output convention used by the correctness gate:
DECIMAL -> DOUBLE (after rounding in DECIMAL), small integers -> BIGINT,
dates stay DATE, timestamps stay TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.plans import business, kpis, marts, predictions, quality, table_functions, views
from shelfwise.sources.catalog import Catalog


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _m05(cat):
    return marts.customer_360(cat).withColumn("avg_order_value", F.round("avg_order_value", 6))


def _m09(cat):
    return (marts.supplier_performance(cat)
            .withColumn("on_time_rate", F.round("on_time_rate", 6))
            .withColumn("avg_actual_lead_time_days", F.round("avg_actual_lead_time_days", 6)))


def _fn2(cat):
    lo, _ = table_functions.order_date_bounds(cat)
    return table_functions.store_performance(cat, lo, cat.as_of)


def _fn4(cat):
    lo, _ = table_functions.order_date_bounds(cat)
    return table_functions.category_contribution(cat, lo, cat.as_of)


def _fn5(cat):
    import datetime as dt
    return table_functions.executive_scorecard(cat, cat.as_of - dt.timedelta(days=364), cat.as_of)


def build_registry() -> dict[str, Callable[[Catalog], DataFrame]]:
    reg: dict[str, Callable[[Catalog], DataFrame]] = {}
    reg.update(views.VIEWS)
    reg.update(marts.MARTS_BASIC)
    reg["m05"], reg["m09"] = _m05, _m09
    reg["m14"] = predictions.ml_predictions
    reg["m15"] = quality.data_quality_summary
    reg.update(business.QUERIES)
    reg["fn1_monthly_revenue"] = table_functions.monthly_revenue
    reg["fn2_store_performance"] = _fn2
    reg["fn3_customer_rfm_asof"] = table_functions.customer_rfm_asof
    reg["fn4_category_contribution"] = _fn4
    reg["fn5_executive_scorecard"] = _fn5
    reg.update(kpis.KPIS)
    # parameter paths of the roll-ups (filters, grains, sort keys, pages)
    import datetime as _dt
    reg["k06_sales_overview_filtered"] = lambda cat: kpis.k06_sales_overview(cat, region=["ASIA", "EUROPE"],
                                                                             search="NATION_2")
    reg["k07_sales_trends_monthly"] = lambda cat: kpis.k07_sales_trends(
        cat, grain="monthly", date_from=_dt.date(1998, 1, 1), date_to=_dt.date(2000, 12, 31))
    reg["k08_category_performance_filtered"] = lambda cat: kpis.k08_category_performance(cat, category=["SMALL",
                                                                                                         "large"])
    reg["k09_product_performance_margin_p2"] = lambda cat: kpis.k09_product_performance(
        cat, page=2, page_size=25, sort_by="margin", sort_dir="asc")
    reg["k16_top_customers_detail_orders_p3"] = lambda cat: kpis.k16_top_customers_detail(
        cat, page=3, page_size=50, sort_by="orders", sort_dir="asc")
    reg["k13_rfm_segments_filtered"] = lambda cat: kpis.k13_rfm_segments(cat, segment=["Champions", "loyal"])
    reg["k14_cohorts_3m"] = lambda cat: kpis.k14_cohorts(cat, max_months=3)
    reg["k19_inventory_by_product_p2"] = lambda cat: kpis.k19_inventory(cat, page=2, page_size=30, sort_by="product",
                                                                        sort_dir="asc")
    reg["k21_returns_by_category_filtered"] = lambda cat: kpis.k21_returns_by_category(cat, category=["SMALL", "medium"])
    reg["k17_churn_risk_champions"] = lambda cat: kpis.k17_churn_risk(cat, segment=["Champions"])
    reg["k06_sales_overview_category_search"] = lambda cat: kpis.k06_sales_overview(cat, category=["SMALL", "large"], search="web")
    reg["k07_sales_trends_weekly"] = lambda cat: kpis.k07_sales_trends(cat, grain="weekly")
    reg["k17_churn_risk_lifecycle"] = lambda cat: kpis.k17_churn_risk(cat, search="gold")
    reg["k28_financial_risks_search"] = lambda cat: kpis.k28_financial_risks(cat, search="cogs")
    reg["k22_warehouse_performance_search"] = lambda cat: kpis.k22_warehouse_performance(cat, search="NATION_1")
    reg.update(_sql_function_entries())
    reg.update(_viewquery_entries())
    reg.update(_integrity_entries())
    return reg


def _sql_function_entries():
    """The SQL table functions, called through ``spark.sql`` on the same catalog."""
    import datetime as dt

    from shelfwise.plans import sql_functions as SQ

    def run(cat, sql_text):
        SQ.install(cat)
        return cat.spark.sql(sql_text)

    def bounds(cat):
        lo, _ = table_functions.order_date_bounds(cat)
        return lo.isoformat(), cat.as_of.isoformat()

    return {
        "fn1_monthly_revenue_sql": lambda cat: run(cat, "SELECT * FROM fn_monthly_revenue()"),
        "fn2_store_performance_sql": lambda cat: run(
            cat, "SELECT * FROM fn_store_performance(DATE'{}', DATE'{}')".format(*bounds(cat))),
        "fn4_category_contribution_sql": lambda cat: run(
            cat, "SELECT * FROM fn_category_contribution(DATE'{}', DATE'{}')".format(*bounds(cat))),
        "fn5_executive_scorecard_sql": lambda cat: run(
            cat, "SELECT * FROM fn_executive_scorecard(DATE'{}', DATE'{}')".format(
                (cat.as_of - dt.timedelta(days=364)).isoformat(), cat.as_of.isoformat())),
    }


def _viewquery_entries():
    from shelfwise.operators import viewquery as VQ
    page_q = VQ.ViewQuery(page=2, page_size=50, sort_by="net_sales", sort_dir="desc", search="NATION_1",
                          filters=(VQ.FilterClause("channel_name", "in", ("Store Express", "Store Standard")),))
    cust_q = VQ.ViewQuery(filters=(VQ.FilterClause("lifecycle_status", "in", ("Active", "At Risk")),))
    ys = {"revenue": "net_sales", "profit": "gross_profit", "orders": "order_count"}
    import datetime as dt
    dated_q = VQ.ViewQuery(date_from=dt.date(1998, 1, 1), date_to=dt.date(1999, 12, 31), date_column="first_order_date",
                           sort_by="last_order_date", sort_dir="asc", page_size=100,
                           columns=("customer_id", "customer_number", "first_order_date", "last_order_date",
                                    "lifetime_net_sales"))
    return {
        "vq1_view_query_dated": lambda cat: VQ.view_query(cat, "customer_360", dated_q).rows,
        "vq1_view_query_page": lambda cat: VQ.view_query(cat, "sales_summary", page_q).rows,
        "vq1_view_query_total": lambda cat: VQ.view_query(cat, "sales_summary", page_q).total,
        "vq2_summarize": lambda cat: VQ.summarize(cat, "customer_360", cust_q, [
            "lifetime_net_sales", "lifetime_gross_profit", "order_count", "lifetime_units"]),
        "vq3_kpi_cards_sales": lambda cat: VQ.kpi_cards(cat, "sales"),
        "vq3_kpi_cards_finance": lambda cat: VQ.kpi_cards(cat, "finance"),
        "vq3_kpi_cards_customer": lambda cat: VQ.kpi_cards(cat, "customer"),
        "vq4_time_series": lambda cat: VQ.time_series(cat, "executive_scorecard", "order_date", ys)
        .select("series", "x", "y"),
    }


def _integrity_entries():
    from shelfwise.operators import integrity as IC
    return {
        "c1_c2_keys": lambda cat: IC.check_summary(cat, kinds=("not_null", "unique")),
        "c3_foreign_keys": lambda cat: IC.check_summary(cat, kinds=("foreign_key",)),
        "c4_c5_domains_ranges": lambda cat: IC.check_summary(cat, kinds=("domain", "range")),
        "c6_c7_row_checks": lambda cat: IC.check_summary(cat, kinds=("row",)),
    }


REGISTRY = build_registry()
