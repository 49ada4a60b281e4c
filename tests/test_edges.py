"""Threshold and NULL edges on small hand-made catalogs."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import D, day, make_catalog
from shelfwise.plans import business as Q
from shelfwise.plans import marts as M
from shelfwise.plans.predictions import ml_predictions
from shelfwise.plans.quality import data_quality_summary

AS_OF = day("2024-06-30")


def _order(oid, cust, d, status="Completed", store=None, channel=1, campaign=None):
    return {"order_id": oid, "order_number": f"O{oid}", "customer_id": cust, "store_id": store, "channel_id": channel,
            "order_date": d, "order_timestamp": dt.datetime.combine(d, dt.time()), "order_status": status,
            "currency_code": "USD", "gross_amount": D("10.00"), "discount_amount": D("0.00"), "net_amount": D("10.00"),
            "total_amount": D("10.00"), "campaign_id": campaign, "updated_at": dt.datetime(2024, 6, 30)}


def _line(iid, oid, pid=1, net="10.00", cogs="4.00", qty=1, promo=None):
    return {"order_item_id": iid, "order_id": oid, "line_number": 1, "product_id": pid, "quantity": qty,
            "unit_price": D(net), "unit_cost": D(cogs), "discount_amount": D("0.00"), "line_gross_amount": D(net),
            "line_net_amount": D(net), "line_cogs_amount": D(cogs), "promotion_id": promo, "is_gift": False}


def _customers(n):
    return [{"customer_id": i, "customer_number": f"C{i}", "customer_type": "Guest", "registration_date": day("2020-01-01"),
             "is_active": True, "email_hash": None if i == 1 else "x", "updated_at": dt.datetime(2024, 6, 30)}
            for i in range(1, n + 1)]


def lifecycle_catalog(spark):
    days_ago = {1: 0, 2: 90, 3: 91, 4: 180, 5: 181}
    orders, lines, oid = [], [], 0
    for cust, ago in days_ago.items():
        for extra in (0, 400):  # two orders each; the second is older
            oid += 1
            orders.append(_order(oid, cust, AS_OF - dt.timedelta(days=ago + extra)))
            lines.append(_line(oid, oid))
    oid += 1
    orders.append(_order(oid, 6, AS_OF - dt.timedelta(days=10)))  # one order only
    lines.append(_line(oid, oid))
    return make_catalog(spark, {"customers": _customers(7), "orders": orders, "order_items": lines,
                                "loyalty_accounts": []}, as_of=AS_OF)


def test_lifecycle_thresholds(spark):
    c = M.customer_360(lifecycle_catalog(spark))
    got = {r.customer_id: (r.lifecycle_status, r.days_since_last_order) for r in c.collect()}
    assert got == {1: ("Active", 0), 2: ("Active", 90), 3: ("At Risk", 91), 4: ("At Risk", 180),
                   5: ("Churn Risk", 181), 6: ("One-Time", 10), 7: ("Never Purchased", None)}


def test_avg_order_value_is_line_weighted(spark):
    orders = [_order(1, 1, day("2024-06-01")), _order(2, 1, day("2024-06-02"))]
    orders[1]["net_amount"] = D("30.00")
    lines = [_line(1, 1), _line(2, 2), _line(3, 2)]
    cat = make_catalog(spark, {"customers": _customers(1), "orders": orders, "order_items": lines,
                               "loyalty_accounts": []}, as_of=AS_OF)
    r = M.customer_360(cat).first()
    assert float(r.avg_order_value) == (10 + 30 + 30) / 3  # weighted by lines (D8)
    assert r.order_count == 2


def test_margin_loss_and_zero_net(spark):
    orders = [_order(1, 1, day("2024-06-01"))]
    lines = [_line(1, 1, net="10.00", cogs="12.00"), _line(2, 1, net="0.00", cogs="1.00")]
    cal = [{"date_id": 20240601, "full_date": day("2024-06-01"), "year_number": 2024, "month_number": 6,
            "quarter_number": 2, "month_name": "June", "week_of_year": 22, "season_name": "Summer",
            "is_weekend": True, "is_holiday": False}]
    cat = make_catalog(spark, {"orders": orders, "order_items": lines, "calendar_date": cal})
    got = {r.order_item_id: r.line_margin_pct for r in M.fact_sales_line(cat).collect()}
    assert float(got[1]) == -0.2 and got[2] is None


def test_delay_flags(spark):
    base = day("2024-06-01")
    cases = {1: (None, None), 2: (5, 3), 3: (6, 1), 4: (2, 7), 5: (2, 8), 6: (2, None)}
    ships, orders = [], []
    for sid, (lead, transit) in cases.items():
        ship = base + dt.timedelta(days=lead) if lead is not None else None
        deliv = ship + dt.timedelta(days=transit) if (ship and transit is not None) else None
        ships.append({"shipment_id": sid, "order_id": sid, "shipment_status": "Shipped", "ship_date": ship,
                      "delivery_date": deliv})
        orders.append(_order(sid, 1, base))
    cat = make_catalog(spark, {"shipments": ships, "orders": orders, "distribution_centers": []})
    got = {r.shipment_id: r.delay_flag for r in M.shipment_performance(cat).collect()}
    assert got == {1: "Not Shipped", 2: "On Track", 3: "Delayed Ship", 4: "On Track", 5: "Delayed Delivery",
                   6: "On Track"}


def test_stock_status_edges(spark):
    inv = [{"inventory_id": 1, "product_id": 1, "location_type": "DC", "dc_id": 1, "quantity_on_hand": 0,
            "reorder_point": 10, "max_stock": 50},
           {"inventory_id": 2, "product_id": 1, "location_type": "DC", "dc_id": 1, "quantity_on_hand": 10,
            "reorder_point": 10, "max_stock": 50},
           {"inventory_id": 3, "product_id": 1, "location_type": "DC", "dc_id": 1, "quantity_on_hand": 50,
            "reorder_point": 10, "max_stock": 50},
           {"inventory_id": 4, "product_id": 1, "location_type": "DC", "dc_id": 1, "quantity_on_hand": 5,
            "reorder_point": None, "max_stock": None}]
    prods = [{"product_id": 1, "sku": "S1", "product_name": "p", "category_id": 1, "current_list_price": D("2.00"),
              "current_unit_cost": D("1.50"), "is_active": True}]
    cats = [{"category_id": 1, "category_code": "L1", "category_name": "Top", "category_level": 1}]
    cat = make_catalog(spark, {"inventory": inv, "products": prods, "product_categories": cats, "stores": [],
                               "distribution_centers": []})
    got = {r.inventory_id: (r.stock_status, r.category_name) for r in M.inventory_health(cat).collect()}
    # product attached straight to an L1 node: no parent, so category_* is NULL
    assert got == {1: ("Stockout", None), 2: ("Below Reorder", None), 3: ("Overstock", None), 4: ("Healthy", None)}


def test_supplier_receipts(spark):
    po = [{"purchase_order_id": 1, "supplier_id": 1, "dc_id": 1, "order_date": day("2024-01-01")},
          {"purchase_order_id": 2, "supplier_id": 1, "dc_id": 1, "order_date": day("2024-01-01")}]
    poi = [{"po_item_id": 11, "purchase_order_id": 1, "product_id": 1, "quantity_ordered": 10},
           {"po_item_id": 21, "purchase_order_id": 2, "product_id": 1, "quantity_ordered": 10}]
    gr = [{"receipt_id": 100, "purchase_order_id": 1, "dc_id": 1, "receipt_date": day("2024-01-05"), "is_on_time": True}]
    gri = [{"receipt_item_id": 1000, "receipt_id": 100, "po_item_id": 11, "product_id": 1, "quantity_received": 8}]
    sup = [{"supplier_id": 1, "supplier_code": "S", "supplier_name": "Sup", "supplier_tier": "Standard",
            "lead_time_days_avg": 5, "reliability_score": D("0.9000")}]
    cat = make_catalog(spark, {"purchase_orders": po, "purchase_order_items": poi, "goods_receipts": gr,
                               "goods_receipt_items": gri, "suppliers": sup})
    r = M.supplier_performance(cat).first()
    assert (r.po_count, r.units_ordered, r.units_received) == (2, 20, 8)
    assert float(r.fill_rate) == 0.4
    assert float(r.on_time_rate) == 0.5  # no receipt counts as late
    assert float(r.avg_actual_lead_time_days) == 4.0  # only the received PO has a lead


def test_campaign_edges(spark):
    camps = [{"campaign_id": i, "campaign_code": f"C{i}", "campaign_name": f"n{i}", "campaign_type": "Email",
              "start_date": day("2024-01-01"), "end_date": day("2024-01-31"), "actual_spend": spend,
              "budget_amount": D("100.00")} for i, spend in ((1, D("100.00")), (2, D("0.00")), (3, None))]
    cat = make_catalog(spark, {"marketing_campaigns": camps, "campaign_responses": [], "orders": [],
                               "order_items": []})
    got = {r.campaign_id: (r.sent_count, r.conversion_rate, r.campaign_roi) for r in M.campaign_performance(cat).collect()}
    assert got[1][0] == 0 and got[1][1] is None and float(got[1][2]) == -1.0
    assert got[2][2] is None and got[3][2] is None


def test_grouping_sets_with_null_store(spark):
    orders = [_order(1, 1, day("2024-06-01"), store=1, channel=1), _order(2, 1, day("2024-06-01"), store=None,
                                                                          channel=1)]
    lines = [_line(1, 1, net="5.00"), _line(2, 2, net="7.00")]
    stores = [{"store_id": 1, "store_code": "S1", "store_name": "S1", "region_id": 1}]
    regions = [{"region_id": 1, "region_code": "R1", "region_name": "North"}]
    chans = [{"channel_id": 1, "channel_code": "IN", "channel_name": "In-Store", "channel_group": "Physical"}]
    cat = make_catalog(spark, {"orders": orders, "order_items": lines, "stores": stores, "regions": regions,
                               "channels": chans})
    rows = {(r.region_name, r.channel_name, r.is_region_total, r.is_channel_total): float(r.net_sales)
            for r in Q.q16(cat).collect()}
    assert rows[("North", "In-Store", 0, 0)] == 5.0
    assert rows[("ALL REGIONS", "In-Store", 0, 0)] == 7.0  # D13: the NULL region looks like a total
    assert rows[("ALL REGIONS", "ALL CHANNELS", 1, 1)] == 12.0


def test_top20_keeps_ties_at_the_cut(spark):
    orders = [_order(1, 1, day("2024-06-01"))]
    nets = [100 - i for i in range(19)] + [50, 50, 40]  # two products tie on the 20th distinct value
    lines = [_line(i + 1, 1, pid=i + 1, net=f"{v}.00") for i, v in enumerate(nets)]
    prods = [{"product_id": i + 1, "sku": f"S{i + 1:02d}", "product_name": f"p{i + 1}", "category_id": 1,
              "is_active": True} for i in range(len(nets))]
    cat = make_catalog(spark, {"orders": orders, "order_items": lines, "products": prods})
    out = Q.q08(cat).collect()
    assert len(out) == 21 and max(r.sales_rank for r in out) == 20


def test_prediction_fallbacks(spark):
    churn = [{"customer_id": 1, "churn_probability": 0.8, "churn_predicted": 1, "model_name": "  "}]
    fc = [{"ds": day("2024-01-01"), "sarimax": D("12.5"), "model_used": "", "forecast_horizon": ""}]
    loaded = dt.datetime(2024, 2, 1, 6)
    cat = make_catalog(spark, {"stg_churn_predictions": churn, "stg_profit_predictions": [],
                               "stg_sales_forecast_predictions": fc})
    for t in ("stg_churn_predictions", "stg_profit_predictions", "stg_sales_forecast_predictions"):
        cat.register(t, cat[t].withColumn("loaded_at", F.lit(loaded).cast("timestamp_ntz")))
    got = {r.entity_type: (r.model_name, r.score) for r in ml_predictions(cat).collect()}
    assert got["customer"] == ("churn_model", 0.8)
    assert got["forecast"] == ("sales_forecast", 12.5)


def test_dq_scores(spark):
    cat = lifecycle_catalog(spark)
    cat.register("products", make_catalog(spark, {"products": [
        {"product_id": 1, "sku": " ", "updated_at": dt.datetime(2024, 6, 15)},
        {"product_id": 1, "sku": "A", "updated_at": dt.datetime(2024, 5, 1)}]})["products"])
    cat.register("inventory", make_catalog(spark, {"inventory": []})["inventory"])
    rows = {(r.check_name, r.entity_name): r for r in data_quality_summary(cat).collect()}
    assert len(rows) == 26
    comp = rows[("completeness", "oltp.customers")]
    assert float(comp.score) == round(1 - 1 / 7, 6)  # one blank email hash out of 7
    prod = rows[("duplicates", "oltp.products")]
    assert float(prod.score) == 0.5
    fresh = rows[("freshness", "oltp.products")]
    assert float(fresh.score) == 0.5  # 15 of 30 days old
    assert rows[("table_score", "oltp.inventory")].score is None  # empty table
    assert rows[("overall_score", "analytics.platform")].severity in ("info", "high", "critical")
