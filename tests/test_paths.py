"""Parameter paths of the roll-ups, and plans that start no job while they are built."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from fixtures import D, day, make_catalog
from shelfwise.plans import business as Q
from shelfwise.plans import kpis as K
from shelfwise.registry import REGISTRY
from shelfwise.sources.catalog import Catalog


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog.from_tpch(spark, SF_SMALL)
    c.as_of, c.products  # the date that stands for today, and the type numbers, are looked up once a session
    return c


@pytest.mark.parametrize("name", ["k03_dashboard_regional", "k06_sales_overview", "k08_category_performance", "k09_product_performance",
                                  "k10_regional_performance", "k21_returns_by_category", "k25_profitability_by_region", "k26_cost_breakdown", "q54", "m02"])
def test_building_a_plan_starts_no_job(spark, cat, name):
    REGISTRY[name](cat)  # reads the footers of the session's files, once
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        again = Catalog.from_tpch(spark, SF_SMALL)
        REGISTRY[name](again.with_as_of(cat.as_of))
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_category_tree_to_any_depth(spark):
    rows = [{"category_id": i, "category_code": f"c{i:02}", "parent_category_id": i - 1 if i else None, "category_level": 1} for i in range(40)]
    got = Q.q54(make_catalog(spark, {"product_categories": rows})).collect()
    assert len(got) == 40 and got[-1].path == " > ".join(f"c{i:02}" for i in range(40))


def test_risks_are_searched_by_their_text(cat):
    every = K.k28_financial_risks(cat).collect()
    some = K.k28_financial_risks(cat, search="COGS").collect()
    assert some and {tuple(r) for r in some} <= {tuple(r) for r in every} and all("cogs" in r.risk.lower() for r in some)


def test_churn_risk_falls_back_to_the_lifecycle(cat):
    by_score, by_life = (K.k17_churn_risk(cat, search=s).collect() for s in (None, "gold"))
    assert [sorted(r.risk_level for r in x) for x in (by_score, by_life)] == [["High", "Low", "Medium"]] * 2
    assert sum(r.customer_count for r in by_life) > 0 and all(r.confidence is None for r in by_life)
    assert next(r for r in by_life if r.risk_level == "Low").predicted_revenue_at_risk is None
    assert not K.k17_churn_risk(cat, search="no such text").collect()


def test_turnover_keeps_its_digits_at_size(spark):
    big = D("9999999999999999.99")
    lines = [{"order_item_id": 1, "order_id": 1, "product_id": 1, "quantity": 1, "line_cogs_amount": big, "line_net_amount": big, "line_gross_amount": big,
              "discount_amount": D(0)}]
    cat = make_catalog(spark, {
        "orders": [{"order_id": 1, "order_date": day("2024-01-01"), "order_status": "Completed", "channel_id": 1}], "order_items": lines,
        "products": [{"product_id": 1, "current_unit_cost": D("0.07")}],
        "inventory": [{"inventory_id": i, "product_id": 1, "quantity_on_hand": 1} for i in range(3)]}, as_of=dt.date(2024, 2, 1))
    got = Q.q35(cat).first()
    want = (big * 3 / (D("0.07") * 3)).quantize(D("0.01"))
    assert abs(D(str(got.inventory_turnover_proxy)) - want) <= D("0.01")
