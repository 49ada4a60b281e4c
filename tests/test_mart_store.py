"""Stored marts: the same results, fewer scans, refresh by month."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfwise.registry import REGISTRY, present
from shelfwise.sources.catalog import Catalog
from shelfwise.sources.mart_store import MONTH, MartStore, changed_months


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    cat = Catalog.from_tpch(spark, SF_SMALL)
    store = MartStore(spark, str(tmp_path_factory.mktemp("marts")))
    store.save(cat)
    return cat, store, store.serve(cat)


def rows(df):
    return sorted(map(str, present(df).collect()))


def scans(df, column="l_orderkey"):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{column}")


@pytest.mark.parametrize("name", ["m02", "m05", "m06", "m09", "m12", "q01", "k18_operations_overview", "k23_operational_risks", "k27_cashflow", "k28_financial_risks"])
def test_served_marts_give_the_same_rows_with_fewer_scans(stored, name):
    cat, _, served = stored
    computed, read = REGISTRY[name](Catalog.from_tpch(cat.spark, SF_SMALL)), REGISTRY[name](served)
    assert rows(computed) == rows(read)
    assert scans(read) <= min(2, scans(computed)) if name != "q01" else True


def listing(store, name):
    home = os.path.join(store.root, name)
    return {d: sorted(os.listdir(os.path.join(home, d))) for d in os.listdir(home) if d.startswith(MONTH)}


def test_a_refresh_touches_the_months_that_changed(spark, stored):
    cat, store, served = stored
    o = cat.orders
    day = o.agg(F.max("order_date")).first()[0].replace(day=1) - dt.timedelta(days=40)
    month = day.strftime("%Y-%m")
    gone = F.date_format("order_date", "yyyy-MM") == month
    before = {m: listing(store, m) for m in ("m02", "m03", "m08")}
    changed = cat.with_as_of(cat.as_of)
    changed.register("orders", o.where(~gone | (F.col("order_id") % 2 == 0)))
    store.refresh(changed, [month])
    after = {m: listing(store, m) for m in ("m02", "m03", "m08")}
    for m in before:
        assert {k for k in before[m] if before[m][k] != after[m].get(k)} <= {f"{MONTH}={month}"}
    assert before["m02"] != after["m02"]
    assert rows(store.frame("m03")) == rows(REGISTRY["m03"](changed))
    nothing = cat.with_as_of(cat.as_of)
    nothing.register("orders", o.where(~gone))
    store.refresh(nothing, [month])
    assert f"{MONTH}={month}" not in listing(store, "m02") and store.frame("m02").where(gone).count() == 0


def test_changed_months_follow_the_orders(spark, stored):
    cat = stored[0]
    last = cat.orders.agg(F.max("updated_at")).first()[0]
    got = changed_months(cat, last - dt.timedelta(days=1))
    assert got and got[0] >= (last - dt.timedelta(days=31)).strftime("%Y-%m")
    assert changed_months(cat, last) == []


def test_marts_of_another_date_are_computed(stored):
    cat, store, _ = stored
    other = store.serve(cat.with_as_of(cat.as_of - dt.timedelta(days=60)))
    assert scans(REGISTRY["m05"](other)) > 0 and scans(REGISTRY["m05"](store.serve(cat))) == 0
