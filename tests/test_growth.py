"""Plans that must not grow past their input, with the results they had."""

import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from fixtures import D, make_catalog
from shelfwise.operators import integrity as IC
from shelfwise.operators import packed_keys as PK
from shelfwise.plans import business as Q
from shelfwise.plans import marts as M
from shelfwise.sources.catalog import Catalog

from conftest import SF_SMALL


def _plan(df, what="executedPlan"):
    return getattr(df._jdf.queryExecution(), what)().toString()


def test_keys_are_grouped_in_their_own_types(spark):
    cat = make_catalog(spark, {"orders": [{"order_id": i, "order_number": n} for i, n in [(1, "a"), (1, None), (2, None), (None, "b"), (None, "c")]]})
    rules = [r for r in IC.RULES if r.kind == "unique" and r.table == "orders"]
    found = IC.duplicates(cat, rules)
    assert [tuple(r) for r in found.collect()] == [("pk_orders_unique", "1", 2)]
    assert not re.search(r"hashpartitioning\(rule", _plan(found)) and "cast(order_id" not in _plan(found)


def test_references_are_dealt_once(spark):
    cat = make_catalog(spark, {
        "orders": [{"order_id": 1, "channel_id": 5}, {"order_id": 2, "channel_id": 6}, {"order_id": 3, "channel_id": 6}, {"order_id": 4, "channel_id": None}],
        "channels": [{"channel_id": 5}, {"channel_id": 5}]})
    long_ids = SimpleNamespace(orders=cat["orders"].withColumn("channel_id", F.col("channel_id").cast("long")), channels=cat["channels"])
    rules = [r for r in IC.RULES if r.rule == "fk_orders_channel_id"]
    for tables in (cat, {"orders": long_ids.orders, "channels": long_ids.channels}):
        found = IC.orphans(tables, rules)
        assert [tuple(r) for r in found.collect()] == [("fk_orders_channel_id", "6", 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(IC.orphans(cat, rules)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_made_of_lines_share_the_shuffle_of_their_ids(spark):
    cat = Catalog.from_tpch(spark, SF_SMALL)
    rules = [r for r in IC.RULES if r.rule in ("pk_order_items_unique", "pk_purchase_order_items_unique") or
             (r.kind == "not_null" and r.columns in (("order_item_id",), ("po_item_id",)) and r.table in ("order_items", "purchase_order_items"))]
    df = IC.check_summary(cat, rules)
    df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    assert len(re.findall(r"[^d]Exchange hashpartitioning\(l_orderkey", plan)) == 1


def test_positions_meet_costs_before_months(spark):
    plan = _plan(Catalog.from_tpch(spark, SF_SMALL).inventory_snapshots, "optimizedPlan")
    assert plan.index("Generate explode") < plan.index("Join Inner")


def test_orders_of_a_product_are_counted_once(spark):
    cat = make_catalog(spark, {
        "orders": [{"order_id": i, "order_status": s} for i, s in [(1, "Completed"), (1, "Completed"), (2, "Returned"), (3, "Cancelled"), (None, "Completed")]],
        "order_items": [{"order_item_id": n, "order_id": o, "product_id": p, "line_net_amount": D("1"), "quantity": 1}
                        for n, (o, p) in enumerate([(1, 7), (1, 7), (1, 8), (2, 7), (3, 7), (None, 7), (2, None)])],
        "products": [{"product_id": 7, "sku": "s7"}, {"product_id": 8, "sku": "s8"}]})
    df = Q.q06(cat)
    assert sorted((r.product_id, int(r.net_sales), r.units_sold, r.order_count) for r in df.collect()) == [(7, 5, 5, 2), (8, 2, 2, 1)]
    assert not re.search(r"Aggregate \[product_id#\d+L?, order_id", _plan(df, "optimizedPlan"))


def test_supplier_joins_carry_no_attributes_and_keep_every_repeat(spark):
    import datetime as dt
    d = dt.date(2024, 1, 1)

    def day(n):
        return d + dt.timedelta(days=n)
    cat = make_catalog(spark, {
        "suppliers": [{"supplier_id": 1, "supplier_code": "A", "lead_time_days_avg": 5}] * 2 + [{"supplier_id": 2, "supplier_code": "B"}, {"supplier_id": 2, "supplier_code": "C"}],
        "purchase_orders": [{"purchase_order_id": p, "supplier_id": s, "order_date": d} for p, s in [(1, 1), (1, 1), (1, 2), (2, 1), (3, 2), (4, 1), (5, None)]],
        "purchase_order_items": [{"po_item_id": i, "purchase_order_id": p, "quantity_ordered": q} for i, p, q in [(10, 1, 4), (11, 1, 5), (11, 1, 6), (20, 2, 7), (30, 3, 8), (50, 5, 9)]],
        "goods_receipts": [{"receipt_id": r, "purchase_order_id": p, "receipt_date": day(n) if n else None, "is_on_time": t}
                           for r, p, n, t in [(100, 1, 3, True), (100, 1, 9, False), (101, 1, None, None), (300, 3, 2, True)]],
        "goods_receipt_items": [{"receipt_item_id": n, "receipt_id": r, "po_item_id": i, "quantity_received": q}
                                for n, (r, i, q) in enumerate([(100, 10, 1), (100, 10, 2), (100, 11, 3), (101, 11, None), (300, 30, 8), (None, 30, 1)])]})
    j = (cat.purchase_orders.select("purchase_order_id", "supplier_id", F.col("order_date").alias("d")).join(cat.suppliers, "supplier_id")
         .join(cat.purchase_order_items.select("purchase_order_id", "po_item_id", "quantity_ordered"), "purchase_order_id")
         .join(cat.goods_receipts.select("purchase_order_id", "receipt_id", "receipt_date", "is_on_time"), "purchase_order_id", "left")
         .join(cat.goods_receipt_items.select("receipt_id", "po_item_id", "quantity_received"), ["receipt_id", "po_item_id"], "left"))
    want = j.groupBy("supplier_id", "supplier_code").agg(
        F.countDistinct("purchase_order_id"), F.sum("quantity_ordered"), F.coalesce(F.sum("quantity_received"), F.lit(0)),
        F.round(F.avg(F.when(F.col("is_on_time"), 1.0).otherwise(0.0)), 6), F.round(F.avg(F.datediff("receipt_date", "d")), 6))
    df = M.supplier_performance(cat)
    got = df.select("supplier_id", "supplier_code", "po_count", "units_ordered", "units_received", F.round("on_time_rate", 6).cast("double"),
                    F.round("avg_actual_lead_time_days", 6).cast("double"))

    def rows(x):
        return sorted(tuple(float(v) if v is not None and not isinstance(v, str) else v for v in r) for r in x.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 3
    assert not re.search(r"hashpartitioning\([^)]*supplier_code[^)]*purchase_order_id", _plan(df))


def test_line_tables_are_numbered_by_one_shuffle_and_keys_travel_packed(spark):
    cat = Catalog.from_tpch(spark, SF_SMALL)
    tables = ("order_items", "return_items", "purchase_order_items", "goods_receipt_items", "inventory_snapshots")
    df = IC.check_summary(cat, [r for r in IC.RULES if r.kind in ("unique", "not_null") and r.table in tables])
    df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    assert len(re.findall(r"\+- Exchange hashpartitioning\(l_orderkey#\d+L?, l_linenumber", plan)) == 1
    assert "hashpartitioning(k0" not in plan and plan.count("MapInArrow") >= len(tables)


def test_packed_keys_repeat_as_grouped_ones_do(spark):
    top = 2**63 - 1
    rows = [(i % 700 * 20011 - 5_000_000, i % 11, f"é{i % 500}" + "x" * (i % 3), f"1990-01-{i % 28 + 1:02d}") for i in range(2000)]
    rows += [(top, 1, "", "0001-01-01"), (-top - 1, 2, "a\0", "9999-12-31"), (top, 1, "a", "10000-01-01"), (None, 3, None, None), (-top - 1, None, "", None),
             (None, None, "a\0", "10000-01-01"), (0, 3, "1:2", None), (0, 3, "1", None)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "a long, b int, c string, d string").selectExpr("a", "b", "c", "cast(if(length(d) > 10, '+' || d, d) as date) AS d").repartition(5)
    keys = [("a",), ("a", "b"), ("c",), ("b", "c"), ("d",), ("b", "d", "a"), ("d", "c")]
    bad = [F.col("a").isNull(), F.col("b") == 3]
    got = PK.repeated(df, keys, bad).selectExpr("no", "cast(key AS string)", "n").collect()
    want = []
    for i, columns in enumerate(keys):
        grouped = df.dropna(subset=list(columns)).groupBy(*columns).count().where("count > 1")
        want += [(i, *r) for r in grouped.select(PK.text(columns), "count").collect()]
    want += [(len(keys) + i, None, df.where(c).count()) for i, c in enumerate(bad)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert set(range(9)) == {w[0] for w in want}
    counted = {r.no: r.n for r in PK.repeated(df, keys, [], told=False).groupBy("no").agg(F.sum("n").alias("n")).collect()}
    assert counted == {i: sum(w[0] == i for w in want) for i in range(len(keys))}


def test_keys_of_no_packed_type_are_grouped(spark):
    from types import MappingProxyType
    df = spark.createDataFrame([(1.5, 1), (1.5, 2), (0.0, 3), (-0.0, 4), (None, 5), (None, 6)], "order_id double, order_number int")
    rules = [r for r in IC.RULES if r.kind == "unique" and r.table == "orders"]
    found = IC.duplicates(MappingProxyType({"orders": df}), rules).collect()
    assert sorted((r.rule, float(r.value), r.n) for r in found) == [("pk_orders_unique", 0.0, 2), ("pk_orders_unique", 1.5, 2)]
