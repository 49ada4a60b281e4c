"""Binding of the driver's TPC-H-style tables to the retail model (test bindings).

Every retail table is a deterministic projection or aggregation of the
driver tables, written with the DataFrame API so Catalyst can prune and push
down through it. The same rules are written once more as DuckDB SQL in
``shelfwise.testing.oracle_binding`` for the correctness oracle.

Scale notes
* Fixed dimensions (channels, payment methods) are literal relations of a
  handful of rows; nation/region are 25/5 rows. Those are broadcast.
* Product, supplier and customer joins are left to AQE, which broadcasts
  only after measuring the side at runtime (``autoBroadcastJoinThreshold``).
* ``order_item_id`` needs a row number per ``(l_orderkey, l_linenumber)``
  because that pair is not unique in the driver data. The window is
  partitioned by those keys (no global window) and Catalyst drops it when a
  plan does not read the id.
* Money is DECIMAL(18,2); all derivations are exact decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.materialize import freeze
from shelfwise.sources.calendar import calendar_between

MONEY = "decimal(18,2)"

# Channel per TPC-H order priority (leading digit = channel_id).
CHANNEL_ROWS = [
    (1, "URGENT", "Store Express", "Physical", True),
    (2, "HIGH", "Store Standard", "Physical", True),
    (3, "MEDIUM", "Web", "Digital", True),
    (4, "NOT SPECIFIED", "Mobile App", "Digital", True),
    (5, "LOW", "Marketplace", "Digital", True),
]
# Payment methods (id = order key % 6 + 1).
PAYMENT_METHOD_ROWS = [
    (1, "CARD", "Credit Card", "Card", True),
    (2, "DEBIT", "Debit Card", "Card", True),
    (3, "CASH", "Cash", "Cash", True),
    (4, "WALLET", "Mobile Wallet", "Digital", True),
    (5, "GIFT", "Gift Card", "Stored Value", True),
    (6, "BNPL", "Buy Now Pay Later", "Credit", True),
]
# Labels picked by key modulo list length.
CARRIERS = ["UPS", "FedEx", "USPS", "DHL"]
RETURN_REASONS = ["SIZE", "DEFECT", "CHANGED_MIND", "LATE", "WRONG_ITEM", "OTHER"]
CAMPAIGN_TYPES = ["Email", "SMS", "Social", "Display", "InStore", "Promo"]
OBJECTIVES = ["AWARENESS", "ACQUISITION", "RETENTION"]
RESPONSE_TYPES = {"view": "Sent", "signup": "Open", "error": "Click", "purchase": "Convert",
                  "click": "Unsubscribe"}
# Date ranges of the binding (the calendar's: at least; it grows with the orders).
CALENDAR_START, CALENDAR_END = "1994-12-01", "2002-12-31"
SNAPSHOT_FIRST, SNAPSHOT_LAST = "2000-09-01", "2001-08-01"
LABOR_FIRST, LABOR_LAST = "1995-01-01", "2001-08-01"
INVENTORY_AS_OF = "2001-07-15 00:00:00"
PRODUCTS_UPDATED_AT = "2001-06-01 00:00:00"
# Staging (model output) rules.
SCORING_DATE = "2001-08-01"
PREDICTIONS_LOADED_AT = "2001-08-02 06:00:00"
FORECAST_FROM = "2000-01-01"


def _pick(key, labels):
    """``labels[key % len(labels)]`` as a CASE chain."""
    m = key % len(labels)
    expr = F.when(m == 0, F.lit(labels[0]))
    for i, lab in enumerate(labels[1:], start=1):
        expr = expr.when(m == i, F.lit(lab))
    return expr


def _pad(key, width: int):
    """The key's digits, padded with zeros up to ``width`` (a longer key stays whole)."""
    digits = key.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0")


def _rate(n):
    """Exact DECIMAL(4,2) rate ``0.nn`` from a two-digit integer column."""
    return F.concat(F.lit("0."), n.cast("string")).cast("decimal(4,2)")


def _date(s: str):
    return F.lit(s).cast("date")


def _values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small fixed relation as a JVM-side VALUES list (no Python round trip)."""
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({names})")


def tpch_builders(spark: SparkSession, sf_dir: str) -> dict:
    cache: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        # one DataFrame per source file: the footer/schema is read once
        key = f"raw:{name}"
        if key not in cache:
            cache[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return cache[key]

    def once(name, fn):
        def build():
            if name not in cache:
                cache[name] = fn()
            return cache[name]
        return build

    # ---------------- reference dimensions ----------------
    def regions():
        r = raw("region")
        return r.select(F.col("r_regionkey").alias("region_id"),
                        F.substring("r_name", 1, 3).alias("region_code"),
                        F.col("r_name").alias("region_name"),
                        F.lit("US").alias("country_code"),
                        F.lit(True).alias("is_active"))

    def channels():
        return _values(spark, CHANNEL_ROWS, "channel_id int, channel_code string, channel_name string, "
                                            "channel_group string, is_active boolean")

    def payment_methods():
        return _values(spark, PAYMENT_METHOD_ROWS, "payment_method_id int, method_code string, method_name string, "
                                                   "method_group string, is_active boolean")

    def _nation_cols():
        k = F.col("n_nationkey")
        return k, F.concat(F.lit("S"), _pad(k, 2))

    def stores():
        k, state = _nation_cols()
        return raw("nation").select(
            k.alias("store_id"), F.col("n_name").alias("store_code"),
            F.concat(F.col("n_name"), F.lit(" Store")).alias("store_name"),
            F.col("n_regionkey").alias("region_id"),
            F.when(k % 3 == 0, "Flagship").when(k % 3 == 1, "Standard").otherwise("Outlet").alias("store_format"),
            F.col("n_name").alias("city"), state.alias("state_code"),
            (F.lit(5000) + k * 1000).alias("selling_sq_ft"),
            F.add_months(_date("1995-01-01"), k * 4).alias("open_date"),
            F.when(k % 7 == 6, F.add_months(F.add_months(_date("1995-01-01"), k * 4), 12)).alias("close_date"),
            (k % 7 != 6).alias("is_active"))

    def distribution_centers():
        k, state = _nation_cols()
        return raw("nation").select(
            k.alias("dc_id"), F.concat(F.lit("DC"), _pad(k, 2)).alias("dc_code"),
            F.concat(F.lit("DC "), F.col("n_name")).alias("dc_name"),
            F.col("n_regionkey").alias("region_id"), F.col("n_name").alias("city"),
            state.alias("state_code"), F.lit(100000).alias("capacity_units"), F.lit(True).alias("is_active"))

    def calendar_date():
        # a day for every order, ship, delivery and return date that the rules below give
        k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        last = F.greatest(F.date_add(d, (F.lit(3) + k % 25).cast("int")), F.date_add(d, (k % 9 + k % 11).cast("int")))
        return calendar_between(raw("orders").agg(F.least(F.min(d), _date(CALENDAR_START)).alias("first_day"),
                                                  F.greatest(F.max(last), _date(CALENDAR_END)).alias("last_day")))

    # ---------------- product ----------------
    def _l1():
        # one row per distinct p_type (the type vocabulary): numbered once and
        # frozen, so the many plans that touch products read a tiny table
        # instead of re-running the distinct + numbering each time
        l1 = (raw("part").select("p_type").distinct()
              .select(F.col("p_type").alias("l1_code"),
                      F.dense_rank().over(Window.orderBy("p_type")).cast("int").alias("l1_id")))
        return freeze(l1)

    l1 = once("l1", _l1)
    brand_no = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")

    def product_categories():
        top = l1().select(F.col("l1_id").alias("category_id"), F.col("l1_code").alias("category_code"),
                          F.col("l1_code").alias("category_name"),
                          F.lit(None).cast("int").alias("parent_category_id"),
                          F.lit(1).cast("short").alias("category_level"))
        sub = (raw("part").select("p_type", "p_brand").distinct()
               .join(l1(), F.col("p_type") == F.col("l1_code"))
               .select((F.col("l1_id") * 1000 + brand_no).alias("category_id"),
                       F.concat_ws("-", "p_type", "p_brand").alias("category_code"),
                       F.concat_ws(" ", "p_type", "p_brand").alias("category_name"),
                       F.col("l1_id").alias("parent_category_id"),
                       F.lit(2).cast("short").alias("category_level")))
        return top.unionByName(sub).withColumn("is_active", F.lit(True))

    def products():
        k = F.col("p_partkey")
        price = F.col("p_retailprice").cast(MONEY)
        launched = F.date_add(_date("1994-01-01"), (k % 365).cast("int"))
        return (raw("part").join(l1(), F.col("p_type") == F.col("l1_code"))
                .select(k.alias("product_id"),
                        F.concat(F.lit("SKU-"), _pad(k, 8)).alias("sku"),
                        F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand_name"),
                        F.when(k % 50 == 7, F.col("l1_id")).otherwise(F.col("l1_id") * 1000 + brand_no)
                        .alias("category_id"),
                        F.when(k % 9 == 0, F.lit(None)).otherwise((k % 10).cast("int")).alias("primary_supplier_id"),
                        F.lit("EA").alias("unit_of_measure"),
                        price.alias("current_list_price"),
                        F.round(price * _rate(50 + k % 20), 2).cast(MONEY).alias("current_unit_cost"),
                        (F.lit(1).cast("decimal(12,8)") + (k % 100).cast("decimal(12,8)") / 100).cast("decimal(12,8)").alias("popularity_score"),
                        (k % 12 != 0).alias("is_active"),
                        launched.alias("launch_date"), F.when(k % 12 == 0, F.date_add(launched, 2000)).alias("discontinue_date"),
                        F.lit(PRODUCTS_UPDATED_AT).cast("timestamp_ntz").alias("updated_at")))

    def suppliers():
        k = F.col("s_suppkey")
        return raw("supplier").select(
            k.cast("int").alias("supplier_id"),
            F.concat(F.lit("SUP"), _pad(k, 5)).alias("supplier_code"),
            F.col("s_name").alias("supplier_name"),
            _pick(k, ["Strategic", "Preferred", "Standard"]).alias("supplier_tier"),
            F.lit("US").alias("country_code"), F.lit(30).alias("payment_terms_days"),
            (F.lit(5) + k % 10).cast("int").alias("lead_time_days_avg"),
            F.concat(F.lit("0."), (50 + k % 50).cast("string")).cast("decimal(5,4)").alias("reliability_score"),
            F.lit(True).alias("is_active"))

    # ---------------- customer ----------------
    def customers():
        k, seg = F.col("c_custkey"), F.col("c_mktsegment")
        return raw("customer").select(
            k.alias("customer_id"),
            F.concat(F.lit("C"), _pad(k, 9)).alias("customer_number"),
            F.when(seg.isin("HOUSEHOLD", "FURNITURE"), "Loyalty").when(seg == "MACHINERY", "Corporate")
            .otherwise("Guest").alias("customer_type"),
            F.col("c_name").alias("first_name"),
            F.when(k % 23 == 0, F.lit(None)).otherwise(F.sha2(F.col("c_name"), 256)).alias("email_hash"),
            F.date_sub(_date("1995-01-01"), (k % 365).cast("int")).alias("registration_date"),
            (k % 5 + 1).cast("int").alias("acquisition_channel_id"),
            F.when(k % 41 == 0, F.lit(None)).otherwise((k % 25).cast("int")).alias("preferred_store_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.col("c_acctbal").alias("_acctbal"),
            F.date_sub(_date("2001-08-01"), (k % 40).cast("int")).cast("timestamp_ntz").alias("updated_at"))

    def customers_public():
        return customers().drop("_acctbal")

    def loyalty_accounts():
        bal = F.col("_acctbal")
        return (customers().filter(F.col("customer_type") == "Loyalty").select(
            F.col("customer_id").alias("loyalty_account_id"), "customer_id",
            F.concat(F.lit("L"), F.col("customer_id").cast("string")).alias("loyalty_number"),
            F.when(bal < 2500, "Bronze").when(bal < 5000, "Silver").when(bal < 7500, "Gold")
            .otherwise("Platinum").alias("tier_code"),
            F.col("registration_date").alias("enroll_date"),
            F.greatest(F.floor(bal), F.lit(0)).cast("int").alias("points_balance"),
            F.lit("Active").alias("status_code")))

    # ---------------- sales ----------------
    def orders():
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        channel = F.substring("o_orderpriority", 1, 1).cast("int")
        total = F.col("o_totalprice").cast(MONEY)
        zero = F.lit(0).cast(MONEY)
        return raw("orders").select(
            k.alias("order_id"), F.concat(F.lit("SO-"), k.cast("string")).alias("order_number"),
            F.col("o_custkey").alias("customer_id"),
            F.when((channel <= 2) & (F.col("o_custkey") % 41 != 0), (F.col("o_custkey") % 25).cast("int"))
            .alias("store_id"),
            channel.alias("channel_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_orderdate").alias("order_timestamp"),
            F.when(st == "F", F.when(k % 7 == 0, "Returned").otherwise("Completed"))
            .when(st == "P", "PartiallyReturned")
            .otherwise(F.when(k % 10 == 0, "Cancelled").otherwise("Pending")).alias("order_status"),
            F.lit("USD").alias("currency_code"),
            total.alias("gross_amount"), zero.alias("discount_amount"), zero.alias("tax_amount"),
            zero.alias("shipping_amount"), total.alias("net_amount"), total.alias("total_amount"),
            F.lit(None).cast("int").alias("employee_id"),
            F.when(k % 5 == 0, (F.expr("o_orderkey div 5") % 100).cast("int")).alias("campaign_id"),
            F.col("o_orderdate").alias("updated_at"))

    def _lines():
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
            "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "_received")
        # numbered as they stand: amounts are derived above the window, so that they are not shuffled
        # and the tables made of lines share its shuffle; what some of them are filtered by ends the order, so that
        # all number by the same columns (_received is the same for all rows of a number's group)
        l = raw("lineitem").withColumn("_received", F.col("l_orderkey") % 13 != 0)
        l = l.select("*", F.row_number().over(w).alias("_nth"))
        gross = F.col("l_extendedprice").cast(MONEY)
        qty = F.col("l_quantity").cast("int")
        disc = F.col("l_discount").cast("decimal(4,2)")
        discount = F.round(gross * disc, 2).cast(MONEY)
        cogs = F.round(gross * _rate(50 + F.col("l_partkey") % 20), 2).cast(MONEY)
        net = (gross - discount).cast(MONEY)
        return l.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate", "_received",
            (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("_nth")).alias("order_item_id"),
            qty.alias("quantity"), gross.alias("line_gross_amount"), discount.alias("discount_amount"),
            net.alias("line_net_amount"), cogs.alias("line_cogs_amount"),
            F.round(gross / qty, 2).cast(MONEY).alias("unit_price"),
            F.round(cogs / qty, 2).cast(MONEY).alias("unit_cost"),
            F.round(net / qty, 2).cast(MONEY).alias("unit_net"),
            F.when(F.col("l_discount") == 0, F.lit(None)).otherwise((disc * 100).cast("int")).alias("promotion_id"))

    lines = once("lines", _lines)

    def order_items():
        return lines().select(
            "order_item_id", F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_id"), "quantity", "unit_price", "unit_cost", "discount_amount",
            "line_gross_amount", "line_net_amount", "line_cogs_amount", "promotion_id",
            F.lit(False).alias("is_gift"))

    def payments():
        k = F.col("o_orderkey")
        ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))
        return raw("orders").select(
            k.alias("payment_id"), k.alias("order_id"), (k % 6 + 1).cast("int").alias("payment_method_id"),
            ts.alias("payment_timestamp"), F.col("o_totalprice").cast(MONEY).alias("payment_amount"),
            F.concat(F.lit("A"), k.cast("string")).alias("authorization_code"),
            F.when(k % 17 == 0, "Failed").otherwise("Captured").alias("payment_status"))

    def shipments():
        o = orders().filter(F.col("channel_id") >= 3)
        k = F.col("order_id")
        ship = F.when(k % 31 == 0, F.lit(None).cast("date")).otherwise(F.date_add("order_date", (k % 9).cast("int")))
        o = o.select("order_id", "order_date", "order_timestamp", ship.alias("ship_date"))
        delivery = (F.when(F.col("ship_date").isNull() | (k % 37 == 0), F.lit(None).cast("date"))
                    .otherwise(F.date_add("ship_date", (k % 11).cast("int"))))
        o = o.withColumn("delivery_date", delivery)
        return o.select(
            k.alias("shipment_id"), "order_id",
            F.when(k % 29 == 0, F.lit(None)).otherwise((k % 25).cast("int")).alias("dc_id"),
            F.lit(None).cast("int").alias("store_id"),
            _pick(k, CARRIERS).alias("carrier_name"),
            F.concat(F.lit("TRK"), k.cast("string")).alias("tracking_number"),
            F.when(F.col("ship_date").isNull(), "Pending").when(F.col("delivery_date").isNull(), "InTransit")
            .otherwise("Delivered").alias("shipment_status"),
            "ship_date", "delivery_date", F.col("order_timestamp").alias("created_at"))

    def return_items():
        r = lines().filter(F.col("l_returnflag") == "R")
        pk = F.col("l_partkey")
        return r.select(
            F.col("order_item_id").alias("return_item_id"), F.col("l_orderkey").alias("return_id"),
            "order_item_id", pk.alias("product_id"),
            (F.lit(1) + (F.col("quantity") - 1) % 3).cast("int").alias("quantity_returned"),
            F.col("unit_net").alias("unit_refund_amount"),
            (pk % 3 != 0).alias("restock_flag"),
            _pick(pk, RETURN_REASONS).alias("return_reason_code"))

    def returns():
        ri = (return_items().groupBy("return_id")
              .agg(F.sum(F.col("quantity_returned") * F.col("unit_refund_amount")).cast(MONEY).alias("refund_amount")))
        o = orders().select("order_id", "customer_id", "order_date", "order_timestamp")
        return ri.join(o, ri.return_id == o.order_id).select(
            "return_id", "order_id", "customer_id",
            F.date_add("order_date", (F.lit(3) + F.col("order_id") % 25).cast("int")).alias("return_date"),
            F.lit("Completed").alias("return_status"), "refund_amount", F.col("order_timestamp").alias("created_at"))

    # ---------------- inventory ----------------
    def _positions():
        l = raw("lineitem").select("l_partkey", "l_suppkey", "l_quantity")
        s = raw("supplier").select("s_suppkey", "s_nationkey")
        return (l.join(s, l.l_suppkey == s.s_suppkey)
                .groupBy("l_partkey", "s_nationkey")
                .agg(F.sum(F.col("l_quantity").cast("int")).alias("qty_sum")))

    positions = once("positions", _positions)

    def _place():
        p, nk = F.col("l_partkey"), F.col("s_nationkey")
        is_store = nk % 2 == 0
        return [(p * 100 + nk).alias("inventory_id"), p.alias("product_id"),
                F.when(is_store, "STORE").otherwise("DC").alias("location_type"),
                F.when(is_store, nk).alias("store_id"), F.when(~is_store, nk).alias("dc_id")]

    def inventory():
        p = F.col("l_partkey")
        on_hand = (F.col("qty_sum") % 60).cast("int")
        return positions().select(
            *_place(),
            on_hand.alias("quantity_on_hand"), (on_hand % 4).alias("quantity_reserved"),
            (on_hand - on_hand % 4).alias("quantity_available"),
            F.when(p % 97 == 0, F.lit(None)).otherwise(F.lit(10)).alias("reorder_point"),
            F.when(p % 97 == 0, F.lit(None)).otherwise(F.lit(50)).alias("max_stock"),
            F.lit(INVENTORY_AS_OF).cast("timestamp_ntz").alias("as_of_timestamp"))

    def inventory_snapshots():
        cost = products().select(F.col("product_id").alias("_pid"), "current_unit_cost")
        # positions meet their costs by their keys alone, before they are repeated by month: the join moves a row a position, not one a month
        months = F.sequence(_date(SNAPSHOT_FIRST), _date(SNAPSHOT_LAST), F.expr("INTERVAL 1 MONTH"))
        located = positions().join(cost, F.col("l_partkey") == F.col("_pid")).select(*_place(), "current_unit_cost")
        snap = located.withColumn("snapshot_date", F.explode(months))
        on_hand = ((F.col("product_id") + F.month("snapshot_date") + F.coalesce("store_id", "dc_id")) % 60).cast("int")
        return snap.withColumn("quantity_on_hand", on_hand).select(
            (F.col("inventory_id") * 100 + F.months_between("snapshot_date", _date(SNAPSHOT_FIRST)).cast("long"))
            .alias("snapshot_id"),
            "snapshot_date", "product_id", "location_type", "store_id", "dc_id", "quantity_on_hand",
            (F.col("quantity_on_hand") % 4).alias("quantity_reserved"),
            (F.col("quantity_on_hand") - F.col("quantity_on_hand") % 4).alias("quantity_available"),
            (F.col("quantity_on_hand") * F.col("current_unit_cost")).cast(MONEY).alias("inventory_value_cost"))

    # ---------------- procurement ----------------
    def purchase_orders():
        g = (lines().groupBy("l_orderkey", "l_suppkey")
             .agg(F.date_sub(F.min(F.col("l_shipdate").cast("date")), 20).alias("order_date")))
        k = F.col("l_orderkey")
        return g.select(
            (k * 10000000 + F.col("l_suppkey")).alias("purchase_order_id"),
            F.concat(F.lit("PO-"), k.cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("po_number"),
            F.col("l_suppkey").cast("int").alias("supplier_id"), (k % 25).cast("int").alias("dc_id"),
            "order_date", F.date_add("order_date", 14).alias("expected_receipt_date"),
            F.when(k % 13 == 0, "Open").otherwise("Closed").alias("po_status"))

    def purchase_order_items():
        return lines().select(
            F.col("order_item_id").alias("po_item_id"),
            (F.col("l_orderkey") * 10000000 + F.col("l_suppkey")).alias("purchase_order_id"),
            F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"),
            F.col("quantity").alias("quantity_ordered"), "unit_cost")

    def goods_receipts():
        # asked of the grouped row (the date's part is 1 or 2), so that receipts share the grouping of purchase orders
        dated = F.col("order_date").isNull().cast("int") + 1
        po = purchase_orders().filter((F.col("po_status") == "Closed").cast("int") * dated != 0)
        lag = (F.col("supplier_id") % 30).cast("int")
        return po.select(
            F.col("purchase_order_id").alias("receipt_id"), "purchase_order_id", "dc_id",
            F.date_add("order_date", lag).alias("receipt_date"),
            F.when(lag == 29, F.lit(None).cast("boolean")).otherwise(lag <= 14).alias("is_on_time"))

    def goods_receipt_items():
        li = lines().filter("_received")
        return li.select(
            F.col("order_item_id").alias("receipt_item_id"),
            (F.col("l_orderkey") * 10000000 + F.col("l_suppkey")).alias("receipt_id"),
            F.col("order_item_id").alias("po_item_id"), F.col("l_partkey").alias("product_id"),
            F.greatest(F.col("quantity") - F.col("l_linenumber") % 3, F.lit(0)).alias("quantity_received"))

    # ---------------- marketing ----------------
    campaign_key = F.get_json_object("props", "$.k").cast("int")

    def marketing_campaigns():
        k = F.col("campaign_id")
        ids = raw("events").select(campaign_key.alias("campaign_id")).where(k.isNotNull()).distinct()
        return ids.select(
            k, F.concat(F.lit("CMP"), _pad(k, 3)).alias("campaign_code"),
            F.concat(F.lit("Campaign "), k.cast("string")).alias("campaign_name"),
            _pick(k, CAMPAIGN_TYPES).alias("campaign_type"),
            F.when(k % 10 == 9, F.lit(None)).otherwise((k % 5 + 1).cast("int")).alias("channel_id"),
            _date("2024-01-01").alias("start_date"), _date("2024-01-31").alias("end_date"),
            F.when(k % 20 == 19, F.lit(None)).otherwise((F.lit(1000) + (k % 8) * 250).cast(MONEY)).alias("budget_amount"),
            F.when(k % 20 == 19, F.lit(None)).when(k % 25 == 24, F.lit(0).cast(MONEY))
            .otherwise((F.lit(500) + (k % 13) * 100).cast(MONEY)).alias("actual_spend"),
            _pick(k, OBJECTIVES).alias("objective_code"),
            F.lit(1).cast("decimal(6,4)").alias("lift_factor"), F.lit("Completed").alias("status_code"))

    def campaign_responses():
        et = F.col("event_type")
        rtype = F.when(et == "view", "Sent")
        for src, dst in list(RESPONSE_TYPES.items())[1:]:
            rtype = rtype.when(et == src, dst)
        return raw("events").select(
            F.col("event_id").alias("campaign_response_id"), campaign_key.alias("campaign_id"),
            F.col("user_id").alias("customer_id"), F.col("ts").alias("response_timestamp"),
            rtype.alias("response_type"), F.lit(None).cast("long").alias("order_id"),
            F.when(et == "purchase", F.col("value").cast(MONEY)).alias("attributed_revenue"))

    # ---------------- people ----------------
    def store_labor_hours():
        months = F.sequence(_date(LABOR_FIRST), _date(LABOR_LAST), F.expr("INTERVAL 1 MONTH"))
        n = raw("nation").select("n_nationkey", F.explode(months).alias("work_date"))
        k = F.col("n_nationkey")
        hours = (F.lit(100) + k).cast("decimal(8,2)")
        return n.select(
            (k * 1000 + F.months_between("work_date", _date(LABOR_FIRST)).cast("int")).cast("long").alias("labor_hours_id"),
            k.alias("store_id"), F.lit(None).cast("int").alias("employee_id"), "work_date",
            hours.alias("labor_hours"), (hours * 20).cast(MONEY).alias("labor_cost"))

    # ---------------- model-output staging (S8 stand-ins) ----------------
    loaded_at = F.lit(PREDICTIONS_LOADED_AT).cast("timestamp_ntz")

    def stg_churn_predictions():
        o = orders().where(F.col("order_status").isin("Completed", "Returned", "PartiallyReturned"))
        last = o.groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
        days = F.least(F.datediff(_date(SCORING_DATE), F.col("last_order")), F.lit(720))
        prob = (F.floor(days * 10000 / 720).cast("long")).cast("double") / 10000.0
        k = F.col("customer_id")
        return last.select(
            k, prob.alias("churn_probability"),
            F.when(prob >= 0.5, 1).otherwise(0).alias("churn_predicted"),
            F.lit(None).cast("int").alias("churn_actual"),
            F.when(k % 11 == 0, F.lit("  ")).otherwise(F.lit("churn_gbm")).alias("model_name"),
            F.lit(0.5).alias("threshold"), loaded_at.alias("loaded_at"))

    def stg_profit_predictions():
        o = orders().where(F.col("order_status").isin("Completed", "Returned", "PartiallyReturned"))
        k = F.col("order_id")
        prob = (k % 100).cast("double") / 100.0
        return o.select(
            "order_id", "customer_id", "order_date", F.col("net_amount").cast("decimal(38,10)").alias("net_sales"),
            F.lit(None).cast("double").alias("margin_pct"), F.lit(1).alias("is_profitable"),
            prob.alias("profit_probability"), F.when(prob >= 0.5, 1).otherwise(0).alias("profit_predicted"),
            F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.lit("profit_xgb")).alias("model_name"),
            loaded_at.alias("loaded_at"))

    def stg_sales_forecast_predictions():
        o = orders().where(F.col("order_status").isin("Completed", "Returned", "PartiallyReturned"))
        m = o.groupBy(F.trunc("order_date", "MM").alias("ds")).agg(
            F.sum("net_amount").cast("decimal(38,10)").alias("y_true"))
        naive = F.lag("y_true", 12).over(Window.orderBy("ds"))  # months: bounded by the calendar
        recent = F.col("ds") >= _date(FORECAST_FROM)
        nul = F.lit(None).cast("decimal(38,10)")
        m = m.withColumn("seasonal_naive", naive)
        return m.select(
            "ds", "y_true", "seasonal_naive", nul.alias("sarimax"), nul.alias("sarimax_lower"), nul.alias("sarimax_upper"),
            nul.alias("ml_xgboost"),
            F.when(recent, F.lit("backtest")).otherwise(F.lit("history")).alias("forecast_horizon"),
            F.when(recent, F.col("seasonal_naive")).alias("yhat"), nul.alias("yhat_lower"), nul.alias("yhat_upper"),
            F.when(recent, F.lit("seasonal_naive")).otherwise(F.lit(" ")).alias("model_used"),
            loaded_at.alias("loaded_at"))

    return {
        "stg_churn_predictions": stg_churn_predictions, "stg_profit_predictions": stg_profit_predictions,
        "stg_sales_forecast_predictions": stg_sales_forecast_predictions,
        "regions": regions, "channels": once("channels", channels),
        "payment_methods": once("payment_methods", payment_methods),
        "stores": stores, "distribution_centers": distribution_centers, "calendar_date": calendar_date,
        "product_categories": product_categories, "products": once("products", products),
        "suppliers": suppliers, "customers": customers_public, "loyalty_accounts": loyalty_accounts,
        "orders": once("orders", orders), "order_items": order_items, "payments": payments,
        "shipments": shipments, "returns": returns, "return_items": once("return_items", return_items),
        "inventory": once("inventory", inventory), "inventory_snapshots": inventory_snapshots,
        "purchase_orders": once("purchase_orders", purchase_orders),
        "purchase_order_items": purchase_order_items, "goods_receipts": goods_receipts,
        "goods_receipt_items": goods_receipt_items, "marketing_campaigns": marketing_campaigns,
        "campaign_responses": campaign_responses, "store_labor_hours": store_labor_hours,
    }
