"""The constraint set of the relational model, as data.

Fixed values: keys, required columns, unique sets, references, value lists,
ranges and row conditions of the 35 tables (``sources.schemas`` has their
columns). ``operators.integrity`` turns them into plans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from shelfwise.sources.schemas import DDL


@dataclass(frozen=True)
class Rule:
    """``condition`` (SQL) holds for a sound row; NULL passes, as in a CHECK."""

    rule: str
    table: str
    kind: str                      # not_null | unique | foreign_key | domain | range | row
    columns: tuple[str, ...] = ()
    ref_table: str | None = None
    ref_columns: tuple[str, ...] = ()
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    condition: str | None = None
    key: tuple[str, ...] = ()      # primary key, names a violating row


PRIMARY_KEYS = {
    "regions": "region_id", "channels": "channel_id", "payment_methods": "payment_method_id", "distribution_centers": "dc_id",
    "stores": "store_id", "calendar_date": "date_id", "product_categories": "category_id", "suppliers": "supplier_id",
    "customers": "customer_id", "loyalty_accounts": "loyalty_account_id", "customer_addresses": "address_id", "products": "product_id",
    "product_suppliers": "product_supplier_id", "employees": "employee_id", "promotions": "promotion_id", "marketing_campaigns": "campaign_id",
    "orders": "order_id", "order_items": "order_item_id", "order_item_promotions": "order_item_promotion_id", "payments": "payment_id",
    "shipments": "shipment_id", "shipment_items": "shipment_item_id", "returns": "return_id", "return_items": "return_item_id",
    "inventory": "inventory_id", "inventory_transactions": "inventory_txn_id", "inventory_snapshots": "snapshot_id",
    "purchase_orders": "purchase_order_id", "purchase_order_items": "po_item_id", "goods_receipts": "receipt_id",
    "goods_receipt_items": "receipt_item_id", "campaign_responses": "campaign_response_id", "store_labor_hours": "labor_hours_id",
    "price_history": "price_history_id", "cost_history": "cost_history_id",
}

# Columns that may be NULL; all others of a table are required.
OPTIONAL = {
    "stores": "latitude longitude selling_sq_ft close_date", "calendar_date": "holiday_name season_name", "product_categories": "parent_category_id",
    "suppliers": "payment_terms_days",
    "customers": "first_name last_name email_hash phone_hash birth_year gender_code acquisition_channel_id preferred_store_id",
    "products": "brand_name primary_supplier_id launch_date discontinue_date", "product_suppliers": "supplier_sku effective_end",
    "employees": "termination_date", "promotions": "discount_percent discount_amount",
    "marketing_campaigns": "channel_id budget_amount actual_spend objective_code", "orders": "store_id employee_id campaign_id",
    "order_items": "promotion_id", "payments": "authorization_code",
    "shipments": "dc_id store_id carrier_name tracking_number ship_date delivery_date", "return_items": "return_reason_code",
    "inventory": "store_id dc_id reorder_point max_stock", "inventory_transactions": "store_id dc_id unit_cost reference_id",
    "inventory_snapshots": "store_id dc_id", "purchase_orders": "expected_receipt_date", "goods_receipts": "is_on_time",
    "campaign_responses": "order_id attributed_revenue", "store_labor_hours": "employee_id labor_cost",
    "price_history": "effective_end", "cost_history": "effective_end",
}

UNIQUE = [
    ("uq_regions_code", "regions", "region_code"), ("uq_regions_name", "regions", "region_name"), ("uq_channels_code", "channels", "channel_code"),
    ("uq_payment_methods_code", "payment_methods", "method_code"), ("uq_distribution_centers_code", "distribution_centers", "dc_code"),
    ("uq_stores_code", "stores", "store_code"), ("uq_calendar_date", "calendar_date", "full_date"),
    ("uq_product_categories_code", "product_categories", "category_code"), ("uq_suppliers_code", "suppliers", "supplier_code"),
    ("uq_customers_number", "customers", "customer_number"), ("uq_loyalty_number", "loyalty_accounts", "loyalty_number"),
    ("uq_loyalty_customer", "loyalty_accounts", "customer_id"), ("uq_products_sku", "products", "sku"),
    ("uq_product_suppliers_start", "product_suppliers", "product_id supplier_id effective_start"),
    ("uq_employees_number", "employees", "employee_number"), ("uq_promotions_code", "promotions", "promotion_code"),
    ("uq_campaigns_code", "marketing_campaigns", "campaign_code"), ("uq_orders_number", "orders", "order_number"),
    ("uq_order_items_line", "order_items", "order_id line_number"), ("uq_order_item_promotions", "order_item_promotions", "order_item_id promotion_id"),
    ("uq_inventory_position", "inventory", "product_id location_type store_id dc_id"),
    ("uq_snapshot_position", "inventory_snapshots", "snapshot_date product_id location_type store_id dc_id"),
    ("uq_purchase_orders_number", "purchase_orders", "po_number"), ("uq_purchase_order_items_line", "purchase_order_items", "purchase_order_id line_number"),
]

# Referenced key by the name of the referring column; exceptions below.
REFERS = {
    "region_id": "regions", "channel_id": "channels", "dc_id": "distribution_centers", "store_id": "stores", "customer_id": "customers",
    "product_id": "products", "supplier_id": "suppliers", "category_id": "product_categories", "employee_id": "employees",
    "promotion_id": "promotions", "campaign_id": "marketing_campaigns", "order_id": "orders", "order_item_id": "order_items",
    "payment_method_id": "payment_methods", "shipment_id": "shipments", "return_id": "returns", "purchase_order_id": "purchase_orders",
    "po_item_id": "purchase_order_items", "receipt_id": "goods_receipts", "parent_category_id": "product_categories",
    "acquisition_channel_id": "channels", "preferred_store_id": "stores", "primary_supplier_id": "suppliers",
}
CALENDAR_DATES = {"orders": "order_date", "returns": "return_date", "inventory_transactions": "txn_date", "inventory_snapshots": "snapshot_date",
                  "purchase_orders": "order_date", "goods_receipts": "receipt_date", "store_labor_hours": "work_date"}

DOMAINS = [
    ("channels", "channel_group", "Physical Digital"), ("stores", "store_format", "Flagship Standard Outlet"),
    ("suppliers", "supplier_tier", "Strategic Preferred Standard"), ("customers", "customer_type", "Loyalty Guest Corporate"),
    ("customers", "gender_code", "M F U N"), ("loyalty_accounts", "tier_code", "Bronze Silver Gold Platinum"),
    ("loyalty_accounts", "status_code", "Active Suspended Closed"), ("customer_addresses", "address_type", "Shipping Billing Both"),
    ("promotions", "promotion_type", "PercentOff AmountOff BOGO Bundle FreeShipping"),
    ("marketing_campaigns", "campaign_type", "Email SMS Social Display InStore Promo"),
    ("marketing_campaigns", "status_code", "Planned Active Closed Cancelled"),
    ("orders", "order_status", "Pending Completed Cancelled Returned PartiallyReturned"), ("orders", "currency_code", "USD"),
    ("payments", "payment_status", "Authorized Captured Voided Refunded Failed"),
    ("shipments", "shipment_status", "Pending Shipped InTransit Delivered Cancelled"),
    ("returns", "return_status", "Requested Approved Completed Rejected"),
    ("return_items", "return_reason_code", "SIZE DEFECT CHANGED_MIND LATE WRONG_ITEM OTHER"), ("inventory", "location_type", "STORE DC"),
    ("inventory_transactions", "location_type", "STORE DC"),
    ("inventory_transactions", "txn_type", "RECEIPT SALE RETURN_RESTOCK ADJUSTMENT TRANSFER_IN TRANSFER_OUT SHRINK"),
    ("inventory_snapshots", "location_type", "STORE DC"), ("purchase_orders", "po_status", "Open Partial Closed Cancelled"),
    ("campaign_responses", "response_type", "Sent Open Click Convert Unsubscribe"),
]

RANGES = [
    ("distribution_centers", "capacity_units", 1, None), ("stores", "selling_sq_ft", 1, None), ("stores", "latitude", -90, 90),
    ("stores", "longitude", -180, 180), ("calendar_date", "day_of_week", 1, 7), ("calendar_date", "week_of_year", 1, 53),
    ("calendar_date", "month_number", 1, 12), ("calendar_date", "quarter_number", 1, 4), ("calendar_date", "fiscal_quarter", 1, 4),
    ("product_categories", "category_level", 1, 3), ("suppliers", "payment_terms_days", 1, None), ("suppliers", "lead_time_days_avg", 1, 120),
    ("suppliers", "reliability_score", 0, 1), ("customers", "birth_year", 1920, None), ("loyalty_accounts", "points_balance", 0, None),
    ("products", "current_list_price", 0, None), ("products", "current_unit_cost", 0, None), ("product_suppliers", "unit_cost", 0, None),
    ("promotions", "discount_percent", 0, 90), ("promotions", "discount_amount", 0, None), ("marketing_campaigns", "budget_amount", 0, None),
    ("marketing_campaigns", "actual_spend", 0, None), ("marketing_campaigns", "lift_factor", 0.5, 3.0), ("orders", "gross_amount", 0, None),
    ("orders", "discount_amount", 0, None), ("orders", "tax_amount", 0, None), ("orders", "shipping_amount", 0, None),
    ("orders", "net_amount", 0, None), ("orders", "total_amount", 0, None), ("order_items", "line_number", 1, None),
    ("order_items", "quantity", 1, None), ("order_items", "unit_price", 0, None), ("order_items", "unit_cost", 0, None),
    ("order_items", "discount_amount", 0, None), ("order_items", "line_net_amount", 0, None),
    ("order_item_promotions", "discount_allocated", 0, None), ("payments", "payment_amount", 0.01, None),
    ("shipment_items", "quantity_shipped", 1, None), ("returns", "refund_amount", 0, None), ("return_items", "quantity_returned", 1, None),
    ("return_items", "unit_refund_amount", 0, None), ("inventory", "quantity_on_hand", 0, None), ("inventory", "quantity_reserved", 0, None),
    ("inventory", "quantity_available", 0, None), ("inventory", "reorder_point", 0, None), ("inventory_snapshots", "quantity_on_hand", 0, None),
    ("inventory_snapshots", "quantity_reserved", 0, None), ("inventory_snapshots", "quantity_available", 0, None),
    ("purchase_order_items", "quantity_ordered", 1, None), ("purchase_order_items", "unit_cost", 0, None),
    ("goods_receipt_items", "quantity_received", 1, None), ("campaign_responses", "attributed_revenue", 0, None),
    ("store_labor_hours", "labor_cost", 0, None), ("price_history", "list_price", 0, None), ("cost_history", "unit_cost", 0, None),
]

ONE_LOCATION = "CASE location_type WHEN 'STORE' THEN store_id IS NOT NULL AND dc_id IS NULL WHEN 'DC' THEN dc_id IS NOT NULL AND store_id IS NULL ELSE FALSE END"
ROWS = [
    ("ck_regions_country", "regions", "regexp_like(country_code, '^[A-Z]{2}$')"),
    ("ck_stores_dates", "stores", "close_date >= open_date"),
    ("ck_stores_active_close", "stores", "NOT is_active OR close_date IS NULL"),
    ("ck_calendar_holiday", "calendar_date", "is_holiday = (holiday_name IS NOT NULL)"),
    ("ck_customers_birth_year", "customers", "birth_year <= year(current_date())"),
    ("ck_products_margin", "products", "current_unit_cost <= current_list_price * 1.05"),
    ("ck_products_dates", "products", "discontinue_date >= launch_date"),
    ("ck_products_popularity", "products", "popularity_score > 0"),
    ("ck_product_suppliers_dates", "product_suppliers", "effective_end >= effective_start"),
    ("ck_employees_dates", "employees", "termination_date >= hire_date"),
    ("ck_promotions_dates", "promotions", "end_date >= start_date"),
    ("ck_campaigns_dates", "marketing_campaigns", "end_date >= start_date"),
    ("ck_orders_discount_le_gross", "orders", "discount_amount <= gross_amount"),
    ("ck_orders_ts_date", "orders", "CAST(order_timestamp AS DATE) = order_date"),
    ("ck_order_items_net", "order_items", "line_net_amount <= line_gross_amount"),
    ("ck_shipments_dates", "shipments", "delivery_date >= ship_date"),
    ("ck_shipments_origin", "shipments", "(dc_id IS NULL OR store_id IS NULL) AND (coalesce(dc_id, store_id) IS NOT NULL OR shipment_status IN ('Pending', 'Cancelled'))"),
    ("ck_inventory_reserved_le_onhand", "inventory", "quantity_reserved <= quantity_on_hand"),
    ("ck_inventory_available_calc", "inventory", "quantity_available + quantity_reserved = quantity_on_hand"),
    ("ck_inventory_location_xor", "inventory", ONE_LOCATION),
    ("ck_inventory_max", "inventory", "max_stock >= reorder_point"),
    ("ck_inventory_transactions_delta", "inventory_transactions", "quantity_delta <> 0"),
    ("ck_inventory_transactions_location_xor", "inventory_transactions", ONE_LOCATION),
    ("ck_snapshots_reserved_le_onhand", "inventory_snapshots", "quantity_reserved <= quantity_on_hand"),
    ("ck_snapshots_location_xor", "inventory_snapshots", ONE_LOCATION),
    ("ck_po_dates", "purchase_orders", "expected_receipt_date >= order_date"),
    ("ck_labor_hours", "store_labor_hours", "labor_hours > 0 AND labor_hours <= CASE WHEN employee_id IS NULL THEN 500 ELSE 24 END"),
    ("ck_price_history_dates", "price_history", "effective_end >= effective_start"),
    ("ck_cost_history_dates", "cost_history", "effective_end >= effective_start"),
]


def columns_of(table: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) ", DDL[table])


def _rules():
    for t, k in PRIMARY_KEYS.items():
        key = (k,)
        yield Rule(f"pk_{t}_unique", t, "unique", key, key=key)
        for c in columns_of(t):
            if c not in OPTIONAL.get(t, "").split():
                yield Rule(f"nn_{t}_{c}", t, "not_null", (c,), key=key)
            parent = REFERS.get(c)
            if parent and c != k:
                yield Rule(f"fk_{t}_{c}", t, "foreign_key", (c,), parent, (PRIMARY_KEYS[parent],), key=key)
        if t in CALENDAR_DATES:
            yield Rule(f"fk_{t}_{CALENDAR_DATES[t]}", t, "foreign_key", (CALENDAR_DATES[t],), "calendar_date", ("full_date",), key=key)
    for name, t, cols in UNIQUE:
        yield Rule(name, t, "unique", tuple(cols.split()), key=(PRIMARY_KEYS[t],))
    for t, c, values in DOMAINS:
        yield Rule(f"ck_{t}_{c}", t, "domain", (c,), values=tuple(values.split()), key=(PRIMARY_KEYS[t],))
    for t, c, low, high in RANGES:
        yield Rule(f"ck_{t}_{c}_range", t, "range", (c,), low=low, high=high, key=(PRIMARY_KEYS[t],))
    for name, t, condition in ROWS:
        used = tuple(c for c in columns_of(t) if re.search(rf"\b{c}\b", condition))
        yield Rule(name, t, "row", used, condition=condition, key=(PRIMARY_KEYS[t],))


RULES: list[Rule] = list(_rules())
EDGES: list[tuple[str, str]] = [(r.table, r.ref_table) for r in RULES if r.kind == "foreign_key"]
