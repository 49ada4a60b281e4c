"""Typed schemas of the 35 relational tables (DDL strings -> StructType).

Timestamps without zone are ``timestamp_ntz``; money is DECIMAL(18,2).
Constraints live in ``operators.integrity``.
"""

from __future__ import annotations

from pyspark.sql import types as T

M = "decimal(18,2)"
TS = "timestamp_ntz"

# Column lists and types of the relational model.
DDL: dict[str, str] = {
    "regions": f"region_id int, region_code string, region_name string, country_code string, is_active boolean, "
               f"created_at {TS}, updated_at {TS}",
    "channels": f"channel_id int, channel_code string, channel_name string, channel_group string, is_active boolean, "
                f"created_at {TS}",
    "payment_methods": "payment_method_id int, method_code string, method_name string, method_group string, "
                       "is_active boolean",
    "distribution_centers": f"dc_id int, dc_code string, dc_name string, region_id int, city string, state_code string, "
                            f"postal_code string, capacity_units int, is_active boolean, created_at {TS}, updated_at {TS}",
    "stores": f"store_id int, store_code string, store_name string, region_id int, store_format string, "
              f"address_line1 string, city string, state_code string, postal_code string, latitude decimal(9,6), "
              f"longitude decimal(9,6), selling_sq_ft int, open_date date, close_date date, is_active boolean, "
              f"created_at {TS}, updated_at {TS}",
    "calendar_date": "date_id int, full_date date, day_of_week short, day_name string, week_of_year short, "
                     "month_number short, month_name string, quarter_number short, year_number int, fiscal_year int, "
                     "fiscal_quarter short, is_weekend boolean, is_holiday boolean, holiday_name string, "
                     "season_name string",
    "product_categories": f"category_id int, category_code string, category_name string, parent_category_id int, "
                          f"category_level short, is_active boolean, created_at {TS}",
    "suppliers": f"supplier_id int, supplier_code string, supplier_name string, supplier_tier string, "
                 f"country_code string, payment_terms_days int, lead_time_days_avg int, reliability_score decimal(5,4), "
                 f"is_active boolean, created_at {TS}, updated_at {TS}",
    "customers": f"customer_id bigint, customer_number string, customer_type string, first_name string, "
                 f"last_name string, email_hash string, phone_hash string, birth_year int, gender_code string, "
                 f"registration_date date, acquisition_channel_id int, preferred_store_id int, is_active boolean, "
                 f"created_at {TS}, updated_at {TS}",
    "loyalty_accounts": f"loyalty_account_id bigint, customer_id bigint, loyalty_number string, tier_code string, "
                        f"enroll_date date, points_balance int, status_code string, created_at {TS}, updated_at {TS}",
    "customer_addresses": f"address_id bigint, customer_id bigint, address_type string, address_line1 string, "
                          f"city string, state_code string, postal_code string, country_code string, "
                          f"is_primary boolean, created_at {TS}",
    "products": f"product_id bigint, sku string, product_name string, brand_name string, category_id int, "
                f"primary_supplier_id int, unit_of_measure string, current_list_price {M}, current_unit_cost {M}, "
                f"popularity_score decimal(12,8), is_active boolean, launch_date date, discontinue_date date, "
                f"created_at {TS}, updated_at {TS}",
    "product_suppliers": f"product_supplier_id int, product_id bigint, supplier_id int, is_primary boolean, "
                         f"supplier_sku string, unit_cost {M}, effective_start date, effective_end date",
    "employees": f"employee_id int, employee_number string, store_id int, first_name string, last_name string, "
                 f"job_title string, hire_date date, termination_date date, is_active boolean, created_at {TS}, "
                 f"updated_at {TS}",
    "promotions": f"promotion_id int, promotion_code string, promotion_name string, promotion_type string, "
                  f"discount_percent decimal(5,2), discount_amount {M}, start_date date, end_date date, "
                  f"is_stackable boolean, is_active boolean",
    "marketing_campaigns": f"campaign_id int, campaign_code string, campaign_name string, campaign_type string, "
                           f"channel_id int, start_date date, end_date date, budget_amount {M}, actual_spend {M}, "
                           f"objective_code string, lift_factor decimal(6,4), status_code string, created_at {TS}",
    "orders": f"order_id bigint, order_number string, customer_id bigint, store_id int, channel_id int, "
              f"order_date date, order_timestamp {TS}, order_status string, currency_code string, gross_amount {M}, "
              f"discount_amount {M}, tax_amount {M}, shipping_amount {M}, net_amount {M}, total_amount {M}, "
              f"employee_id int, campaign_id int, created_at {TS}, updated_at {TS}",
    "order_items": f"order_item_id bigint, order_id bigint, line_number int, product_id bigint, quantity int, "
                   f"unit_price {M}, unit_cost {M}, discount_amount {M}, line_gross_amount {M}, line_net_amount {M}, "
                   f"line_cogs_amount {M}, promotion_id int, is_gift boolean",
    "order_item_promotions": f"order_item_promotion_id bigint, order_item_id bigint, promotion_id int, "
                             f"discount_allocated {M}",
    "payments": f"payment_id bigint, order_id bigint, payment_method_id int, payment_timestamp {TS}, "
                f"payment_amount {M}, authorization_code string, payment_status string, created_at {TS}",
    "shipments": f"shipment_id bigint, order_id bigint, dc_id int, store_id int, carrier_name string, "
                 f"tracking_number string, shipment_status string, ship_date date, delivery_date date, created_at {TS}",
    "shipment_items": "shipment_item_id bigint, shipment_id bigint, order_item_id bigint, product_id bigint, "
                      "quantity_shipped int",
    "returns": f"return_id bigint, order_id bigint, customer_id bigint, return_date date, return_status string, "
               f"refund_amount {M}, created_at {TS}",
    "return_items": f"return_item_id bigint, return_id bigint, order_item_id bigint, product_id bigint, "
                    f"quantity_returned int, unit_refund_amount {M}, restock_flag boolean, return_reason_code string",
    "inventory": f"inventory_id bigint, product_id bigint, location_type string, store_id int, dc_id int, "
                 f"quantity_on_hand int, quantity_reserved int, quantity_available int, reorder_point int, "
                 f"max_stock int, as_of_timestamp {TS}",
    "inventory_transactions": f"inventory_txn_id bigint, product_id bigint, location_type string, store_id int, "
                              f"dc_id int, txn_type string, txn_date date, quantity_delta int, unit_cost {M}, "
                              f"reference_id string, created_at {TS}",
    "inventory_snapshots": f"snapshot_id bigint, snapshot_date date, product_id bigint, location_type string, "
                           f"store_id int, dc_id int, quantity_on_hand int, quantity_reserved int, "
                           f"quantity_available int, inventory_value_cost {M}",
    "purchase_orders": f"purchase_order_id bigint, po_number string, supplier_id int, dc_id int, order_date date, "
                       f"expected_receipt_date date, po_status string, created_at {TS}",
    "purchase_order_items": f"po_item_id bigint, purchase_order_id bigint, line_number int, product_id bigint, "
                            f"quantity_ordered int, unit_cost {M}",
    "goods_receipts": f"receipt_id bigint, purchase_order_id bigint, dc_id int, receipt_date date, is_on_time boolean, "
                      f"created_at {TS}",
    "goods_receipt_items": "receipt_item_id bigint, receipt_id bigint, po_item_id bigint, product_id bigint, "
                           "quantity_received int",
    "campaign_responses": f"campaign_response_id bigint, campaign_id int, customer_id bigint, response_timestamp {TS}, "
                          f"response_type string, order_id bigint, attributed_revenue {M}",
    "store_labor_hours": f"labor_hours_id bigint, store_id int, employee_id int, work_date date, "
                         f"labor_hours decimal(8,2), labor_cost {M}",
    "price_history": f"price_history_id bigint, product_id bigint, list_price {M}, effective_start date, "
                     f"effective_end date",
    "cost_history": f"cost_history_id bigint, product_id bigint, unit_cost {M}, effective_start date, "
                    f"effective_end date",
}

# Model-output staging tables.
STAGING_DDL: dict[str, str] = {
    "stg_churn_predictions": "customer_id bigint, churn_probability double, churn_predicted int, churn_actual int, "
                             "model_name string, threshold double",
    "stg_profit_predictions": "order_id bigint, customer_id bigint, order_date date, net_sales decimal(38,10), "
                              "margin_pct double, is_profitable int, profit_probability double, profit_predicted int, "
                              "model_name string",
    "stg_sales_forecast_predictions": "ds date, y_true decimal(38,10), seasonal_naive decimal(38,10), "
                                      "sarimax decimal(38,10), sarimax_lower decimal(38,10), "
                                      "sarimax_upper decimal(38,10), ml_xgboost decimal(38,10), "
                                      "forecast_horizon string, yhat decimal(38,10), yhat_lower decimal(38,10), "
                                      "yhat_upper decimal(38,10), model_used string",
}


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def schema(table: str) -> T.StructType:
    return struct_of(DDL.get(table) or STAGING_DDL[table])
