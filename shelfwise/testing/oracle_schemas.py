"""Output column types per query (the output convention of ``registry.present``)."""

SCHEMAS = {
    'c1_c2_keys': [("rule", "VARCHAR"), ("table", "VARCHAR"), ("kind", "VARCHAR"), ("status", "VARCHAR"), ("violations", "BIGINT")],
    'c3_foreign_keys': [("rule", "VARCHAR"), ("table", "VARCHAR"), ("kind", "VARCHAR"), ("status", "VARCHAR"), ("violations", "BIGINT")],
    'c4_c5_domains_ranges': [("rule", "VARCHAR"), ("table", "VARCHAR"), ("kind", "VARCHAR"), ("status", "VARCHAR"), ("violations", "BIGINT")],
    'c6_c7_row_checks': [("rule", "VARCHAR"), ("table", "VARCHAR"), ("kind", "VARCHAR"), ("status", "VARCHAR"), ("violations", "BIGINT")],
    'fn1_monthly_revenue': [("year_number", "BIGINT"), ("month_number", "BIGINT"), ("month_start", "DATE"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("order_count", "BIGINT"), ("yoy_net_sales", "DOUBLE"), ("yoy_growth_pct", "DOUBLE")],
    'fn1_monthly_revenue_sql': [("year_number", "BIGINT"), ("month_number", "BIGINT"), ("month_start", "DATE"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("order_count", "BIGINT"), ("yoy_net_sales", "DOUBLE"), ("yoy_growth_pct", "DOUBLE")],
    'fn2_store_performance': [("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("region_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("aov", "DOUBLE"), ("units_sold", "BIGINT"), ("sales_rank", "BIGINT"), ("sales_per_sqft", "DOUBLE")],
    'fn2_store_performance_sql': [("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("region_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("aov", "DOUBLE"), ("units_sold", "BIGINT"), ("sales_rank", "BIGINT"), ("sales_per_sqft", "DOUBLE")],
    'fn3_customer_rfm_asof': [("customer_id", "BIGINT"), ("recency_days", "BIGINT"), ("frequency", "BIGINT"), ("monetary", "DOUBLE"), ("r_score", "BIGINT"), ("f_score", "BIGINT"), ("m_score", "BIGINT"), ("rfm_segment", "VARCHAR")],
    'fn4_category_contribution': [("category_code", "VARCHAR"), ("category_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("units_sold", "BIGINT"), ("contribution_pct", "DOUBLE"), ("sales_rank", "BIGINT"), ("cumulative_pct", "DOUBLE")],
    'fn4_category_contribution_sql': [("category_code", "VARCHAR"), ("category_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("units_sold", "BIGINT"), ("contribution_pct", "DOUBLE"), ("sales_rank", "BIGINT"), ("cumulative_pct", "DOUBLE")],
    'fn5_executive_scorecard': [("net_sales", "DOUBLE"), ("prior_period_net_sales", "DOUBLE"), ("sales_growth_pct", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("aov", "DOUBLE"), ("active_customers", "BIGINT"), ("return_rate_value", "DOUBLE"), ("avg_fulfillment_days", "DOUBLE")],
    'fn5_executive_scorecard_sql': [("net_sales", "DOUBLE"), ("prior_period_net_sales", "DOUBLE"), ("sales_growth_pct", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("aov", "DOUBLE"), ("active_customers", "BIGINT"), ("return_rate_value", "DOUBLE"), ("avg_fulfillment_days", "DOUBLE")],
    'k01_dashboard_overview': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k02_dashboard_trends': [("date", "DATE"), ("revenue", "DOUBLE"), ("profit", "DOUBLE"), ("orders", "BIGINT")],
    'k03_dashboard_regional': [("region", "VARCHAR"), ("revenue", "DOUBLE"), ("profit", "DOUBLE"), ("growth", "DOUBLE"), ("order_count", "BIGINT")],
    'k04_top_risks': [("id", "VARCHAR"), ("title", "VARCHAR"), ("description", "VARCHAR"), ("priority", "VARCHAR"), ("impact", "VARCHAR"), ("owner", "VARCHAR"), ("source", "VARCHAR"), ("rank", "BIGINT")],
    'k05_opportunities': [("id", "VARCHAR"), ("title", "VARCHAR"), ("description", "VARCHAR"), ("estimated_impact", "VARCHAR"), ("priority", "VARCHAR"), ("source", "VARCHAR")],
    'k06_sales_overview': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k06_sales_overview_category_search': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k06_sales_overview_filtered': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k07_sales_trends': [("period", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "BIGINT"), ("profit", "DOUBLE")],
    'k07_sales_trends_weekly': [("period", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "BIGINT"), ("profit", "DOUBLE")],
    'k07_sales_trends_monthly': [("period", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "BIGINT"), ("profit", "DOUBLE")],
    'k08_category_performance': [("category", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "DOUBLE"), ("growth", "DOUBLE"), ("margin", "DOUBLE")],
    'k08_category_performance_filtered': [("category", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "DOUBLE"), ("growth", "DOUBLE"), ("margin", "DOUBLE")],
    'k09_product_performance': [("product_id", "VARCHAR"), ("product", "VARCHAR"), ("sku", "VARCHAR"), ("category", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "DOUBLE"), ("units", "DOUBLE"), ("margin", "DOUBLE"), ("growth", "DOUBLE"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k09_product_performance_margin_p2': [("product_id", "VARCHAR"), ("product", "VARCHAR"), ("sku", "VARCHAR"), ("category", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "DOUBLE"), ("units", "DOUBLE"), ("margin", "DOUBLE"), ("growth", "DOUBLE"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k10_regional_performance': [("region", "VARCHAR"), ("revenue", "DOUBLE"), ("growth", "DOUBLE"), ("orders", "BIGINT")],
    'k11_top_customers': [("customer", "VARCHAR"), ("customer_id", "VARCHAR"), ("revenue", "DOUBLE"), ("orders", "DOUBLE"), ("lifetime_value", "DOUBLE"), ("lifetime_value_available", "BOOLEAN")],
    'k12_customer_overview': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k13_rfm_segments': [("segment", "VARCHAR"), ("customer_count", "DOUBLE"), ("revenue", "DOUBLE"), ("average_order_value", "DOUBLE"), ("growth", "DOUBLE")],
    'k13_rfm_segments_filtered': [("segment", "VARCHAR"), ("customer_count", "DOUBLE"), ("revenue", "DOUBLE"), ("average_order_value", "DOUBLE"), ("growth", "DOUBLE")],
    'k14_cohorts': [("cohort", "VARCHAR"), ("cohort_size", "DOUBLE"), ("month_offset", "BIGINT"), ("retention_pct", "DOUBLE"), ("customer_count", "DOUBLE")],
    'k14_cohorts_3m': [("cohort", "VARCHAR"), ("cohort_size", "DOUBLE"), ("month_offset", "BIGINT"), ("retention_pct", "DOUBLE"), ("customer_count", "DOUBLE")],
    'k15_customer_distribution': [("region", "VARCHAR"), ("customer_count", "DOUBLE"), ("revenue", "DOUBLE"), ("growth", "DOUBLE")],
    'k16_top_customers_detail': [("customer_id", "VARCHAR"), ("customer", "VARCHAR"), ("segment", "VARCHAR"), ("region", "VARCHAR"), ("lifetime_value", "DOUBLE"), ("orders", "DOUBLE"), ("average_order_value", "DOUBLE"), ("lifecycle_status", "VARCHAR"), ("last_order_date", "DATE"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k16_top_customers_detail_orders_p3': [("customer_id", "VARCHAR"), ("customer", "VARCHAR"), ("segment", "VARCHAR"), ("region", "VARCHAR"), ("lifetime_value", "DOUBLE"), ("orders", "DOUBLE"), ("average_order_value", "DOUBLE"), ("lifecycle_status", "VARCHAR"), ("last_order_date", "DATE"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k17_churn_risk': [("risk_level", "VARCHAR"), ("customer_count", "DOUBLE"), ("predicted_revenue_at_risk", "DOUBLE"), ("confidence", "DOUBLE"), ("confidence_available", "BOOLEAN")],
    'k17_churn_risk_lifecycle': [("risk_level", "VARCHAR"), ("customer_count", "DOUBLE"), ("predicted_revenue_at_risk", "DOUBLE"), ("confidence", "DOUBLE"), ("confidence_available", "BOOLEAN")],
    'k17_churn_risk_champions': [("risk_level", "VARCHAR"), ("customer_count", "DOUBLE"), ("predicted_revenue_at_risk", "DOUBLE"), ("confidence", "DOUBLE"), ("confidence_available", "BOOLEAN")],
    'k18_operations_overview': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k19_inventory': [("product", "VARCHAR"), ("product_id", "VARCHAR"), ("sku", "VARCHAR"), ("category", "VARCHAR"), ("stock", "DOUBLE"), ("safety_stock", "DOUBLE"), ("turnover", "DOUBLE"), ("inventory_value", "DOUBLE"), ("stock_status", "VARCHAR"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k19_inventory_by_product_p2': [("product", "VARCHAR"), ("product_id", "VARCHAR"), ("sku", "VARCHAR"), ("category", "VARCHAR"), ("stock", "DOUBLE"), ("safety_stock", "DOUBLE"), ("turnover", "DOUBLE"), ("inventory_value", "DOUBLE"), ("stock_status", "VARCHAR"), ("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'k20_supplier_performance': [("supplier", "VARCHAR"), ("supplier_id", "VARCHAR"), ("on_time_pct", "DOUBLE"), ("quality_score", "DOUBLE"), ("lead_time", "DOUBLE"), ("purchase_volume", "DOUBLE"), ("risk_level", "VARCHAR")],
    'k21_returns_by_category': [("category", "VARCHAR"), ("return_count", "DOUBLE"), ("return_pct", "DOUBLE"), ("return_cost", "DOUBLE"), ("trend", "VARCHAR")],
    'k21_returns_by_category_filtered': [("category", "VARCHAR"), ("return_count", "DOUBLE"), ("return_pct", "DOUBLE"), ("return_cost", "DOUBLE"), ("trend", "VARCHAR")],
    'k22_warehouse_performance': [("warehouse", "VARCHAR"), ("inventory", "DOUBLE"), ("fulfillment", "DOUBLE"), ("stockouts", "DOUBLE"), ("average_processing_time", "DOUBLE")],
    'k22_warehouse_performance_search': [("warehouse", "VARCHAR"), ("inventory", "DOUBLE"), ("fulfillment", "DOUBLE"), ("stockouts", "DOUBLE"), ("average_processing_time", "DOUBLE")],
    'k23_operational_risks': [("risk", "VARCHAR"), ("severity", "VARCHAR"), ("owner", "VARCHAR"), ("recommendation", "VARCHAR")],
    'k24_finance_overview': [("metric_id", "VARCHAR"), ("label", "VARCHAR"), ("value", "DOUBLE"), ("formatted_value", "VARCHAR"), ("delta", "DOUBLE"), ("trend", "VARCHAR"), ("format", "VARCHAR"), ("available", "BOOLEAN")],
    'k25_profitability_by_region': [("region", "VARCHAR"), ("revenue", "DOUBLE"), ("cost", "DOUBLE"), ("profit", "DOUBLE"), ("margin", "DOUBLE"), ("growth", "DOUBLE")],
    'k26_cost_breakdown': [("cost_category", "VARCHAR"), ("amount", "DOUBLE"), ("percentage", "DOUBLE"), ("trend", "VARCHAR")],
    'k27_cashflow': [("period", "VARCHAR"), ("inflows", "DOUBLE"), ("outflows", "DOUBLE"), ("net_cashflow", "DOUBLE"), ("profit", "DOUBLE"), ("margin", "DOUBLE")],
    'k28_financial_risks': [("risk", "VARCHAR"), ("severity", "VARCHAR"), ("estimated_impact", "DOUBLE"), ("owner", "VARCHAR"), ("recommendation", "VARCHAR")],
    'k28_financial_risks_search': [("risk", "VARCHAR"), ("severity", "VARCHAR"), ("estimated_impact", "DOUBLE"), ("owner", "VARCHAR"), ("recommendation", "VARCHAR")],
    'k29_budget_variance': [("department", "VARCHAR"), ("budget", "DOUBLE"), ("actual", "DOUBLE"), ("variance", "DOUBLE"), ("variance_pct", "DOUBLE")],
    'm01': [("product_id", "BIGINT"), ("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("brand_name", "VARCHAR"), ("is_active", "BOOLEAN"), ("current_list_price", "DOUBLE"), ("current_unit_cost", "DOUBLE"), ("primary_supplier_id", "BIGINT"), ("subcategory_id", "BIGINT"), ("subcategory_code", "VARCHAR"), ("subcategory_name", "VARCHAR"), ("category_id", "BIGINT"), ("category_code", "VARCHAR"), ("category_name", "VARCHAR")],
    'm02': [("order_item_id", "BIGINT"), ("order_id", "BIGINT"), ("order_number", "VARCHAR"), ("order_date", "DATE"), ("order_timestamp", "TIMESTAMP"), ("order_status", "VARCHAR"), ("customer_id", "BIGINT"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("campaign_id", "BIGINT"), ("employee_id", "BIGINT"), ("product_id", "BIGINT"), ("line_number", "BIGINT"), ("quantity", "BIGINT"), ("unit_price", "DOUBLE"), ("unit_cost", "DOUBLE"), ("discount_amount", "DOUBLE"), ("line_gross_amount", "DOUBLE"), ("line_net_amount", "DOUBLE"), ("line_cogs_amount", "DOUBLE"), ("line_gross_profit", "DOUBLE"), ("line_margin_pct", "DOUBLE"), ("promotion_id", "BIGINT"), ("is_gift", "BOOLEAN"), ("year_number", "BIGINT"), ("quarter_number", "BIGINT"), ("month_number", "BIGINT"), ("month_name", "VARCHAR"), ("week_of_year", "BIGINT"), ("season_name", "VARCHAR"), ("is_weekend", "BOOLEAN"), ("is_holiday", "BOOLEAN")],
    'm03': [("order_date", "DATE"), ("year_number", "BIGINT"), ("quarter_number", "BIGINT"), ("month_number", "BIGINT"), ("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("store_format", "VARCHAR"), ("region_id", "BIGINT"), ("region_code", "VARCHAR"), ("region_name", "VARCHAR"), ("channel_id", "BIGINT"), ("channel_code", "VARCHAR"), ("channel_name", "VARCHAR"), ("order_count", "BIGINT"), ("units_sold", "BIGINT"), ("gross_sales", "DOUBLE"), ("discount_amount", "DOUBLE"), ("net_sales", "DOUBLE"), ("cogs_amount", "DOUBLE"), ("gross_profit", "DOUBLE")],
    'm04': [("year_number", "BIGINT"), ("month_number", "BIGINT"), ("month_start", "DATE"), ("net_sales", "DOUBLE"), ("gross_sales", "DOUBLE"), ("cogs_amount", "DOUBLE"), ("gross_profit", "DOUBLE"), ("discount_amount", "DOUBLE"), ("order_count", "BIGINT"), ("units_sold", "BIGINT")],
    'm05': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("customer_type", "VARCHAR"), ("registration_date", "DATE"), ("preferred_store_id", "BIGINT"), ("is_active", "BOOLEAN"), ("loyalty_tier", "VARCHAR"), ("points_balance", "BIGINT"), ("order_count", "BIGINT"), ("first_order_date", "DATE"), ("last_order_date", "DATE"), ("lifetime_net_sales", "DOUBLE"), ("lifetime_gross_profit", "DOUBLE"), ("lifetime_units", "BIGINT"), ("avg_order_value", "DOUBLE"), ("days_since_last_order", "BIGINT"), ("lifecycle_status", "VARCHAR")],
    'm06': [("customer_id", "BIGINT"), ("last_order_date", "DATE"), ("order_count", "BIGINT"), ("lifetime_net_sales", "DOUBLE"), ("days_since_last_order", "BIGINT"), ("r_score", "BIGINT"), ("f_score", "BIGINT"), ("m_score", "BIGINT"), ("rfm_total", "BIGINT"), ("rfm_segment", "VARCHAR")],
    'm07': [("inventory_id", "BIGINT"), ("product_id", "BIGINT"), ("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("category_name", "VARCHAR"), ("location_type", "VARCHAR"), ("store_id", "BIGINT"), ("store_name", "VARCHAR"), ("dc_id", "BIGINT"), ("dc_name", "VARCHAR"), ("quantity_on_hand", "BIGINT"), ("quantity_reserved", "BIGINT"), ("quantity_available", "BIGINT"), ("reorder_point", "BIGINT"), ("max_stock", "BIGINT"), ("inventory_value_cost", "DOUBLE"), ("stock_status", "VARCHAR")],
    'm08': [("return_item_id", "BIGINT"), ("return_id", "BIGINT"), ("return_date", "DATE"), ("order_id", "BIGINT"), ("customer_id", "BIGINT"), ("return_status", "VARCHAR"), ("order_item_id", "BIGINT"), ("product_id", "BIGINT"), ("quantity_returned", "BIGINT"), ("unit_refund_amount", "DOUBLE"), ("refund_line_amount", "DOUBLE"), ("restock_flag", "BOOLEAN"), ("return_reason_code", "VARCHAR"), ("order_date", "DATE"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("days_to_return", "BIGINT")],
    'm09': [("supplier_id", "BIGINT"), ("supplier_code", "VARCHAR"), ("supplier_name", "VARCHAR"), ("supplier_tier", "VARCHAR"), ("contracted_lead_time_days", "BIGINT"), ("reliability_score", "DOUBLE"), ("po_count", "BIGINT"), ("units_ordered", "BIGINT"), ("units_received", "BIGINT"), ("fill_rate", "DOUBLE"), ("on_time_rate", "DOUBLE"), ("avg_actual_lead_time_days", "DOUBLE")],
    'm10': [("campaign_id", "BIGINT"), ("campaign_code", "VARCHAR"), ("campaign_name", "VARCHAR"), ("campaign_type", "VARCHAR"), ("start_date", "DATE"), ("end_date", "DATE"), ("budget_amount", "DOUBLE"), ("actual_spend", "DOUBLE"), ("objective_code", "VARCHAR"), ("status_code", "VARCHAR"), ("sent_count", "BIGINT"), ("open_count", "BIGINT"), ("click_count", "BIGINT"), ("convert_count", "BIGINT"), ("response_attributed_revenue", "DOUBLE"), ("order_net_sales", "DOUBLE"), ("order_gross_profit", "DOUBLE"), ("attributed_orders", "BIGINT"), ("attributed_customers", "BIGINT"), ("conversion_rate", "DOUBLE"), ("campaign_roi", "DOUBLE")],
    'm11': [("shipment_id", "BIGINT"), ("order_id", "BIGINT"), ("order_date", "DATE"), ("dc_id", "BIGINT"), ("dc_code", "VARCHAR"), ("dc_name", "VARCHAR"), ("store_id", "BIGINT"), ("carrier_name", "VARCHAR"), ("shipment_status", "VARCHAR"), ("ship_date", "DATE"), ("delivery_date", "DATE"), ("fulfillment_lead_time_days", "BIGINT"), ("transit_days", "BIGINT"), ("delay_flag", "VARCHAR")],
    'm12': [("order_date", "DATE"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("units_sold", "BIGINT"), ("aov", "DOUBLE"), ("refund_amount", "DOUBLE"), ("units_returned", "BIGINT"), ("stockout_positions", "BIGINT"), ("snapshot_positions", "BIGINT")],
    'm13': [("payment_method_id", "BIGINT"), ("method_code", "VARCHAR"), ("method_name", "VARCHAR"), ("method_group", "VARCHAR"), ("payment_month", "DATE"), ("payment_count", "BIGINT"), ("payment_amount", "DOUBLE")],
    'm14': [("model_name", "VARCHAR"), ("entity_type", "VARCHAR"), ("entity_id", "VARCHAR"), ("customer_id", "VARCHAR"), ("score", "DOUBLE"), ("churn_probability", "DOUBLE"), ("label", "VARCHAR"), ("prediction_date", "DATE"), ("as_of_date", "DATE"), ("confidence", "DOUBLE"), ("model_version", "VARCHAR"), ("prediction_source", "VARCHAR"), ("title", "VARCHAR"), ("explanation", "VARCHAR"), ("estimated_impact", "DOUBLE")],
    'm15': [("check_date", "DATE"), ("as_of_date", "DATE"), ("check_name", "VARCHAR"), ("entity_name", "VARCHAR"), ("namespace", "VARCHAR"), ("score", "DOUBLE"), ("severity", "VARCHAR"), ("message", "VARCHAR"), ("description", "VARCHAR"), ("overall_score", "DOUBLE"), ("dq_score", "DOUBLE"), ("quality_score", "DOUBLE"), ("owner", "VARCHAR"), ("missing_value_pct", "DOUBLE"), ("duplicate_pct", "DOUBLE"), ("freshness", "DOUBLE"), ("validity", "DOUBLE"), ("consistency", "DOUBLE"), ("completeness", "DOUBLE"), ("invalid_records", "BIGINT")],
    'q01': [("year_number", "BIGINT"), ("month_number", "BIGINT"), ("month_name", "VARCHAR"), ("month_start", "DATE"), ("net_sales", "DOUBLE"), ("order_count", "BIGINT")],
    'q02': [("year_number", "BIGINT"), ("quarter_number", "BIGINT"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("order_count", "BIGINT")],
    'q03': [("month_start", "DATE"), ("net_sales", "DOUBLE"), ("prior_year_sales", "DOUBLE"), ("yoy_growth_pct", "DOUBLE")],
    'q04': [("region_code", "VARCHAR"), ("region_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("order_count", "BIGINT"), ("region_share_pct", "DOUBLE")],
    'q05': [("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("store_format", "VARCHAR"), ("region_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("sales_per_sqft", "DOUBLE"), ("sales_rank", "BIGINT")],
    'q06': [("product_id", "BIGINT"), ("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("units_sold", "BIGINT"), ("order_count", "BIGINT")],
    'q07': [("category_code", "VARCHAR"), ("category_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_profit", "DOUBLE"), ("units_sold", "BIGINT")],
    'q08': [("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("units_sold", "BIGINT"), ("sales_rank", "BIGINT")],
    'q09': [("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("units_sold", "BIGINT"), ("sales_rank_asc", "BIGINT")],
    'q10': [("month_start", "DATE"), ("aov", "DOUBLE"), ("order_count", "BIGINT")],
    'q11': [("month_start", "DATE"), ("units_per_transaction", "DOUBLE"), ("lines_per_order", "DOUBLE")],
    'q12': [("season_name", "VARCHAR"), ("day_name", "VARCHAR"), ("is_weekend", "BOOLEAN"), ("avg_daily_net_sales", "DOUBLE")],
    'q13': [("order_date", "DATE"), ("daily_net_sales", "DOUBLE"), ("running_revenue", "DOUBLE")],
    'q14': [("month_start", "DATE"), ("net_sales", "DOUBLE"), ("rolling_3mo_revenue", "DOUBLE"), ("rolling_3mo_avg", "DOUBLE")],
    'q15': [("category_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("contribution_pct", "DOUBLE"), ("cumulative_pct", "DOUBLE")],
    'q16': [("region_name", "VARCHAR"), ("channel_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("is_region_total", "BIGINT"), ("is_channel_total", "BIGINT")],
    'q17': [("month_start", "DATE"), ("net_sales", "DOUBLE"), ("prior_month", "DOUBLE"), ("mom_growth_pct", "DOUBLE"), ("next_month_sales", "DOUBLE")],
    'q18': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("customer_type", "VARCHAR"), ("loyalty_tier", "VARCHAR"), ("order_count", "BIGINT"), ("lifetime_net_sales", "DOUBLE"), ("historical_clv", "DOUBLE"), ("lifecycle_status", "VARCHAR")],
    'q19': [("rfm_segment", "VARCHAR"), ("customer_count", "BIGINT"), ("avg_monetary", "DOUBLE"), ("avg_frequency", "DOUBLE"), ("avg_recency_days", "DOUBLE")],
    'q20': [("customers_with_orders", "BIGINT"), ("repeat_customers", "BIGINT"), ("repeat_purchase_rate", "DOUBLE")],
    'q21': [("month_start", "DATE"), ("customer_status", "VARCHAR"), ("customers", "BIGINT")],
    'q22': [("cohort_month", "DATE"), ("activity_month", "DATE"), ("months_since_acquisition", "BIGINT"), ("active_customers", "BIGINT")],
    'q23': [("prior_month", "DATE"), ("current_month", "DATE"), ("prior_buyers", "BIGINT"), ("retained_buyers", "BIGINT"), ("retention_rate", "DOUBLE")],
    'q24': [("lifecycle_status", "VARCHAR"), ("customers", "BIGINT"), ("historical_sales_at_risk", "DOUBLE"), ("avg_days_inactive", "DOUBLE")],
    'q25': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("loyalty_tier", "VARCHAR"), ("order_count", "BIGINT"), ("historical_clv", "DOUBLE"), ("lifetime_net_sales", "DOUBLE"), ("value_rank", "BIGINT")],
    'q26': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("customer_type", "VARCHAR"), ("last_order_date", "DATE"), ("days_since_last_order", "BIGINT"), ("lifetime_net_sales", "DOUBLE"), ("order_count", "BIGINT")],
    'q27': [("region_name", "VARCHAR"), ("state_code", "VARCHAR"), ("customers", "BIGINT"), ("loyalty_customers", "BIGINT")],
    'q28': [("p50_sales", "DOUBLE"), ("p90_sales", "DOUBLE"), ("p99_sales", "DOUBLE"), ("avg_sales", "DOUBLE")],
    'q29': [("month_start", "DATE"), ("net_sales", "DOUBLE"), ("cogs", "DOUBLE"), ("gross_profit", "DOUBLE")],
    'q30': [("category_name", "VARCHAR"), ("channel_name", "VARCHAR"), ("net_sales", "DOUBLE"), ("gross_margin_pct", "DOUBLE")],
    'q31': [("month_start", "DATE"), ("gross_sales", "DOUBLE"), ("discount_amount", "DOUBLE"), ("discount_rate", "DOUBLE"), ("promo_sales_mix", "DOUBLE")],
    'q32': [("category_name", "VARCHAR"), ("revenue", "DOUBLE"), ("cost", "DOUBLE"), ("profit", "DOUBLE"), ("cost_ratio", "DOUBLE")],
    'q33': [("method_group", "VARCHAR"), ("method_name", "VARCHAR"), ("payment_month", "DATE"), ("payment_count", "BIGINT"), ("payment_amount", "DOUBLE"), ("month_share", "DOUBLE")],
    'q34': [("month_start", "DATE"), ("net_sales", "DOUBLE"), ("cogs", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("discounts", "DOUBLE"), ("refunds", "DOUBLE"), ("orders", "BIGINT")],
    'q35': [("cogs_trailing_year", "DOUBLE"), ("avg_inventory_value_proxy", "DOUBLE"), ("inventory_turnover_proxy", "DOUBLE")],
    'q36': [("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("on_hand", "BIGINT"), ("avg_daily_units", "DOUBLE"), ("days_of_supply", "DOUBLE")],
    'q37a': [("stock_status", "VARCHAR"), ("location_type", "VARCHAR"), ("positions", "BIGINT"), ("inventory_value", "DOUBLE")],
    'q37b': [("snapshot_date", "DATE"), ("stockout_rows", "BIGINT"), ("total_rows", "BIGINT"), ("stockout_rate", "DOUBLE")],
    'q38': [("supplier_code", "VARCHAR"), ("supplier_name", "VARCHAR"), ("supplier_tier", "VARCHAR"), ("po_count", "BIGINT"), ("units_ordered", "BIGINT"), ("units_received", "BIGINT"), ("fill_rate", "DOUBLE"), ("on_time_rate", "DOUBLE"), ("avg_lead_time_days", "DOUBLE")],
    'q39': [("supplier_tier", "VARCHAR"), ("avg_contracted_lead", "DOUBLE"), ("avg_actual_lead", "DOUBLE"), ("lead_time_variance_days", "DOUBLE")],
    'q40': [("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("region_name", "VARCHAR"), ("net_sales_90d", "DOUBLE"), ("labor_hours_90d", "DOUBLE"), ("sales_per_labor_hour", "DOUBLE"), ("productivity_rank", "BIGINT")],
    'q41': [("dc_code", "VARCHAR"), ("dc_name", "VARCHAR"), ("shipments", "BIGINT"), ("avg_fulfillment_days", "DOUBLE"), ("avg_transit_days", "DOUBLE"), ("delayed_shipments", "BIGINT"), ("delay_rate", "DOUBLE")],
    'q42': [("shipment_id", "BIGINT"), ("order_id", "BIGINT"), ("order_date", "DATE"), ("ship_date", "DATE"), ("fulfillment_lead_time_days", "BIGINT"), ("carrier_name", "VARCHAR"), ("delay_flag", "VARCHAR"), ("dc_name", "VARCHAR")],
    'q43': [("category_name", "VARCHAR"), ("channel_name", "VARCHAR"), ("return_rate_units", "DOUBLE"), ("return_rate_value", "DOUBLE")],
    'q44': [("return_reason_code", "VARCHAR"), ("return_lines", "BIGINT"), ("units_returned", "BIGINT"), ("refund_cost", "DOUBLE"), ("restock_rate", "DOUBLE")],
    'q45': [("campaign_code", "VARCHAR"), ("campaign_name", "VARCHAR"), ("campaign_type", "VARCHAR"), ("actual_spend", "DOUBLE"), ("order_gross_profit", "DOUBLE"), ("campaign_roi", "DOUBLE"), ("attributed_orders", "BIGINT"), ("conversion_rate", "DOUBLE")],
    'q46': [("campaign_type", "VARCHAR"), ("sent_count", "BIGINT"), ("open_count", "BIGINT"), ("click_count", "BIGINT"), ("convert_count", "BIGINT"), ("conversion_rate", "DOUBLE"), ("click_to_open_rate", "DOUBLE")],
    'q47': [("campaign_code", "VARCHAR"), ("campaign_name", "VARCHAR"), ("objective_code", "VARCHAR"), ("attributed_net_sales", "DOUBLE"), ("attributed_orders", "BIGINT"), ("attributed_customers", "BIGINT"), ("aov_on_attributed_orders", "DOUBLE")],
    'q48': [("campaign_code", "VARCHAR"), ("region_name", "VARCHAR"), ("attributed_orders", "BIGINT"), ("net_sales", "DOUBLE")],
    'q49': [("campaign_code", "VARCHAR"), ("campaign_name", "VARCHAR"), ("objective_code", "VARCHAR"), ("new_customers_acquired", "BIGINT")],
    'q50': [("net_sales", "DOUBLE"), ("prior_period_net_sales", "DOUBLE"), ("sales_growth_pct", "DOUBLE"), ("gross_profit", "DOUBLE"), ("margin_pct", "DOUBLE"), ("order_count", "BIGINT"), ("aov", "DOUBLE"), ("active_customers", "BIGINT"), ("return_rate_value", "DOUBLE"), ("avg_fulfillment_days", "DOUBLE")],
    'q51': [("risk_name", "VARCHAR"), ("domain", "VARCHAR"), ("exposure_amount", "DOUBLE"), ("risk_rank", "BIGINT")],
    'q52': [("opportunity", "VARCHAR"), ("magnitude", "DOUBLE"), ("value_signal", "DOUBLE")],
    'q53': [("kpi", "VARCHAR"), ("kpi_value", "VARCHAR")],
    'q54': [("category_id", "BIGINT"), ("category_code", "VARCHAR"), ("category_name", "VARCHAR"), ("parent_category_id", "BIGINT"), ("category_level", "BIGINT"), ("path", "VARCHAR")],
    'q55': [("month_start", "DATE"), ("sss_net_sales", "DOUBLE"), ("sss_yoy_growth_pct", "DOUBLE")],
    'q56': [("month_start", "DATE"), ("channel_group", "VARCHAR"), ("net_sales", "DOUBLE"), ("mix_pct", "DOUBLE"), ("mix_pct_ma3", "DOUBLE")],
    'v01': [("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("store_format", "VARCHAR"), ("region_id", "BIGINT"), ("region_code", "VARCHAR"), ("region_name", "VARCHAR"), ("city", "VARCHAR"), ("state_code", "VARCHAR"), ("selling_sq_ft", "BIGINT"), ("open_date", "DATE"), ("close_date", "DATE"), ("is_active", "BOOLEAN")],
    'v02': [("product_id", "BIGINT"), ("sku", "VARCHAR"), ("product_name", "VARCHAR"), ("brand_name", "VARCHAR"), ("category_id", "BIGINT"), ("category_code", "VARCHAR"), ("category_name", "VARCHAR"), ("category_level", "BIGINT"), ("parent_category_id", "BIGINT"), ("primary_supplier_id", "BIGINT"), ("supplier_code", "VARCHAR"), ("supplier_name", "VARCHAR"), ("current_list_price", "DOUBLE"), ("current_unit_cost", "DOUBLE"), ("popularity_score", "DOUBLE"), ("is_active", "BOOLEAN"), ("launch_date", "DATE"), ("discontinue_date", "DATE")],
    'v03': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("customer_type", "VARCHAR"), ("registration_date", "DATE"), ("acquisition_channel_id", "BIGINT"), ("acquisition_channel_name", "VARCHAR"), ("preferred_store_id", "BIGINT"), ("is_active", "BOOLEAN"), ("loyalty_account_id", "BIGINT"), ("loyalty_number", "VARCHAR"), ("loyalty_tier", "VARCHAR"), ("points_balance", "BIGINT"), ("loyalty_status", "VARCHAR")],
    'v04': [("order_id", "BIGINT"), ("order_number", "VARCHAR"), ("customer_id", "BIGINT"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("channel_code", "VARCHAR"), ("channel_name", "VARCHAR"), ("order_date", "DATE"), ("order_timestamp", "TIMESTAMP"), ("order_status", "VARCHAR"), ("gross_amount", "DOUBLE"), ("discount_amount", "DOUBLE"), ("net_amount", "DOUBLE"), ("tax_amount", "DOUBLE"), ("shipping_amount", "DOUBLE"), ("total_amount", "DOUBLE"), ("employee_id", "BIGINT"), ("campaign_id", "BIGINT"), ("year_number", "BIGINT"), ("month_number", "BIGINT"), ("quarter_number", "BIGINT"), ("season_name", "VARCHAR")],
    'v05': [("order_item_id", "BIGINT"), ("order_id", "BIGINT"), ("order_number", "VARCHAR"), ("order_date", "DATE"), ("customer_id", "BIGINT"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("campaign_id", "BIGINT"), ("line_number", "BIGINT"), ("product_id", "BIGINT"), ("quantity", "BIGINT"), ("unit_price", "DOUBLE"), ("unit_cost", "DOUBLE"), ("discount_amount", "DOUBLE"), ("line_gross_amount", "DOUBLE"), ("line_net_amount", "DOUBLE"), ("line_cogs_amount", "DOUBLE"), ("line_gross_profit", "DOUBLE"), ("promotion_id", "BIGINT"), ("is_gift", "BOOLEAN")],
    'v06': [("order_date", "DATE"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("order_count", "BIGINT"), ("line_count", "BIGINT"), ("units_sold", "BIGINT"), ("gross_sales", "DOUBLE"), ("discount_amount", "DOUBLE"), ("net_sales", "DOUBLE"), ("cogs_amount", "DOUBLE"), ("gross_profit", "DOUBLE")],
    'v07': [("payment_id", "BIGINT"), ("order_id", "BIGINT"), ("order_date", "DATE"), ("customer_id", "BIGINT"), ("store_id", "BIGINT"), ("channel_id", "BIGINT"), ("payment_method_id", "BIGINT"), ("method_code", "VARCHAR"), ("method_name", "VARCHAR"), ("payment_timestamp", "TIMESTAMP"), ("payment_amount", "DOUBLE"), ("payment_status", "VARCHAR")],
    'v08': [("shipment_id", "BIGINT"), ("order_id", "BIGINT"), ("order_date", "DATE"), ("dc_id", "BIGINT"), ("store_id", "BIGINT"), ("carrier_name", "VARCHAR"), ("shipment_status", "VARCHAR"), ("ship_date", "DATE"), ("delivery_date", "DATE"), ("fulfillment_lead_time_days", "BIGINT")],
    'v09': [("return_id", "BIGINT"), ("order_id", "BIGINT"), ("customer_id", "BIGINT"), ("return_date", "DATE"), ("return_status", "VARCHAR"), ("refund_amount", "DOUBLE"), ("order_date", "DATE"), ("days_to_return", "BIGINT")],
    'v10': [("return_item_id", "BIGINT"), ("return_id", "BIGINT"), ("return_date", "DATE"), ("order_id", "BIGINT"), ("customer_id", "BIGINT"), ("order_item_id", "BIGINT"), ("product_id", "BIGINT"), ("quantity_returned", "BIGINT"), ("unit_refund_amount", "DOUBLE"), ("refund_line_amount", "DOUBLE"), ("restock_flag", "BOOLEAN"), ("return_reason_code", "VARCHAR")],
    'v11': [("inventory_id", "BIGINT"), ("product_id", "BIGINT"), ("location_type", "VARCHAR"), ("store_id", "BIGINT"), ("dc_id", "BIGINT"), ("quantity_on_hand", "BIGINT"), ("quantity_reserved", "BIGINT"), ("quantity_available", "BIGINT"), ("reorder_point", "BIGINT"), ("max_stock", "BIGINT"), ("current_unit_cost", "DOUBLE"), ("inventory_value_cost", "DOUBLE"), ("as_of_timestamp", "TIMESTAMP")],
    'v12': [("snapshot_id", "BIGINT"), ("snapshot_date", "DATE"), ("product_id", "BIGINT"), ("location_type", "VARCHAR"), ("store_id", "BIGINT"), ("dc_id", "BIGINT"), ("quantity_on_hand", "BIGINT"), ("quantity_reserved", "BIGINT"), ("quantity_available", "BIGINT"), ("inventory_value_cost", "DOUBLE"), ("year_number", "BIGINT"), ("month_number", "BIGINT"), ("week_of_year", "BIGINT")],
    'v13': [("po_item_id", "BIGINT"), ("purchase_order_id", "BIGINT"), ("po_number", "VARCHAR"), ("supplier_id", "BIGINT"), ("dc_id", "BIGINT"), ("order_date", "DATE"), ("expected_receipt_date", "DATE"), ("po_status", "VARCHAR"), ("line_number", "BIGINT"), ("product_id", "BIGINT"), ("quantity_ordered", "BIGINT"), ("unit_cost", "DOUBLE"), ("ordered_amount", "DOUBLE")],
    'v14': [("receipt_item_id", "BIGINT"), ("receipt_id", "BIGINT"), ("purchase_order_id", "BIGINT"), ("dc_id", "BIGINT"), ("receipt_date", "DATE"), ("is_on_time", "BOOLEAN"), ("po_item_id", "BIGINT"), ("product_id", "BIGINT"), ("quantity_received", "BIGINT")],
    'v15': [("campaign_id", "BIGINT"), ("campaign_code", "VARCHAR"), ("campaign_name", "VARCHAR"), ("campaign_type", "VARCHAR"), ("channel_id", "BIGINT"), ("channel_name", "VARCHAR"), ("start_date", "DATE"), ("end_date", "DATE"), ("budget_amount", "DOUBLE"), ("actual_spend", "DOUBLE"), ("objective_code", "VARCHAR"), ("lift_factor", "DOUBLE"), ("status_code", "VARCHAR")],
    'v16': [("campaign_response_id", "BIGINT"), ("campaign_id", "BIGINT"), ("campaign_code", "VARCHAR"), ("customer_id", "BIGINT"), ("response_timestamp", "TIMESTAMP"), ("response_type", "VARCHAR"), ("order_id", "BIGINT"), ("attributed_revenue", "DOUBLE")],
    'v17': [("date_id", "BIGINT"), ("full_date", "DATE"), ("day_of_week", "BIGINT"), ("day_name", "VARCHAR"), ("week_of_year", "BIGINT"), ("month_number", "BIGINT"), ("month_name", "VARCHAR"), ("quarter_number", "BIGINT"), ("year_number", "BIGINT"), ("fiscal_year", "BIGINT"), ("fiscal_quarter", "BIGINT"), ("is_weekend", "BOOLEAN"), ("is_holiday", "BOOLEAN"), ("holiday_name", "VARCHAR"), ("season_name", "VARCHAR")],
    'vq1_view_query_dated': [("customer_id", "BIGINT"), ("customer_number", "VARCHAR"), ("first_order_date", "DATE"), ("last_order_date", "DATE"), ("lifetime_net_sales", "DOUBLE")],
    'vq1_view_query_page': [("order_date", "DATE"), ("year_number", "BIGINT"), ("quarter_number", "BIGINT"), ("month_number", "BIGINT"), ("store_id", "BIGINT"), ("store_code", "VARCHAR"), ("store_name", "VARCHAR"), ("store_format", "VARCHAR"), ("region_id", "BIGINT"), ("region_code", "VARCHAR"), ("region_name", "VARCHAR"), ("channel_id", "BIGINT"), ("channel_code", "VARCHAR"), ("channel_name", "VARCHAR"), ("order_count", "BIGINT"), ("units_sold", "BIGINT"), ("gross_sales", "DOUBLE"), ("discount_amount", "DOUBLE"), ("net_sales", "DOUBLE"), ("cogs_amount", "DOUBLE"), ("gross_profit", "DOUBLE")],
    'vq1_view_query_total': [("total_items", "BIGINT"), ("total_pages", "BIGINT")],
    'vq2_summarize': [("lifetime_net_sales", "DOUBLE"), ("lifetime_gross_profit", "DOUBLE"), ("order_count", "DOUBLE"), ("lifetime_units", "DOUBLE")],
    'vq3_kpi_cards_customer': [("id", "VARCHAR"), ("title", "VARCHAR"), ("value", "DOUBLE"), ("format", "VARCHAR")],
    'vq3_kpi_cards_finance': [("id", "VARCHAR"), ("title", "VARCHAR"), ("value", "DOUBLE"), ("format", "VARCHAR")],
    'vq3_kpi_cards_sales': [("id", "VARCHAR"), ("title", "VARCHAR"), ("value", "DOUBLE"), ("format", "VARCHAR")],
    'vq4_time_series': [("series", "VARCHAR"), ("x", "DATE"), ("y", "DOUBLE")],
}
