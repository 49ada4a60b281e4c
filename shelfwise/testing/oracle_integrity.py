"""DuckDB text of the integrity checks: one statement a rule, each written from the rule's meaning.

The Spark side compiles all rules into shared aggregates; here every rule counts on its own.
"""

from __future__ import annotations

from shelfwise.operators.constraints import RULES, Rule

# What the test binding lacks of the model.
ABSENT = {"customer_addresses", "product_suppliers", "employees", "promotions", "order_item_promotions", "shipment_items",
          "inventory_transactions", "price_history", "cost_history"}
MISSING = {
    "regions": "created_at updated_at", "channels": "created_at", "distribution_centers": "postal_code created_at updated_at",
    "stores": "address_line1 postal_code latitude longitude created_at updated_at", "product_categories": "created_at",
    "suppliers": "created_at updated_at", "customers": "last_name phone_hash birth_year gender_code created_at",
    "loyalty_accounts": "created_at updated_at", "products": "created_at", "marketing_campaigns": "created_at", "orders": "created_at",
    "payments": "created_at", "purchase_orders": "created_at", "goods_receipts": "created_at",
}
# Row conditions that DuckDB spells otherwise.
SPELLED = {"ck_regions_country": "regexp_full_match(country_code, '[A-Z]{2}')"}


def _checked(r: Rule) -> bool:
    lacks = MISSING.get(r.table, "").split()
    return r.table not in ABSENT and r.ref_table not in ABSENT and not set(r.columns) & set(lacks)


def _count(r: Rule) -> str:
    t, c = f"oltp_{r.table}", r.columns[0]
    if r.kind == "not_null":
        return f"SELECT count(*) - count({c}) FROM {t}"
    if r.kind == "unique":
        cols = ", ".join(r.columns)
        filled = " AND ".join(f"{x} IS NOT NULL" for x in r.columns)
        return f"SELECT count(*) FROM (SELECT {cols} FROM {t} WHERE {filled} GROUP BY {cols} HAVING count(*) > 1)"
    if r.kind == "foreign_key":
        return (f"SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN "
                f"(SELECT {r.ref_columns[0]} FROM oltp_{r.ref_table} WHERE {r.ref_columns[0]} IS NOT NULL)")
    if r.kind == "domain":
        return f"SELECT count(*) FROM {t} WHERE NOT list_contains([{', '.join(repr(v) for v in r.values)}], {c})"
    if r.kind == "range":
        sides = [f"{c} < {r.low}"] * (r.low is not None) + [f"{c} > {r.high}"] * (r.high is not None)
        return f"SELECT count(*) FROM {t} WHERE {' OR '.join(sides)}"
    return f"SELECT count(*) FROM {t} WHERE ({SPELLED.get(r.rule, r.condition)}) = FALSE"


def rule_sql(r: Rule) -> str:
    known = _checked(r)
    n = f"({_count(r)})" if known else "CAST(NULL AS BIGINT)"
    return (f"SELECT '{r.rule}' AS rule, '{r.table}' AS \"table\", '{r.kind}' AS kind, '{'checked' if known else 'not_checked'}' AS status, "
            f"{n} AS violations")


def summary_sql(kinds: tuple[str, ...]) -> str:
    return "\nUNION ALL\n".join(rule_sql(r) for r in RULES if r.kind in kinds)


C_QUERIES = {
    "c1_c2_keys": summary_sql(("not_null", "unique")),
    "c3_foreign_keys": summary_sql(("foreign_key",)),
    "c4_c5_domains_ranges": summary_sql(("domain", "range")),
    "c6_c7_row_checks": summary_sql(("row",)),
}
