"""M15 ``data_quality_summary``: per-table profiles -> four check scores + a
composite, one row per (check, table) plus an overall row (26 rows for the
five profiled tables).

Each profile is a single global aggregate (partial aggregation on every
partition, one tiny final merge); the distinct-key count is exact. Scores
are NUMERIC (decimal) rounded to 6 places; freshness decays linearly over
30 days before ``as_of`` and floors at 0.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expr import ratio, xdiv
from shelfwise.sources.catalog import Catalog

DEC = "decimal(38,6)"
FRESH_WINDOW_SECONDS = 86400 * 30

# Check names, descriptions and message prefixes of the summary.
CHECKS = [
    ("completeness", "completeness", "Missing critical fields pct=", "missing_value_pct",
     "Share of rows with required fields populated", (0.7, 0.9)),
    ("duplicates", "consistency", "Duplicate key pct=", "duplicate_pct",
     "Primary-key uniqueness pressure (approx)", (0.7, 0.9)),
    ("freshness", "freshness", "Last updated=", "last_updated",
     "Recency of source table updates (30-day decay)", (0.5, 0.8)),
    ("validity", "validity", "Invalid/missing critical=", "missing_value_pct",
     "Validity derived from required-field population", (0.7, 0.9)),
    ("table_score", "score", "Composite DQ score=", "score",
     "Mean of available completeness/validity/consistency/freshness", (0.7, 0.9)),
]
OVERALL_DESCRIPTION = "Average of per-table composite scores (NULL when no oltp rows)"
OWNER = "Data Platform"


def profile(df: DataFrame, entity: str, missing: Column, key: str | None, updated: str) -> DataFrame:
    n = F.count(F.lit(1))
    dups = (n - F.countDistinct(key)) if key else F.lit(0).cast("long")
    return df.agg(F.lit(entity).alias("entity_name"), n.alias("row_count"),
                  F.count(F.when(missing, 1)).alias("missing_critical"), dups.alias("duplicate_keys"),
                  F.max(updated).cast("timestamp_ntz").alias("last_updated"))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def table_profiles(cat: Catalog) -> DataFrame:
    o = cat.orders
    oi = cat.order_items.join(o.select("order_id", F.col("updated_at").alias("_o_updated")), "order_id", "left")
    parts = [
        profile(cat.customers, "oltp.customers", _blank("email_hash"), "customer_id", "updated_at"),
        profile(o, "oltp.orders", F.col("customer_id").isNull() | F.col("channel_id").isNull(), "order_id", "updated_at"),
        profile(oi, "oltp.order_items", F.col("order_id").isNull() | F.col("product_id").isNull(), "order_item_id",
                "_o_updated"),
        profile(cat.products, "oltp.products", _blank("sku"), "product_id", "updated_at"),
        profile(cat.inventory, "oltp.inventory", F.col("product_id").isNull(), None, "as_of_timestamp"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _severity(score: Column, lo: float, hi: float) -> Column:
    return (F.when(score.isNull(), "unknown").when(score < lo, "critical").when(score < hi, "high")
            .otherwise("info"))


def data_quality_summary(cat: Catalog, as_of: dt.date | None = None) -> DataFrame:
    as_of = as_of or cat.as_of

    def build():
        now = F.lit(f"{as_of.isoformat()} 00:00:00").cast("timestamp_ntz")  # zone-independent
        p = table_profiles(cat)
        rows, miss = F.col("row_count"), F.col("missing_critical")
        dup = F.greatest(F.col("duplicate_keys"), F.lit(0))
        has = rows > 0
        one = F.lit(1).cast(DEC)
        age = F.unix_timestamp(now) - F.unix_timestamp("last_updated")
        scored = p.select(
            "entity_name", "row_count", "last_updated",
            F.when(has, ratio(rows - miss, rows, 6)).alias("completeness"),
            F.when(has, ratio(miss, rows, 6)).alias("missing_value_pct"),
            F.when(has, ratio(dup, rows, 6)).alias("duplicate_pct"),
            F.when(has & (miss == 0), one).when(has, ratio(rows - miss, rows, 6)).alias("validity"),
            F.when(has & (dup == 0), one).when(has, ratio(rows - dup, rows, 6)).alias("consistency"),
            F.when(F.col("last_updated").isNull(), F.lit(None))
            .otherwise(F.greatest(F.lit(0).cast(DEC), ratio(F.lit(FRESH_WINDOW_SECONDS) - age,
                                                            F.lit(FRESH_WINDOW_SECONDS), 6))).alias("freshness"))
        comps = ["completeness", "validity", "consistency", "freshness"]
        total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in comps])
        present = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 0).otherwise(1) for c in comps])
        scored = scored.withColumn("score", ratio(total, present, 6))
        for c in ("completeness", "missing_value_pct", "duplicate_pct", "validity", "consistency", "freshness",
                  "score"):
            scored = scored.withColumn(c, F.col(c).cast(DEC))
        # the five tables' rows become one, from which the overall score and all result rows are made
        packed = scored.agg(F.collect_list(F.struct(*scored.columns)).alias("tables"),
                            F.round(xdiv(F.sum("score"), F.count("score")), 6).cast(DEC).alias("overall"))
        shown = ("missing_value_pct", "duplicate_pct", "freshness", "validity", "consistency", "completeness")

        def row(check, entity, namespace, score, limits, prefix, said, about, profile=None):
            told = F.concat(F.lit(prefix), F.coalesce(said.cast("string"), F.lit("n/a")))
            return F.struct(F.lit(check).alias("check_name"), entity.alias("entity_name"), F.lit(namespace).alias("namespace"), score.alias("score"),
                            _severity(score, *limits).alias("severity"), told.alias("message"), F.lit(about).alias("description"),
                            *((profile[c] if profile is not None else F.lit(None).cast(DEC)).alias(c) for c in shown),
                            (profile["row_count"] if profile is not None else F.lit(None).cast("long")).alias("invalid_records"))

        def of_table(x):
            return F.array(*(row(check, x["entity_name"], "table", x[score], limits, prefix, x[said], about, x)
                             for check, score, prefix, said, about, limits in CHECKS))
        o = F.col("overall")
        every = F.concat(F.flatten(F.transform("tables", of_table)),
                         F.array(row("overall_score", F.lit("analytics.platform"), "overall", o, (0.7, 0.9), "Platform overall DQ score=", o, OVERALL_DESCRIPTION)))
        return packed.select("overall", F.inline(every)).select(
            F.lit(as_of).alias("check_date"), F.lit(as_of).alias("as_of_date"), "check_name", "entity_name", "namespace", "score", "severity",
            "message", "description", o.alias("overall_score"), o.alias("dq_score"), o.alias("quality_score"), F.lit(OWNER).alias("owner"), *shown,
            "invalid_records")
    return cat.memo(f"m15@{as_of}", build)
