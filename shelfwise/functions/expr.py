"""Column-expression helpers (scalar functions F1-F17).

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order statuses that count as a sale.
SOLD_STATUSES = ("Completed", "Returned", "PartiallyReturned")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_sold(status="order_status") -> Column:
    return col(status).isin(*SOLD_STATUSES)


def nullif_zero(c) -> Column:
    return F.nullif(col(c), F.lit(0))


def safe_div(a, b) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of a divide-by-zero error."""
    return col(a) / nullif_zero(b)


def xdiv(a, b) -> Column:
    """Exact-ish NUMERIC division: the dividend is widened to DECIMAL(38,18)
    so the quotient keeps >= 16 decimals before any ROUND (PostgreSQL NUMERIC
    semantics; integer/integer never goes through DOUBLE)."""
    return col(a).cast("decimal(38,18)") / nullif_zero(b)


def ratio(a, b, scale: int = 4) -> Column:
    """``ROUND(a / NULLIF(b, 0), scale)`` in decimal arithmetic."""
    return F.round(xdiv(a, b), scale)


def xavg(c) -> Column:
    """AVG of an exact column as NUMERIC (sum / count in decimal)."""
    return xdiv(F.sum(c), F.count(c))


def money(c, scale: int = 2) -> Column:
    return F.round(col(c), scale)


def month_start(d) -> Column:
    """``DATE_TRUNC('month', d)::DATE``."""
    return F.trunc(col(d), "MM")


def days_between(later, earlier) -> Column:
    """PostgreSQL ``date - date`` (integer days)."""
    return F.datediff(col(later), col(earlier))


def months_between_starts(later, earlier) -> Column:
    """``age()`` in whole months between two month starts."""
    return F.months_between(col(later), col(earlier)).cast("int")


def as_numeric_flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1.0 ELSE 0.0 END`` (NULL counts as 0)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def iso_week_key(d) -> Column:
    """``2025-W01`` ISO week bucket."""
    d = col(d)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
                    F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def month_key(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def trend_label(delta) -> Column:
    """>0.001 up, <-0.001 down, otherwise flat; NULL passes through."""
    d = col(delta)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d > 0.001, "up").when(d < -0.001, "down").otherwise("flat"))


def priority_from_score(score) -> Column:
    s = col(score)
    return (F.when(s.isNull(), "medium").when(s >= 0.85, "critical").when(s >= 0.7, "high")
            .when(s >= 0.4, "medium").otherwise("low"))


def risk_level(score) -> Column:
    s = col(score)
    return F.when(s.isNull(), "Medium").when(s >= 0.7, "High").when(s >= 0.4, "Medium").otherwise("Low")


def mean_of_present(*cols) -> Column:
    """Mean of the non-NULL arguments; NULL when all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [F.when(col(c).isNull(), 0).otherwise(1) for c in cols])
    return total / F.nullif(present, F.lit(0))


def supplier_risk(on_time, quality) -> Column:
    m = mean_of_present(on_time, quality)
    return F.when(m.isNull(), "Unknown").when(m < 0.5, "High").when(m < 0.75, "Medium").otherwise("Low")


# display text. Values are rounded in DECIMAL first (half-up), so the
# formatting step never rounds: ``$1,235``, ``12.3%``, ``1,234`` / ``1,234.5``.
def format_currency(c) -> Column:
    v = col(c).cast("decimal(38,6)")
    return F.concat(F.lit("$"), F.format_number(F.round(v, 0), 0))


def format_percent(c, digits: int = 1) -> Column:
    v = col(c).cast("decimal(38,6)")
    return F.concat(F.round(v * 100, digits).cast("string"), F.lit("%"))


def percent_text(c, digits: int = 1) -> Column:
    """``12.3%`` from a ratio, rounded half-up in DECIMAL (no locale grouping)."""
    return F.concat(F.round(col(c).cast("decimal(38,10)") * 100, digits).cast("string"), F.lit("%"))


def format_count(c) -> Column:
    v = col(c).cast("decimal(38,6)")
    return F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(F.round(v, 1), 1))


def format_value(c, fmt: str) -> Column:
    return {"currency": format_currency, "percent": format_percent}.get(fmt, format_count)(c)


# F16: loose coercion of text values (dates, numbers, booleans); bad text -> NULL
def loose_date(c) -> Column:
    s = F.trim(col(c).cast("string"))
    return F.coalesce(s.try_cast("date"), F.to_date(F.try_to_timestamp(s)))


def loose_float(c) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def loose_bool(c) -> Column:
    s = F.lower(F.trim(col(c).cast("string")))
    return (F.when(s.isin("true", "t", "yes", "y", "1"), F.lit(True))
            .when(s.isin("false", "f", "no", "n", "0"), F.lit(False)))
