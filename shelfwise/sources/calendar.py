"""Calendar dimension builder.

One row per day from ``start`` to ``end`` (inclusive), generated with
``sequence`` + ``explode`` inside Spark; no Python loop over days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Month-day holidays, Thanksgiving = 4th Thursday of November.
FIXED_HOLIDAYS = {(1, 1): "New Year's Day", (7, 4): "Independence Day",
                  (11, 11): "Veterans Day", (12, 25): "Christmas Day"}
THANKSGIVING = "Thanksgiving"
# Season labels in rule order.
SEASONS = ("Holiday", "WinterClearance", "Spring", "Summer", "BackToSchool", "Regular")


def season_expr(d) -> F.Column:
    m, day = F.month(d), F.dayofmonth(d)
    return (F.when((m >= 11) | ((m == 1) & (day <= 15)), "Holiday")
            .when(m.isin(2, 3), "WinterClearance")
            .when(m.isin(4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer")
            .when(m.isin(9, 10), "BackToSchool")
            .otherwise("Regular"))


def holiday_expr(d) -> F.Column:
    m, day = F.month(d), F.dayofmonth(d)
    iso_dow = F.weekday(d) + 1
    expr = F.when((m == 11) & (iso_dow == 4) & day.between(22, 28), F.lit(THANKSGIVING))
    for (mm, dd), name in FIXED_HOLIDAYS.items():
        expr = expr.when((m == mm) & (day == dd), F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def calendar(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    return calendar_between(spark.range(1).select(F.lit(str(start)).cast("date").alias("first_day"),
                                                  F.lit(str(end)).cast("date").alias("last_day")))


def calendar_between(bounds: DataFrame) -> DataFrame:
    """The days from first_day to last_day of the one row of ``bounds`` (an aggregate stays part of the plan)."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    d = F.col("full_date")
    holiday = holiday_expr(d)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"),
        d,
        (F.weekday(d) + 1).cast("short").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).cast("short").alias("week_of_year"),
        F.month(d).cast("short").alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("short").alias("quarter_number"),
        F.year(d).alias("year_number"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).cast("short").alias("fiscal_quarter"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        holiday.isNotNull().alias("is_holiday"),
        holiday.alias("holiday_name"),
        season_expr(d).alias("season_name"),
    )
