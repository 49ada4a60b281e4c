"""Period windows (PW) shared by the KPI roll-ups.

``period_end = date_to or max(date)``, ``period_start = date_from or
end - (days - 1)``, and the prior window has the same length and ends the day
before ``period_start``. Both windows are read in one pass: rows are labelled
by date and summed with conditional aggregates (D3: the prior window is
always fetched, whatever the filters).

The latest date is a scalar subquery of the plan that uses it: building a plan starts
no job, and a plan that is kept follows its data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expr import col


@dataclass(frozen=True)
class Period:
    """Bounds as dates or as columns without rows of their own (literals, scalar subqueries)."""

    start: dt.date | Column
    end: dt.date | Column
    prior_start: dt.date | Column
    prior_end: dt.date | Column

    def current(self, date_col) -> Column:
        return col(date_col).between(F.lit(self.start), F.lit(self.end))

    def prior(self, date_col) -> Column:
        return col(date_col).between(F.lit(self.prior_start), F.lit(self.prior_end))

    def either(self, date_col) -> Column:
        return col(date_col).between(F.lit(self.prior_start), F.lit(self.end))


def make_period(end: dt.date, start: dt.date | None = None, days: int = 30) -> Period:
    start = start or end - dt.timedelta(days=days - 1)
    prior_end = start - dt.timedelta(days=1)
    return Period(start, end, prior_end - (end - start), prior_end)


def resolve_period(df: DataFrame, date_col: str, date_from=None, date_to=None, days: int = 30, default: dt.date | None = None) -> Period:
    """The window; its end is ``date_to``, or else the latest date of ``df``, or else ``default``."""
    if date_to is not None:
        return make_period(date_to, date_from, days)
    end = df.agg(F.max(date_col).alias("latest")).scalar()
    if default is not None:
        end = F.coalesce(end, F.lit(default))
    start = F.lit(date_from) if date_from is not None else F.date_sub(end, days - 1)
    prior_end = F.date_sub(start, 1)
    return Period(start, end, F.date_sub(prior_end, F.datediff(end, start)), prior_end)


def sum_when(cond: Column, value) -> Column:
    return F.sum(F.when(cond, col(value)))
