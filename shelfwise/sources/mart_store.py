"""Stored marts (S6): written once, refreshed by month, served to every query of a catalog.

A mart with a date is a Parquet table with one partition a month; a refresh computes
and overwrites only the months that changed (the month filter reaches the order scan),
and removes months that have no rows any more. A mart without a date is a published
version (``storage``). ``serve`` gives a catalog whose marts are read from the store,
so queries that share a mart scan its rows and not the lines again.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources import storage
from shelfwise.sources.catalog import Catalog

MONTH = "stored_month"


@dataclass(frozen=True)
class Stored:
    build: Callable[[Catalog], DataFrame]
    date: str | None = None   # the column that a month is taken from
    as_of: bool = False       # the mart depends on the catalog's date

    def key(self, name: str, cat: Catalog) -> str:
        return f"{name}@{cat.as_of}" if self.as_of else name


def stored_marts() -> dict[str, Stored]:
    from shelfwise.plans import marts as M
    return {"m02": Stored(M.fact_sales_line, "order_date"), "m03": Stored(M.sales_daily, "order_date"), "m05": Stored(M.customer_360, as_of=True),
            "m06": Stored(M.customer_rfm, as_of=True), "m07": Stored(M.inventory_health), "m08": Stored(M.fact_return_line, "return_date"),
            "m09": Stored(M.supplier_performance), "m10": Stored(M.campaign_performance), "m11": Stored(M.shipment_performance, "order_date"),
            "m12": Stored(M.executive_daily_kpis, "order_date")}


class MartStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.marts = spark, root, stored_marts()

    def _home(self, name: str) -> str:
        return storage.join(self.root, name)

    def _state(self) -> dict:
        text = storage.latest(self.spark, storage.join(self.root, "_state"))[1]
        return json.loads(text) if text else {}

    def _note(self, state: dict) -> None:
        storage.add_numbered(self.spark, storage.join(self.root, "_state"), json.dumps(state))

    def save(self, cat: Catalog, names: Iterable[str] | None = None) -> dict[str, str]:
        """Writes whole marts; name and path of each."""
        return {name: self._write(cat, name, None) for name in names or self.marts}

    def refresh(self, cat: Catalog, months: Iterable[str]) -> None:
        """Brings the stored marts up to date where only these months (``yyyy-MM``) of their dates have changed.

        ``cat`` must not be one that ``serve`` gave: the marts are computed from their tables.
        """
        months = sorted(set(months))
        for name in self._state():
            self._write(cat, name, months if self.marts[name].date else None)

    def _write(self, cat: Catalog, name: str, months: list[str] | None) -> str:
        mart, home = self.marts[name], self._home(name)
        df = mart.build(cat)
        state = self._state()
        if mart.date is None:
            version = f"v-{uuid.uuid4().hex}"
            df.write.mode("error").parquet(storage.join(home, version))
            storage.publish(self.spark, home, version)
        else:
            rows = df
            if months is not None:  # as date ranges, which reach the scans of the orders
                first = [dt.date.fromisoformat(f"{m}-01") for m in months]
                inside = F.lit(False)
                for d in first:
                    inside = inside | F.col(mart.date).between(F.lit(d), F.last_day(F.lit(d)))
                rows = df.where(inside)
            rows = rows.withColumn(MONTH, F.date_format(mart.date, "yyyy-MM"))
            # one writer a month and slice of days: no file for each task and month, and no task for a whole month
            (rows.repartition(MONTH, F.dayofmonth(mart.date) % 8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if months is not None else "static")
             .partitionBy(MONTH).parquet(home))
            for m in months or ():
                if not rows.where(F.col(MONTH) == m).limit(1).count():
                    storage.delete(self.spark, storage.join(home, f"{MONTH}={m}"))
        state[name] = {"columns": df.columns, "as_of": str(cat.as_of) if mart.as_of else None, "schema": df.schema.json()}
        self._note(state)
        return home

    def frame(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType
        told, mart = self._state()[name], self.marts[name]
        path = self._home(name) if mart.date else storage.current(self.spark, self._home(name))
        schema = StructType.fromJson(json.loads(told["schema"]))
        return self.spark.read.schema(schema.add(MONTH, "string") if mart.date else schema).parquet(path).select(told["columns"])

    def serve(self, cat: Catalog) -> Catalog:
        """A catalog like ``cat`` that reads the stored marts; those stored for another date are computed as before."""
        out = cat.with_as_of(cat.as_of)
        for name, told in self._state().items():
            mart = self.marts[name]
            if not mart.as_of or told["as_of"] == str(cat.as_of):
                out.memo(mart.key(name, cat), lambda name=name: self.frame(name))
        return out


def changed_months(cat: Catalog, since) -> list[str]:
    """Months of the orders that changed after ``since`` (their returns may lie in later ones, which are named too)."""
    o = cat.orders.where(F.col("updated_at") > F.lit(since)).select("order_id", "order_date")
    days = o.select(F.col("order_date").alias("d")).unionByName(cat.returns.join(o, "order_id", "left_semi").select(F.col("return_date").alias("d")))
    return sorted(r[0] for r in days.select(F.date_format("d", "yyyy-MM")).distinct().collect())
