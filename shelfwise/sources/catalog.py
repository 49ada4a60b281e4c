"""The catalog: named retail tables as DataFrames (L0).

A catalog is a mapping ``name -> DataFrame`` plus an explicit ``as_of`` date
(the reference's ``CURRENT_DATE``). Tables are built lazily and the DataFrame
object (not data) is memoised, so every mart sees the same logical plan and
Spark can reuse exchanges inside one query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 35 retail tables, parents before children (load order, C8).
TABLE_ORDER = (
    "regions", "channels", "payment_methods", "distribution_centers", "stores", "calendar_date",
    "product_categories", "suppliers", "customers", "loyalty_accounts", "customer_addresses",
    "products", "product_suppliers", "employees", "store_labor_hours", "promotions",
    "marketing_campaigns", "orders", "order_items", "order_item_promotions", "payments",
    "shipments", "shipment_items", "returns", "return_items", "inventory",
    "inventory_transactions", "inventory_snapshots", "purchase_orders", "purchase_order_items",
    "goods_receipts", "goods_receipt_items", "campaign_responses", "price_history", "cost_history",
)


class Catalog:
    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]],
                 as_of: dt.date | str | None = None, shared: dict | None = None):
        self.spark = spark
        self._shared = shared if shared is not None else {}
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}
        self._as_of = as_of
        self._extras: dict[str, DataFrame] = {}

    # -- table access -------------------------------------------------
    def __contains__(self, name: str) -> bool:
        return name in self._builders or name in self._frames

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise KeyError(f"table {name!r} is not in the catalog")
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def names(self) -> list[str]:
        return sorted(set(self._builders) | set(self._frames))

    def register(self, name: str, df_or_builder) -> None:
        if callable(df_or_builder) and not isinstance(df_or_builder, DataFrame):
            self._builders = dict(self._builders)
            self._builders[name] = df_or_builder
            self._frames.pop(name, None)
        else:
            self._frames[name] = df_or_builder

    def memo(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Memoise a derived DataFrame (a mart) under ``key``."""
        if key not in self._extras:
            self._extras[key] = build()
        return self._extras[key]

    # -- as-of date ---------------------------------------------------
    @property
    def as_of(self) -> dt.date:
        """Explicit as-of date; defaults to ``max(order_date)`` (one scalar)."""
        if self._as_of is None:
            if "default_as_of" not in self._shared:  # a data statistic: once per source
                self._shared["default_as_of"] = self["orders"].agg(F.max("order_date")).first()[0]
            self._as_of = self._shared["default_as_of"]
        if isinstance(self._as_of, str):
            self._as_of = dt.date.fromisoformat(self._as_of)
        return self._as_of

    def with_as_of(self, as_of) -> "Catalog":
        other = Catalog(self.spark, self._builders, as_of, self._shared)
        other._frames = dict(self._frames)
        return other

    # -- constructors -------------------------------------------------
    @classmethod
    def from_parquet_dir(cls, spark: SparkSession, path: str, as_of=None) -> "Catalog":
        """A catalog over the Parquet tables of a folder on any file system: ``<table>`` (its published
        version, where ``load_all`` made it) or ``<table>.parquet``."""
        from shelfwise.sources import storage
        found, builders = set(storage.names(spark, path)), {}
        if not found:
            raise FileNotFoundError(f"no tables in {path}")
        for name in TABLE_ORDER:
            for cand in (name, name + ".parquet"):
                if cand in found:
                    home = storage.join(path, cand)
                    builders[name] = (lambda p=storage.current(spark, home) or home: spark.read.parquet(p))
                    break
        return cls(spark, builders, as_of)

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str, as_of=None, fresh: bool = False) -> "Catalog":
        """The TPC-H-bound catalog; one per (session, folder, as_of) so the
        logical plans of tables and marts are built once per session."""
        from shelfwise.sources import storage
        from shelfwise.sources.tpch_binding import tpch_builders
        key = (id(spark), spark.sparkContext.applicationId, sf_dir, storage.listing(spark, sf_dir))  # other files: another binding
        if fresh or key not in _SESSION_BINDINGS:
            _SESSION_BINDINGS[key] = (tpch_builders(spark, sf_dir), {})
        # source bindings are shared per session; marts and queries are
        # planned (and executed) afresh for every catalog
        builders, shared = _SESSION_BINDINGS[key]
        return cls(spark, builders, as_of, shared)


_SESSION_BINDINGS: dict[tuple, dict] = {}
