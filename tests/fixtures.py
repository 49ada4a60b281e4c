"""Small hand-made catalogs for edge-case tests."""

import datetime as dt
from decimal import Decimal

from shelfwise.sources.catalog import Catalog
from shelfwise.sources.schemas import schema

D = Decimal


def frame(spark, table, rows):
    st = schema(table)
    names = st.fieldNames()
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, st)


def make_catalog(spark, tables: dict, as_of=None) -> Catalog:
    builders = {name: (lambda n=name, rows=rows: frame(spark, n, rows)) for name, rows in tables.items()}
    return Catalog(spark, builders, as_of)


def day(s):
    return dt.date.fromisoformat(s)
