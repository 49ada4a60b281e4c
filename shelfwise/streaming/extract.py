"""Extraction in batches (S10) and distributed export.

``extract`` hands a result to its caller in batches of 500, whole unless a bound is
given; the last batch says whether the bound cut it. With a ``key`` the batches are in
its order and each carries a restart token: the key of its last row. Rows of
one key are never split between batches, so a restart after a token neither loses nor
repeats rows, also where the key is not unique. Rows reach the driver one
partition at a time; a large result is better written by the executors: ``export``.

The reference has no event streams, watermarks or stateful operators, so
there is no Structured Streaming job here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 500


class Batch(list):
    """Rows as dicts. ``token``: key of the last row. ``cut``: the bound was hit and rows are left (told by the last batch)."""

    token: tuple | None = None
    cut: bool = False


def _after(key: Sequence[str], token: tuple) -> Column:
    """The row's key comes after the token, NULLs first."""
    later, equal = [], F.lit(True)
    for name, value in zip(key, token, strict=True):
        c = F.col(name)
        later.append(equal & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))))
        equal = equal & c.eqNullSafe(F.lit(value))
    return reduce(Column.__or__, later)


def extract(df: DataFrame, max_rows: int | None = None, batch_size: int = BATCH, key: Sequence[str] | None = None,
            after: tuple | None = None) -> Iterator[Batch]:
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if after is not None:
        if not key:
            raise ValueError("a restart needs the key")
        df = df.where(_after(key, tuple(after)))
    if key:
        df = df.orderBy(*(F.asc_nulls_first(k) for k in key))
    if max_rows is not None:
        df = df.limit(max_rows + 1)
    batch, seen = Batch(), 0
    for row in df.toLocalIterator(prefetchPartitions=False):
        if max_rows is not None and seen == max_rows:
            batch.cut = True
            break
        token = tuple(row[k] for k in key) if key else None
        if len(batch) >= batch_size and (not key or token != batch.token):
            yield batch
            batch = Batch()
        batch.append(row.asDict())
        batch.token, seen = token, seen + 1
    if batch.cut and key and max_rows:  # rows of the cut key come whole after a restart
        last = batch.token
        if token_of(row, key) == last:
            whole = Batch(r for r in batch if tuple(r[k] for k in key) != last)
            if not whole:
                raise ValueError(f"max_rows is smaller than the rows of one key: {last}")
            whole.token, whole.cut, batch = tuple(whole[-1][k] for k in key), True, whole
    if batch:
        yield batch


def token_of(row, key: Sequence[str]) -> tuple:
    return tuple(row[k] for k in key)


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write the whole result from the executors (no driver round trip)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
