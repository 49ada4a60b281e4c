"""Repeated keys of a table by one shuffle of packed keys.

A task deals its keys into parts (as many as ``spark.sql.shuffle.partitions``), drops repeats (with their
number) and packs what is left of a part: sorted, whole numbers as differences with their bytes in planes,
compressed. All packs of a key's part meet in one group, where the keys themselves are compared; nothing
is decided by hashes. A key of very many rows is one entry a pack.

Conditions on rows travel with the keys as bits and are counted before the shuffle, so that a table is
computed once for all of its rules. Columns go by their places, so that tables made of the same columns
share their packs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows, and bytes of text, that a task holds of a key before it packs them; key numbers of a range that stay together; bits of a mask.
HELD_ROWS, HELD_BYTES, NEAR, BITS = 1 << 20, 1 << 26, 14, 62
SPREAD = np.uint64(0x9E3779B97F4A7C15)
PACKED_SQL = "no int, part int, n long, size long, pack binary"
FOUND_SQL = "no int, key binary, n long"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def forms(df: DataFrame, columns: Iterable[str]) -> list[str] | None:
    """How a key is packed: its numbers and dates, or one text of all of it; None: it cannot be."""
    kinds = [df.schema[c].dataType for c in columns]
    how = ["whole" if isinstance(k, WHOLE) else {T.DateType(): "date", T.StringType(): "text"}.get(k) for k in kinds]
    return None if not all(how) else ["text"] if "text" in how else how


def text(columns: Iterable[str]) -> Column:
    """A key as text; NULL if a part is. Lengths keep parts apart."""
    parts = [F.col(c).cast("string") for c in columns]
    return parts[0] if len(parts) == 1 else F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))


def repeated(df: DataFrame, keys: list[tuple[str, ...]], conditions: list[Column], told: bool = True) -> DataFrame:
    """no (place in ``keys``), key and n of every key that stands more than once; with ``told`` False the number n of such
    keys. Of conditions (places behind the keys), the number n of rows that meet them."""
    sent, read, how = [], [], [forms(df, columns) for columns in keys]
    for columns, h in zip(keys, how):
        if h == ["text"]:
            whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
            values = [F.when(whole, x) for x in (text(columns).cast("binary"), F.xxhash64(*columns))]
        else:
            values = [(F.unix_date(c) if x == "date" else F.col(c)).cast("long") for c, x in zip(columns, h)]
        read.append(list(range(len(sent), len(sent) + len(values))))
        sent += values
    masks = [conditions[at:at + BITS] for at in range(0, len(conditions), BITS)]
    sent += (reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(some))) for some in masks)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = df.select(*(c.alias(f"c{i}") for i, c in enumerate(sent))).mapInArrow(_packer(read, len(masks), parts), PACKED_SQL)
    return packs.groupBy("no", "part").applyInArrow(_finder(how, told), FOUND_SQL)


def _packer(keys: list[list[int]], masks: int, parts: int):
    def run(batches):
        held, met = [[] for _ in keys], Counter()
        for batch in batches:
            for no, places in enumerate(keys):
                some = batch.select(places)
                lacks = [c for c in some.columns if c.null_count]
                some = some.filter(reduce(pc.and_, (c.is_valid() for c in lacks))) if lacks else some
                held[no] += [some] if len(some) else []
                if sum(map(len, held[no])) >= HELD_ROWS or sum(x.nbytes for x in held[no]) >= HELD_BYTES:
                    yield _packs(no, held[no], parts)
                    held[no] = []
            for k in range(masks):
                mask = batch.column(batch.num_columns - masks + k).to_numpy()
                for i in range(BITS) if mask.any() else ():
                    met[len(keys) + k * BITS + i] += int(np.count_nonzero(mask >> i & 1))
        for no, some in enumerate(held):
            yield _packs(no, some, parts)
        yield _batch(*zip(*((no, -1, n, 0, None) for no, n in met.items() if n)))
    return run


def _parts(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The part of each key of numbers; neighbours of a single number stay together, where they differ by little."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (c >> NEAR if len(columns) == 1 else c).view(np.uint64)) * SPREAD
        h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.int32)


def _finder(how: list[list[str]], told: bool):
    def found(no: int, n, key) -> pa.Table:
        return pa.table([pa.array([no] * len(n), pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["no", "key", "n"])

    def run(packs: pa.Table) -> pa.Table:
        no, part, n, size, pack = (packs[c].to_pylist() for c in ("no", "part", "n", "size", "pack"))
        if part[0] < 0:
            return found(no[0], [sum(n)], [None])
        columns = [_joined(c) for c in zip(*(_columns(*x, how[no[0]]) for x in zip(pack, n, size)))]
        (*columns, n), new = _sorted(columns[1:], columns[0])
        first = np.flatnonzero(new)
        n = np.add.reduceat(n, first)
        twice = n > 1
        if not told:
            return found(no[0], [int(twice.sum())], [None])
        texts = [_texts(c, first[twice], h) for c, h in zip(columns, how[no[0]])]
        return found(no[0], n[twice], texts[0] if len(texts) == 1 else [b"".join(b"%d:%s" % (len(t), t) for t in ts) for ts in zip(*texts)])
    return run


def _joined(columns: tuple):
    return np.concatenate(columns) if isinstance(columns[0], np.ndarray) else pa.concat_arrays(columns)


def _texts(column, at: np.ndarray, how: str) -> list[bytes]:
    """As Spark casts them."""
    if how == "text":
        return column.take(pa.array(at)).to_pylist()
    if how == "whole":
        return [b"%d" % x for x in column[at].tolist()]
    return [(b"+" if x[0:1] != b"-" and x.index(b"-") > 4 else b"") + x for x in map(bytes, column[at].astype("datetime64[D]").astype("S"))]


def _batch(*columns) -> pa.RecordBatch:
    columns = columns or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["no", "part", "n", "size", "pack"])


def _sorted(columns: list, *beside: np.ndarray) -> tuple[list, np.ndarray]:
    """The columns (and those beside them) in the order of the columns, and where a row differs from the one before."""
    if all(isinstance(c, np.ndarray) for c in columns):
        order = np.lexsort(columns[::-1])
    else:
        names = [str(i) for i in range(len(columns))]
        order = pc.sort_indices(pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names), [(n, "ascending") for n in names]).to_numpy()
    columns = [c[order] if isinstance(c, np.ndarray) else c.take(pa.array(order)) for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return [*columns, *(c[order] for c in beside)], new


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw, at: int, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def _packs(no: int, rows: list[pa.RecordBatch], parts: int) -> pa.RecordBatch:
    """A pack for each part."""
    if not rows:
        return _batch()
    columns, out = [pa.concat_arrays(c) for c in zip(*(x.columns for x in rows))], []
    if pa.types.is_integer(columns[0].type):
        columns = [c.to_numpy() for c in columns]
        part = _parts(columns, parts)
    else:
        part = (columns.pop().to_numpy() % parts).astype(np.int32)
        columns = [columns[0].cast(pa.large_binary())]
    columns.insert(0, part)
    (part, *columns), new = _sorted(columns)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(part)])
    part, columns = part[first], [c[first] if isinstance(c, np.ndarray) else c.take(pa.array(first)) for c in columns]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    if isinstance(columns[0], np.ndarray):
        steps = np.diff(columns[0], prepend=columns[0][:1] * 0)  # beyond 2^63 it wraps, and back in _columns
        steps[at] = columns[0][at]
        columns[0] = steps
    for a, b in zip(at, [*at[1:], len(part)]):
        raw = [_planes(n[a:b])]
        for c in columns:
            if isinstance(c, np.ndarray):
                raw.append(_planes(c[a:b]))
            else:
                some = c[a:b]
                raw += [_planes(pc.binary_length(some).to_numpy()), b"".join(some.to_pylist())]
        raw = b"".join(raw)
        out.append((no, int(part[a]), int(b - a), len(raw), pa.compress(raw, "zstd", asbytes=True)))
    return _batch(*zip(*out))


def _columns(pack: bytes, n: int, size: int, how: list[str]) -> list:
    """What ``_packs`` packed: the counts and the columns of a key."""
    raw = pa.decompress(pack, size, "zstd", asbytes=True)
    out, at = [_numbers(raw, 0, n, np.int64)], 8 * n
    for i, h in enumerate(how):
        if h == "text":
            ends = np.r_[0, np.cumsum(_numbers(raw, at, n, np.int64))]
            at += 8 * n
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[at:at + int(ends[-1])])]))
            at += int(ends[-1])
        else:
            x = _numbers(raw, at, n, np.int64)
            out.append(np.cumsum(x) if not i else x)
            at += 8 * n
    return out
