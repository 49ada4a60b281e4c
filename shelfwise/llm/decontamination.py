"""Benchmark items found inside documents by size-partitioned MinHash containment.

Items are partitioned by their number of distinct shingles (powers of two).
An item's sketch holds its smallest shingle hashes; the length of the sketch
is set by the partition's upper size u as u - ceil(threshold * u) + 1, so a
document that holds ``threshold`` of an item's shingles must hold one of the
sketch (pigeonhole): the search misses nothing, however long the document.
Each sketch hit is a candidate (document, item), verified by the exact
containment of the item's shingles, compared as strings.

Words are runs of letters, digits and non-ASCII characters with A-Z in lower
case. Items of fewer words than the shingle width are one shingle of their own
width; items without words match nothing. Null texts hold no words; repeated
rows of either table give repeated results for each row; empty tables give no
rows; other columns are not read.

The items are the query set: they are taken in blocks of at most
``block_bytes``, whatever their number, and every block is held against all
documents, each document being read and hashed where it lies (no shuffle).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.wordhash import PLAIN, lower, shingle_hashes, word_hashes, words


def _shingles(data: np.ndarray, start, end, width: int, at=None) -> list[bytes]:
    raw = data.tobytes()
    w = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
    return [b" ".join(w[i:i + width]) for i in (range(len(w) - width + 1) if at is None else at)]


def _index(items: list[tuple], width: int, threshold: float) -> dict:
    """For each shingle width present: sorted sketch hashes with their items, and each item's shingles."""
    found = defaultdict(lambda: {"sketch": defaultdict(list), "members": {}})
    for row, text in items:
        data = lower(text)
        start, end = words(data, PLAIN)
        k = min(width, len(start))
        if not k:
            continue
        h = shingle_hashes(word_hashes(data, start, end), k)
        part = found[k]
        own = frozenset(_shingles(data, start, end, k))
        part["members"][row] = own
        distinct = np.unique(h)
        upper = 1 << (len(distinct) - 1).bit_length()
        for x in distinct[:upper - int(np.ceil(threshold * upper)) + 1].tolist():
            part["sketch"][x].append(row)
    for part in found.values():
        keys = np.array(sorted(part["sketch"]), np.uint64)
        part["rows"] = [part["sketch"][x] for x in keys.tolist()]
        part["keys"] = keys
        del part["sketch"]
        hashes = defaultdict(list)
        for row, own in part["members"].items():
            for s in own:
                hashes[s].append(row)
        part["by_shingle"] = dict(hashes)
    return dict(found)


def _search(text: str | None, index: dict, threshold: float):
    data = lower(text)
    start, end = words(data, PLAIN)
    if not len(start):
        return
    w = word_hashes(data, start, end)
    for k, part in index.items():
        h = shingle_hashes(w, k)
        if not len(h):
            continue
        at = np.minimum(np.searchsorted(part["keys"], h), len(part["keys"]) - 1)
        hit = np.unique(at[part["keys"][at] == h])
        rows = {r for i in hit.tolist() for r in part["rows"][i]}
        if not rows:
            continue
        held = Counter()
        for s in set(_shingles(data, start, end, k)):
            for r in part["by_shingle"].get(s, ()):
                if r in rows:
                    held[r] += 1
        for r, n in held.items():
            total = len(part["members"][r])
            if n >= threshold * total:
                yield r, n, total


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items, a bounded block at a time."""
    sizes = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    n = -(-int(sizes) // block_bytes) or 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.select(item_id, text).collect()]


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8,
                    block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (distinct shingles) and containment of each pair at or over the threshold."""
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, n_shared long, n_item long"
    out = None
    for block in _blocks(items, "item_id", "text", block_bytes):
        names = [r for r, _ in block]
        index = docs.sparkSession.sparkContext.broadcast(_index([(i, t) for i, (_, t) in enumerate(block)], width, threshold))

        def search(frames, index=index, names=names):
            for f in frames:
                got = [(d, names[r], n, total) for d, t in zip(f["doc_id"], f["text"]) for r, n, total in _search(t, index.value, threshold)]
                cols = list(zip(*got)) or [[]] * 4
                yield pd.DataFrame({c: pd.Series(list(v), dtype=object if c == "item_id" and kind == "string" else "Int64")
                                    for c, v in zip(("doc_id", "item_id", "n_shared", "n_item"), cols)})
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontamination": op8_decontamination}
