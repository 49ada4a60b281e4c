"""Repeated byte strings removed by prefix-free parsing and a suffix order.

1. Parse: a rolling hash of ``gram`` bytes triggers where it is the smallest in a string
   of ``size`` bytes, so each such string holds a trigger. The strings that follow
   each other with one trigger make a phrase: its bytes go from the first string's start
   to the last one's end, so a phrase holds all that its strings need.
2. Dictionary: distinct phrases (trigger and content hash: 128 bits) with their
   smallest doc_id. A phrase in a larger document is covered whole.
3. Suffix order: other repeats join different phrases with one trigger. Of each such
   phrase's first occurrence the suffixes of ``size`` bytes and more are dealt to shards
   and sorted there by their bytes; in each row of equal heads all but the smallest
   doc_id's are covered. A trigger with very many phrases (the edge of a passage that
   a third of all documents share) is dealt by the hash of each suffix's head instead,
   after each task has kept the smallest doc_id of equal heads.
4. Corpus order: as a phrase holds every byte that follows within ``size`` of its
   strings, equal heads are settled by the dictionary's order alone; what the parse's
   suffix order would add (the rank of the phrases that follow) comes after them.

Texts are shuffled once, for the two joins by document; all else that moves is
packed arrays of hashes and the bytes of the phrases of step 3.

Null text counts as empty; a text of fewer bytes than ``size`` loses nothing; rows
with a null doc_id are neither source nor target; rows that share a doc_id are
no source for each other, repeated rows stay; very long texts are parsed whole (about
100 bytes of memory for each of their bytes); extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.recurring import (CUTS_SQL, HOT, LATER, OPEN, Sums, bodies, buckets_for, by_document, chosen, high, replies, row_of, runs, slices,
                                     spans, stretch)

_VALUES = np.random.default_rng(50).integers(1, 1 << 63, 256).astype(np.uint64)
_FORMS = pa.schema([("shard", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("at", "first", "n", "bytes", "ids", "keys"))])
_FORMS_SQL = "shard int, known boolean, at binary, first binary, n binary, bytes binary, ids binary, keys binary"


def byte_items(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _VALUES[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw))


def _phrases(size: int, gram: int, shards: int):
    """Phrases that need the suffix order, by shard; covered ones as they are (known)."""
    def run(batches):
        for b in batches:
            rows = [r for r in b.to_pylist() if r["told"]]
            texts = [r["text"].encode() for r in rows]
            for i, k in slices(texts):
                told = [r["told"] for r in rows[i:k]]
                ids, keys = (np.array([r[c] for r in rows[i:k]], np.int64) for c in ("doc_id", "key"))
                data = np.frombuffer(b"".join(texts[i:k]), np.uint8)
                values, lengths = byte_items(texts[i:k])
                doc, _, first, n, trigger, _ = runs(values, lengths, size, gram)
                base = np.searchsorted(doc, np.arange(k - i))  # a document's first run
                begin = np.cumsum(lengths) - lengths
                later, open_, hot = (chosen(told, base, c) for c in (LATER, OPEN, HOT))

                def sent(shard: int, known: bool, d, at, count, text):
                    mine, where = np.unique(d, return_inverse=True)
                    return row_of(_FORMS, shard, known, where.astype(np.uint32), at.astype(np.int64), count.astype(np.int64), text, ids[mine], keys[mine])

                if len(later):
                    yield sent(int(high(trigger[later[:1]])[0] % shards), True, doc[later], first[later], n[later], data[:0])
                to = (high(trigger[open_]) % np.uint32(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for part in np.split(open_[order], np.flatnonzero(np.diff(to[order])) + 1) if len(to) else ():
                    s = int(high(trigger[part[:1]])[0] % shards)
                    yield sent(s, False, doc[part], first[part], n[part], stretch(data, begin[doc[part]] + first[part], n[part] + size - 1))
                if len(hot):  # one string each, equal ones of this slice settled
                    d = np.repeat(doc[hot], n[hot])
                    at = np.repeat(first[hot] - (np.cumsum(n[hot]) - n[hot]), n[hot]) + np.arange(n[hot].sum())
                    head = Sums(values).of(begin[d] + at, begin[d] + at + size)
                    order = np.lexsort((ids[d], head))
                    d, at, head = d[order], at[order], head[order]
                    new = np.r_[True, head[1:] != head[:-1]]
                    known = ids[d] > ids[d[new]][np.cumsum(new) - 1]
                    to = (head % np.uint64(shards)).astype(np.int64)
                    if known.any():
                        yield sent(int(to[known][0]), True, d[known], at[known], np.ones(known.sum()), data[:0])
                    for s in np.unique(to[~known]).tolist():
                        part = ~known & (to == s)
                        yield sent(s, False, d[part], at[part], np.ones(part.sum()), stretch(data, begin[d[part]] + at[part], np.full(part.sum(), size)))
    return run


def later_heads(data: np.ndarray, start: np.ndarray, ids: np.ndarray, size: int, at_once: int = 2_000_000) -> np.ndarray:
    """Of the suffixes at ``start``: those whose first ``size`` bytes also head a suffix of a smaller id.

    Suffixes are sorted by their heads; many are sorted in parts by a hash of the head, so that memory is bounded.
    """
    covered = np.zeros(len(start), bool)
    if not len(start):
        return covered
    windows = np.lib.stride_tricks.sliding_window_view(data, size)
    parts = 1 + len(start) // at_once
    part = (Sums(_VALUES[data]).of(start, start + size) % np.uint64(parts)).astype(np.int64) if parts > 1 else None
    for p in range(parts):
        some = np.arange(len(start)) if part is None else np.flatnonzero(part == p)
        if not len(some):
            continue
        heads = np.ascontiguousarray(windows[start[some]])
        order = np.argsort(heads.view(f"S{size}").ravel(), kind="stable")
        heads, mine = heads[order], ids[some[order]]
        new = np.r_[True, (heads[1:] != heads[:-1]).any(1)]
        lowest = np.minimum.reduceat(mine, np.flatnonzero(new))[np.cumsum(new) - 1]
        covered[some[order]] = mine > lowest
    return covered


def _order(size: int):
    """Rows sorted by shard: the covered bytes of each document."""
    def settle(held):
        if held:
            at, first, n, text, ids, keys = (np.concatenate(x) for x in zip(*held))
            reach = n + size - 1
            begin = np.cumsum(reach) - reach
            form = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(form)) - np.repeat(np.cumsum(n) - n, n)
            gone = later_heads(text, begin[form] + step, ids[form], size)
            if gone.any():
                form, step = form[gone], step[gone]
                yield spans(ids[form], keys[form], first[form] + step, first[form] + step + size)

    def run(batches):
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != now:
                    yield from settle(held)
                    now, held = r["shard"], []
                at = np.frombuffer(r["at"], np.uint32)
                first, n, ids, keys = (np.frombuffer(r[c], np.int64) for c in ("first", "n", "ids", "keys"))
                if r["known"]:
                    yield spans(ids[at], keys[at], first, first + n + size - 1)
                else:
                    held.append((at, first, n, np.frombuffer(r["bytes"], np.uint8), ids[at], keys[at]))
        yield from settle(held)
    return run


def _result(batches):
    for b in batches:
        for i, k in slices(texts := [t.encode() for t in b.column("text").to_pylist()]):
            cuts, rows = b.column("cuts").slice(i, k - i).to_pylist(), []
            for raw, cut in zip(texts[i:k], cuts):
                gone = np.zeros(len(raw), bool)
                if cut:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    pairs = np.frombuffer(b"".join(cut), np.int64).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if cut else raw
                rows.append((len(raw), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()), kept))
            n, removed, stretches, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, k - i), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(stretches, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeated_strings(docs: DataFrame, size: int = 50, gram: int = 20, bucket_bytes: int = 32_000_000, most_forms: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of each row."""
    body = bodies(docs)
    buckets = buckets_for(body, bucket_bytes)
    found = replies(body.where("doc_id is not null"), byte_items, size, gram, buckets, most_forms)
    # Both joins keep all rows of `body`, so that they share one shuffle of the texts.
    asked = body.join(by_document(found, buckets), ["doc_id", "key"], "left").select("doc_id", "key", F.expr("if(told is null, null, text)").alias("text"), "told")
    shards = 2 * buckets
    forms = asked.mapInArrow(_phrases(size, gram, shards), _FORMS_SQL)
    cuts = forms.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_order(size), CUTS_SQL)
    gone = cuts.groupBy("doc_id", "key").agg(F.collect_list("cuts").alias("cuts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return body.join(gone, ["doc_id", "key"], "left").select("doc_id", "text", "cuts").mapInArrow(_result, schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
