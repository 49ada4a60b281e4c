"""Runs of windows that share a trigger, and which of them recur in other documents.

A text is a row of items (bytes, words), a window is ``size`` items that follow each
other. The rolling hash of ``gram`` items triggers where it is the smallest in a
window, so every window holds a trigger and equal windows have equal ones; windows
that follow each other with one trigger make a run, a phrase of the text. Only runs
whose trigger another document has can hold a window that recurs.

``replies`` finds them without text or row for each run: every task sends its runs'
trigger and content hashes as packed arrays to buckets (by trigger), having settled
equal runs of its own slice; a bucket keeps the smallest document of each content and
answers the rest. A trigger with over ``most_forms`` contents is answered at once and
kept no longer, so that a bucket's memory is bounded however hot a trigger is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.wordhash import mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
LATER, OPEN, SOURCE, HOT = 1, 2, 4, 8
"""A run: of a content that a smaller document has; of a trigger with several contents in several documents; the
first of a content that later documents have (those told as LATER have theirs told); of a trigger with too many contents
to compare in one task."""

Items = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20), base, np.uint64)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Sums:
    """Hashes of any stretch of a row of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE >> 1))

    def grams(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:len(self.sums) - width])


def runs(values: np.ndarray, lengths: np.ndarray, size: int, gram: int, longest: int = 64):
    """Document, number in the document, first window, number of windows, trigger and content hash of each run.

    ``values`` are the items of documents of the given lengths, one after another. A run of over
    ``longest`` windows (a text that repeats itself at once) is cut, so that none is unbounded.
    """
    begin = np.cumsum(lengths) - lengths
    long = np.flatnonzero(lengths >= size)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = Sums(values)
    low, width, done = sums.grams(gram), size - gram + 1, 1
    while done < width:  # the minimum of `width` hashes by doubling
        k = min(done, width - done)
        low = np.minimum(low[:-k], low[k:])
        done += k
    inside = np.zeros(len(low) + 1, np.int8)
    last = begin[long] + lengths[long] - size + 1
    inside[begin[long]] += 1
    inside[last] -= 1
    new = np.r_[True, low[1:] != low[:-1]]
    new[begin[long]] = True
    first = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    doc = np.searchsorted(begin[long], first, side="right") - 1
    n = np.minimum(np.r_[first[1:], len(low)], last[doc]) - first
    if n.max() > longest:
        parts = -(-n // longest)
        of = np.repeat(np.arange(len(n)), parts)
        step = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * longest
        first, doc, n = first[of] + step, doc[of], np.minimum(n[of] - step, longest)
    content = sums.of(first, first + n + size - 1)
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    number = np.arange(len(doc)) - np.repeat(heads, np.diff(np.r_[heads, len(doc)]))
    return long[doc], number, first - begin[long[doc]], n, low[first], content


def slices(raw: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of texts of up to ``most`` bytes in all (a longer text alone)."""
    at, size = 0, 0
    for i, x in enumerate(raw):
        if i > at and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(raw):
        yield at, len(raw)


def stretch(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The items of stretches, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def row_of(schema: pa.Schema, *values) -> pa.RecordBatch:
    """One row; arrays become binary values."""
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], t) for v, t in zip(values, schema.types)], schema=schema)


def small(x: np.ndarray) -> bytes:
    """Whole numbers in two or four bytes each."""
    return x.astype("<u2" if len(x) == 0 or x.max() < 1 << 16 else "<u4").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def high(trigger: np.ndarray) -> np.ndarray:
    """The half of a trigger that tells it within its bucket."""
    return (trigger >> np.uint64(32)).astype(np.uint32)


_SENT = pa.schema([("bucket", pa.int32()), ("later", pa.bool_()), *((c, pa.binary()) for c in ("trigger", "content", "shared", "at", "number", "ids", "keys"))])
_SENT_SQL = "bucket int, later boolean, trigger binary, content binary, shared binary, at binary, number binary, ids binary, keys binary"
_REPLY = pa.schema([("group", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "at", "told"))])
REPLY_SQL = "group int, ids binary, keys binary, at binary, told binary"
_TOLD = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("told", pa.binary())])
_TOLD_SQL = "doc_id long, key long, told binary"


def _scan(items: Items, size: int, gram: int, buckets: int):
    def run(batches):
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            all_ids, all_keys = b.column("doc_id").to_numpy(), b.column("key").to_numpy()
            for i, k in slices(raw):
                _, once = np.unique(np.stack((all_ids[i:k], all_keys[i:k])), axis=1, return_index=True)  # repeated rows once
                ids, keys = all_ids[i:k][once], all_keys[i:k][once]
                doc, number, _, _, trigger, content = runs(*items([raw[i + x] for x in once]), size, gram)
                if not len(doc):
                    continue
                order = np.lexsort((ids[doc], content))
                doc, number, trigger, content = (x[order] for x in (doc, number, trigger, content))
                head = np.r_[True, content[1:] != content[:-1]]
                of = np.cumsum(head) - 1
                later = ids[doc] > ids[doc[head]][of]
                shared = np.logical_or.reduceat(later, np.flatnonzero(head))[of]
                to = (trigger % np.uint64(buckets)).astype(np.int64) * 2 + later
                order = np.lexsort((number, doc, to))
                for some in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    mine, at = np.unique(doc[some], return_inverse=True)
                    settled = bool(later[some[0]])
                    yield row_of(_SENT, int(to[some[0]]) // 2, settled, high(trigger[some]), content[some][:0 if settled else None],
                                 shared[some][:0 if settled else None], small(at), small(number[some]), ids[mine], keys[mine])
    return run


class _Bucket:
    """Runs of the triggers of one bucket: of each content those of the smallest document."""

    def __init__(self, groups: int, most_forms: int, most_pending: int = 4_000_000):
        self.groups, self.most_forms, self.most_pending = groups, most_forms, most_pending
        self.held: list[tuple] = []
        self.answers: list[tuple] = []
        self.pending = self.answered = 0
        self.hot = np.zeros(0, np.uint32)
        self.heavy: dict[int, int] = {}

    def answer(self, some, code, ids, keys, number, trigger) -> None:
        if not some.any():
            return
        if code == LATER:
            for x, n in zip(*(y.tolist() for y in np.unique(trigger[some], return_counts=True))):
                if n >= 16 or x in self.heavy:
                    self.heavy[x] = self.heavy.get(x, 0) + n
        self.answers.append((ids[some], keys[some], number[some].astype(np.uint32) << np.uint32(4) | np.uint32(code)))
        self.answered += int(some.sum())

    def sent(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The answers so far, a row for each group of documents; at last the triggers with many later runs (group -1)."""
        if self.answers and (last or self.answered >= self.most_pending):
            ids, keys, told = (np.concatenate(x) for x in zip(*self.answers))
            group = (mix(ids.astype(np.uint64) ^ mix(keys.astype(np.uint64))) % np.uint64(self.groups)).astype(np.int64)
            order = np.lexsort((told, keys, ids, group))
            for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                new = np.r_[True, (np.diff(ids[some]) != 0) | (np.diff(keys[some]) != 0)]
                yield row_of(_REPLY, int(group[some[0]]), ids[some][new], keys[some][new], (np.cumsum(new) - 1).astype(np.uint32), told[some])
            self.answers, self.answered = [], 0
        if last and self.heavy:
            yield row_of(_REPLY, -1, None, None, np.array([*self.heavy], np.uint32), np.array([*self.heavy.values()], np.int64))

    def settled(self, trigger, ids, keys, number) -> Iterator[pa.RecordBatch]:
        """Runs that a smaller document of their slice has."""
        self.answer(np.ones(len(ids), bool), LATER, ids, keys, number, trigger)
        yield from self.sent(False)

    def add(self, trigger, content, shared, ids, keys, number) -> Iterator[pa.RecordBatch]:
        """``shared``: the run's content has been seen in a later document."""
        if len(self.hot):
            hot = np.isin(trigger, self.hot)
            self.answer(hot, HOT, ids, keys, number, trigger)
            trigger, content, shared, ids, keys, number = (x[~hot] for x in (trigger, content, shared, ids, keys, number))
        self.held.append((trigger, content, ids, keys, number, shared))
        self.pending += len(ids)
        if self.pending >= self.most_pending:
            self.settle(False)
        yield from self.sent(False)

    def end(self) -> Iterator[pa.RecordBatch]:
        self.settle(True)
        yield from self.sent(True)

    def settle(self, last: bool) -> None:
        """Answers what is certain; the rest stays, or is answered too if nothing more comes."""
        held, self.held, self.pending = [np.concatenate(x) for x in zip(*self.held)], [], 0
        if not held or not len(held[0]):
            return
        order = np.lexsort((held[4], held[3], held[2], held[1], held[0]))
        trigger, content, ids, keys, number, shared = (x[order] for x in held)
        once = np.r_[True, (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1]) | (ids[1:] != ids[:-1])
                     | (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])]  # a repeated row's runs came more than once
        shared = np.logical_or.reduceat(shared, np.flatnonzero(once))
        trigger, content, ids, keys, number = (x[once] for x in (trigger, content, ids, keys, number))
        head = np.r_[True, trigger[1:] != trigger[:-1]]
        form = head | np.r_[True, content[1:] != content[:-1]]
        of = np.cumsum(form) - 1
        later = ids > ids[form][of]
        self.answer(later, LATER, ids, keys, number, trigger)
        shared = np.logical_or.reduceat(shared | later, np.flatnonzero(form))[of]
        trigger, content, ids, keys, number, shared, head, form = (x[~later] for x in (trigger, content, ids, keys, number, shared, head, form))
        group, starts = np.cumsum(head) - 1, np.flatnonzero(head)  # a content's first row is never a later one
        forms = np.add.reduceat(form.astype(np.int64), starts)
        hot = (forms > self.most_forms)[group]
        self.answer(hot & ~shared, HOT, ids, keys, number, trigger)
        self.answer(hot & shared, HOT + SOURCE, ids, keys, number, trigger)
        self.hot = np.union1d(self.hot, trigger[hot])
        if last:
            several = (forms > 1) & (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
            code = np.where(hot, 0, several[group] * OPEN + shared * SOURCE)
            for c in (OPEN, SOURCE, OPEN + SOURCE):
                self.answer(code == c, c, ids, keys, number, trigger)
        else:
            self.held = [tuple(x[~hot] for x in (trigger, content, ids, keys, number, shared))]


def _buckets(groups: int, most_forms: int):
    def run(batches):
        now, state = None, _Bucket(groups, most_forms)
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    yield from state.end()
                    now, state = r["bucket"], _Bucket(groups, most_forms)
                ids, keys, trigger = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["trigger"], np.uint32)
                at, number = unsmall(r["at"], len(trigger)), unsmall(r["number"], len(trigger))
                if r["later"]:
                    yield from state.settled(trigger, ids[at], keys[at], number)
                else:
                    yield from state.add(trigger, np.frombuffer(r["content"], np.uint64), np.frombuffer(r["shared"], bool), ids[at], keys[at], number)
        yield from state.end()
    return run


def replies(body: DataFrame, items: Items, size: int, gram: int, buckets: int, most_forms: int = 4096) -> DataFrame:
    """The runs that may recur, packed by groups of documents (see ``by_document``).

    ``body`` has doc_id (no nulls), key (tells rows of one doc_id apart) and text. Rows that share a doc_id are
    no source for each other. A run can be told more than once (LATER and another code), never less than it is.
    """
    sent = body.select("doc_id", "key", "text").mapInArrow(_scan(items, size, gram, buckets), _SENT_SQL)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(buckets, most_forms), REPLY_SQL)


def _told(at_once: int = 4_000_000):
    def merged(held):
        ids, keys, told = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((told, keys, ids))
        ids, keys, told = ids[order], keys[order], told[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (told[1:] != told[:-1])]
        return [(ids[new], keys[new], told[new])]

    def settle(held):
        if held:
            ids, keys, told = merged(held)[0]
            head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
            ends = [*head[1:].tolist(), len(ids)]
            for i in range(0, len(head), 10_000):
                at = head[i:i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(keys[at]),
                     pa.array([told[x:y].tobytes() for x, y in zip(at.tolist(), ends[i:i + 10_000])], pa.binary())], schema=_TOLD)

    def run(batches):
        now, held, size = None, [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["group"] != now:
                    yield from settle(held)
                    now, held, size = r["group"], [], 0
                at, told = np.frombuffer(r["at"], np.uint32), np.frombuffer(r["told"], np.uint32)
                held.append((np.frombuffer(r["ids"], np.int64)[at], np.frombuffer(r["keys"], np.int64)[at], told))
                size += len(told)
                if size > at_once:
                    held, size = merged(held), 0
        yield from settle(held)
    return run


def by_document(found: DataFrame, groups: int) -> DataFrame:
    """doc_id, key and told of each document that has runs which may recur: uint32 numbers, run number << 4 | codes."""
    return (found.where("group >= 0").repartition(groups, "group").sortWithinPartitions("group").mapInArrow(_told(), _TOLD_SQL))


def chosen(told: list[bytes], base: np.ndarray, code: int) -> np.ndarray:
    """The runs that bear ``code``; the runs of document i begin at ``base[i]``."""
    out = []
    for at, raw in zip(base.tolist(), told):
        x = np.frombuffer(raw, np.uint32)
        out.append(at + (x[(x & code) > 0] >> 4).astype(np.int64))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def bodies(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and text (null: empty) of each row."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return body.withColumn("key", F.xxhash64("text"))


def buckets_for(body: DataFrame, bytes_each: int) -> int:
    """Buckets of about ``bytes_each`` bytes of text."""
    return 1 + (body.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_each


CUTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("cuts", pa.binary())])
CUTS_SQL = "doc_id long, key long, cuts binary"


def joined(ids, keys, start, end):
    """Stretches by document, those that touch made one."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[order], keys[order], start[order], end[order]
    same = np.r_[False, (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])][:len(ids)]
    heads = np.flatnonzero(~(same & np.r_[False, start[1:] <= end[:-1]][:len(ids)]))
    return ids[heads], keys[heads], start[heads], np.maximum.reduceat(end, heads) if len(heads) else end[:0]


def spans(ids, keys, start, end):
    """One row a document: its stretches (start and end, int64), those that touch joined."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[order], keys[order], start[order], end[order]
    same = np.r_[False, (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])][:len(ids)]
    new = ~(same & np.r_[False, start[1:] <= end[:-1]][:len(ids)])
    heads = np.flatnonzero(new)
    pairs = np.stack((start[heads], np.maximum.reduceat(end, heads)), 1)
    docs = np.flatnonzero(~same[heads])
    ends = [*docs[1:].tolist(), len(heads)]
    return pa.RecordBatch.from_arrays([pa.array(ids[heads][docs]), pa.array(keys[heads][docs]),
                                       pa.array([pairs[i:k].astype(np.int64).tobytes() for i, k in zip(docs.tolist(), ends)], pa.binary())], schema=CUTS)


_PACKED = pa.schema([("group", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "start", "end"))])
PACKED_SQL = "group int, ids binary, keys binary, start binary, end binary"


def packed(ids, keys, start, end, groups: int) -> Iterator[pa.RecordBatch]:
    """Stretches of many documents, a row for each group of documents."""
    group = (mix(ids.astype(np.uint64) ^ mix(keys.astype(np.uint64))) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        yield row_of(_PACKED, int(group[some[0]]), *joined(*(x[some] for x in (ids, keys, start, end))))


def _unpacked(at_once: int = 4_000_000):
    def run(batches):
        now, held, size = None, [], 0

        def settle():
            if held:
                yield spans(*(np.concatenate(x) for x in zip(*held)))
        for b in batches:
            for r in b.to_pylist():
                if r["group"] != now:
                    yield from settle()
                    now, held, size = r["group"], [], 0
                held.append(tuple(np.frombuffer(r[c], np.int64) for c in ("ids", "keys", "start", "end")))
                size += len(held[-1][0])
                if size > at_once:
                    held = [joined(*(np.concatenate(x) for x in zip(*held)))]
                    size = 0
        yield from settle()
    return run


def cuts_by_document(found: DataFrame, groups: int) -> DataFrame:
    """doc_id, key and cuts (pairs of int64) of each document that has stretches."""
    return found.repartition(groups, "group").sortWithinPartitions("group").mapInArrow(_unpacked(), CUTS_SQL)
