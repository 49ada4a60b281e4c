import hashlib
import random

import numpy as np
import pytest

from shelfwise.llm.recurring import LATER, OPEN, SOURCE, _Bucket
from shelfwise.llm.suffix_dedup import later_heads, op5_suffix_dedup, remove_repeated_strings


def brute(docs, size=50):
    first, out = {}, []
    split = [(i, (t or "").encode()) for i, t in docs]
    for i, b in split:
        for k in range(len(b) - size + 1) if i is not None else ():
            first[b[k:k + size]] = min(first.get(b[k:k + size], i), i)
    for i, b in split:
        gone, reach = bytearray(len(b)), 0
        for k in range(len(b)):
            if i is not None and k + size <= len(b) and first[b[k:k + size]] < i:
                reach = k + size
            gone[k] = k < reach
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_small_cases(spark):
    p = " ".join(f"p{i}é" for i in range(60))
    docs = [(5, p), (3, "x" + p + "y"), (9, p), (9, p), (9, "ab" + p[20:90] + "cd" + p[100:160]), (None, p), (1, None), (2, ""), (4, "a" * 400), (7, "a" * 70 + "b"),
            (8, p[:49]), (6, p[:50]), (10, "zw💥" * 30000 + p[7:80].upper()), (11, "w💥z" * 20), (12, "\0" * 60), (13, "\0" * 55 + "q")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, key string")
    assert rows(remove_repeated_strings(df)) == brute(docs)
    assert remove_repeated_strings(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = rows(op5_suffix_dedup(spark, d))
    assert got == brute(docs) and any(r[2] for r in got)


def mixed(seed):
    """Documents of shared passages in many contexts, few letters (many phrases a trigger), repeated rows, shared and null ids."""
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcdeé \n", k=rnd.randrange(40, 200))) for _ in range(6)]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            parts += ["".join(rnd.choices("xyz", k=rnd.randrange(30))), p if rnd.random() < 0.6 else p[a:], rnd.choice(("", "ab" * 60, "q" * 130))]
        docs.append((rnd.choice((None, rnd.randrange(120), rnd.randrange(120))), "".join(parts)))
    return docs + docs[:20] * 3


@pytest.mark.parametrize("most_forms, bucket_bytes", [(4096, 32_000_000), (3, 3_000), (1, 500)])
def test_hot_triggers_and_many_buckets(spark, most_forms, bucket_bytes):
    docs = mixed(most_forms)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    assert rows(remove_repeated_strings(df, bucket_bytes=bucket_bytes, most_forms=most_forms)) == brute(docs)


def test_bounded_parts_give_the_same_order():
    rnd = np.random.default_rng(1)
    data = np.tile(rnd.integers(0, 3, 400).astype(np.uint8), 5)
    start, ids = np.arange(1800), rnd.integers(0, 9, 1800)
    want = [min(ids[k] for k in start if (data[k:k + 7] == data[i:i + 7]).all()) < ids[i] for i in start]
    assert later_heads(data, start, ids, 7).tolist() == later_heads(data, start, ids, 7, at_once=100).tolist() == want
    assert not len(later_heads(data, start[:0], ids[:0], 7))


def test_bucket_settles_step_by_step():
    """However its rows come in, a bucket tells the same runs as later, open, source or hot."""
    rnd = np.random.default_rng(2)
    trigger, content = rnd.integers(0, 20, 600).astype(np.uint32), rnd.integers(0, 25, 600).astype(np.uint64)
    ids, number = rnd.integers(0, 30, 600), np.arange(600)

    def told(pending, pieces):
        b, out = _Bucket(3, 100, pending), []
        for p in np.array_split(np.arange(600), pieces):
            out += list(b.add(trigger[p], content[p], np.zeros(len(p), bool), ids[p], ids[p], number[p]))
        out += list(b.end())
        rows = [x for r in out for x in r.to_pylist() if x["group"] >= 0]
        return {(np.frombuffer(x["ids"], np.int64)[at], y & 15, y >> 4) for x in rows
                for at, y in zip(np.frombuffer(x["at"], np.uint32).tolist(), np.frombuffer(x["told"], np.uint32).tolist())}
    assert told(10_000, 1) == told(10_000, 7) == told(50, 30) and {c for _, c, _ in told(50, 30)} == {LATER, OPEN, OPEN + SOURCE}
