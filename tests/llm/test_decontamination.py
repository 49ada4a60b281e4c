import re

import numpy as np

from shelfwise.llm.decontamination import contained_items, op8_decontamination
from shelfwise.llm.wordhash import BLANK, lower, shingle_hashes, word_hashes, words


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w)) if k == 5 else k
    return k, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(docs, items):
    out = set()
    for i, t in items:
        k, own = shingles(t)
        for d, x in docs:
            held = shingles(x, k)[1] if k != 5 else {s for s in shingles(x)[1] if len(s) == 5}
            if own and len(own & held) >= 0.8 * len(own):
                out.add((d, i, len(own & held)))
    return out


def test_word_hashes_depend_on_words_alone():
    for gap in ("", " ", "\n \t"):
        d = lower(gap + "Ab cd ab é x" + gap)
        s, e = words(d, BLANK)
        h = word_hashes(d, s, e)
        assert len(h) == 5 and h[0] == h[2] and len(set(h.tolist())) == 4
        if gap == "":
            first = h
        assert (h == first).all() and len(shingle_hashes(h, 6)) == 0
    assert len(word_hashes(lower(None), np.zeros(0, int), np.zeros(0, int))) == 0


def test_small_cases(spark):
    item = " ".join(f"w{i}" for i in range(30))
    part = " ".join(f"w{i}" for i in range(26)) + " other"
    docs = [(1, None), (2, ""), (3, "x " * 5000 + item.upper() + " y" * 5000), (3, item), (4, part), (5, " ".join(f"w{i}" for i in range(20))), (6, "so Tiny. item")]
    items = [(1, item), (1, item), (2, "tiny item"), (3, None), (4, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        got = sorted((r.doc_id, r.item_id, r.n_shared) for r in contained_items(df, it, block_bytes=block).collect())
        assert set(got) == brute(docs, items) and got.count((4, 1, 22)) == 2 and (6, 2, 1) in got
    assert contained_items(df, it.limit(0)).count() == 0 and contained_items(df.limit(0), it).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.n_shared) for r in op8_decontamination(spark, d).collect()}
    assert got == brute(docs, items) and got


def test_string_item_ids(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "and " + item.upper() + " so"), (2, "other")], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", item), ("q-2", "never seen words in any of these texts")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()] == [(1, "q-1")]
