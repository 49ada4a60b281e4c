import re
from itertools import permutations

import numpy as np

from shelfwise.llm.filter_audit import ALL, FAIL, PASS, ORACLE, contract, filter_audit, op11_filter_audit
from shelfwise.testing.compare import compare_query, duck_connect

DOCS = "doc_id long, text string, lang string, bits string, n long"
LABELS = "doc_id long, quality int, toxic int, lang string"


def brute(docs, labels):
    lowest = {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
                                  ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and i > lowest[t])) if bad}
        judged.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {j[0] for j in judged}:
        rows, share = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                failing = [j for j in judged if j[0] == part and f in j[1]]
                rows.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(j[1] == {f} for j in failing),
                             sum(j[2] for j in gone), sum(j[3] for j in gone)))
                share[f] += len(gone)
        out += [(*r, share[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [(5, many, "en"), (3, many, "de"), (3, many, "de"), (9, many, "en"), (None, many, "en"), (None, many, None), (1, None, None), (2, "", ""),
            (4, "A B C", "en"), (6, "x " * 150, "en"), (7, many + " # $", "fr"), (8, "x " * 150, "fr"), (8, many, "fr"), (10, "é" * 300_000 + " Ab|", "de"),
            (11, many.upper(), "en"), (12, "a\xa0b c " * 100, "en"), (3, many, "it"), (13, many.upper(), None)]
    labels = [(5, 1, 0), (5, 0, 1), (9, 1, 1), (None, 1, 1), (8, None, 1), (6, 1, None), (99, 1, 1), (3, 1, 0)]
    d = spark.createDataFrame([(*r, "k", 0) for r in docs], DOCS)
    m = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    assert rows(filter_audit(d, m)) == brute(docs, labels)
    assert rows(filter_audit(d, m.limit(0))) == brute(docs, [])
    assert filter_audit(d.limit(0), m).count() == 0


def test_contract_selects_along_each_axis():
    t = np.arange(24).reshape(3, 2, 2, 2)
    got = contract(t, np.array([[PASS, FAIL, ALL], [ALL, ALL, ALL]]))
    assert got.tolist() == [[t[m, 0, 1].sum() for m in range(3)], [t[m].sum() for m in range(3)]]


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = compare_query(op11_filter_audit(spark, d), ORACLE["op11_filter_audit"], duck_connect(d))
    assert got["values_match"] and got["spark_rows"] == 2400, got
