import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm.hard_negatives import ORACLE, exact_scores, mine, op13_hard_negatives, small_primes
from shelfwise.testing.compare import compare_query, duck_connect

SCHEMA = "vec_id long, label int, embedding array<double>, score long, slot string"


def brute(rows, anchor, positives=5, negatives=3):
    ok = {(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows
          if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, c, v in ok:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), k, d == c) for k, d, w in ok if k != i and len(w) == len(v))
        for s, p in [(-s, k) for s, k, same in scored if same][:positives]:
            near = [(-t, k) for t, k, same in scored if not same and 50 * s <= -100 * t <= 95 * s][:negatives]
            out += [(i, p, r, k, s, t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("width, size", [(0, 1), (1, 5), (64, 90), (700, 3000), (3, 10 ** 9), (5, 2 ** 40), (2, 10 ** 30)])
def test_scores_are_exact(width, size):
    rnd = random.Random(width)
    a, b = ([[float(rnd.randint(-size, size)) for _ in range(width)] for _ in range(n)] for n in (3, 4))
    a[0] = [float(size)] * width
    b[0] = [float(-size)] * width
    got = exact_scores(np.array(a).reshape(3, width), np.array(b).reshape(4, width))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert all(all(p % k for k in range(2, p)) and p // 2 * (p // 2) * min(512, max(1, width)) <= 1 << 24
               for p in small_primes(min(512, max(1, width)), width * size * size))


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    def vec(n=4): return [rnd.choice((-0.5, 0.25, 0.26, 0.5, 0.75, 1.0)) for _ in range(n)]  # few values: many ties
    data = [(i, rnd.randrange(3), vec()) for i in range(300)]
    data += [(300, None, vec()), (301, 1, None), (None, 1, vec()), (302, 1, [0.1, None, 0.2, 0.3]), (303, 1, [math.nan] * 4), (304, 1, [math.inf, 0.0, 0.0, 0.0]),
             (305, 1, []), (310, 1, []), (306, 2, []), (307, 1, vec(2)), (320, 1, vec(2)), (308, 2, vec(2)), (20, 1, vec()), (311, 1, [0.0] * 4), (330, 0, [0.0] * 4),
             (340, 0, [-1.0] * 4), (341, 0, [1e9] * 4), (342, 1, [0.4e9] * 4), (343, 1, [0.3e9] * 4)]
    data += [data[0]] * 200 + [data[7]] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)
    want = brute(data, lambda i: i % 10 == 0)
    for slot_rows in (8192, 40):
        assert rows(mine(df, F.expr("vec_id % 10 = 0"), slot_rows=slot_rows)) == want
    assert len(want) > 200 and mine(df.limit(0), F.expr("vec_id % 10 = 0")).count() == 0
    assert mine(df, F.expr("vec_id = -1")).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = compare_query(op13_hard_negatives(spark, d), ORACLE["op13_hard_negatives"], duck_connect(d))
    assert got["values_match"] and got["spark_rows"] > 50, got
