import random
import re

from shelfwise.llm.quality_rules import ORACLE, base_rules, host_rates, op7_quality_rules, quality_rules
from shelfwise.testing.compare import compare_query, duck_connect
from tests_llm_helpers import host_rates_by_hand


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts_match_brute_force(spark):
    texts = [None, "", "a b", "a b c a b c a", "x\nx\n \n\ny # $", "é ü z <b> " * 30]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in base_rules(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_empty_and_null_host(spark):
    schema = "doc_id long, text string, source string"
    assert quality_rules(spark.createDataFrame([], schema)).count() == 0
    assert quality_rules(spark.createDataFrame([(1, None, None), (1, None, None)], schema)).count() == 2


def test_host_rates_equal_a_plain_fit(spark):
    rnd = random.Random(5)
    for seed, hosts in enumerate(([(f"h{i}", 1) for i in range(300)], [("big", 400), *((f"s{i}", rnd.randrange(1, 9)) for i in range(80)), (None, 7)],
                                  [("a", 30), ("b", 30)], [("one", 5)])):
        rows = [(h, rnd.random() < (0.4 if seed != 2 else 0.9 * (h == "a"))) for h, n in hosts for _ in range(n)]
        df = spark.createDataFrame(rows, "host string, base_failed boolean")
        got, want = {r.host: r.host_rate for r in host_rates(df).collect()}, host_rates_by_hand(rows)
        assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)
        if seed == 0:  # hosts of one row say nothing about hosts
            assert len(set(round(x, 9) for x in got.values())) == 1


def test_one_bad_row_does_not_condemn_its_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 5 < 3 else bad, f"h{i}") for i in range(200)] + [(1000, None, None)] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = quality_rules(df, keep=("doc_id", "kept")).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 120 and {r.row.kept for r in got} == {1}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = compare_query(op7_quality_rules(spark, d), ORACLE["op7_quality_rules"], duck_connect(d))
    assert got["values_match"] and got["spark_rows"] == 1000, got
