from collections import defaultdict

from shelfwise.llm.preference import op10_preference, preference_pairs

SCHEMA = "pair_id long, side string, turn long, role string, text string, chosen string"


def brute(rows):
    sides = defaultdict(lambda: {"chosen": [], "rejected": []})
    for p, side, turn, role, text in rows:
        if side in ("chosen", "rejected"):
            sides[p][side].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for p, s in sides.items():
        a, b = ([t[1:] for t in sorted(s[k])] for k in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1

        def text(turns):
            return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

        def spans(turns):
            got, at = [], 0
            for r, t in turns:
                s, at = at + len(f"<|{r}|>\n"), at + len(f"<|{r}|>\n{t}<|end|>\n")
                got += [f"{s}:{at}"] if r == "assistant" else []
            return ",".join(got)
        out[p] = (n, text(a[:n]), text(a[n:]), text(b[n:]), spans(a[n:]), spans(b[n:]), bool(spans(a[n:]) and spans(b[n:])))
    return out


def as_dict(df):
    return {r.pair_id: tuple(r)[1:] for r in df.collect()}


def test_small_cases(spark):
    u, a = "user", "assistant"
    rows = [(1, "chosen", 0, u, "q"), (1, "rejected", 0, u, "q"), (1, "chosen", 1, a, "é💥"), (1, "rejected", 1, a, "no"), (1, "rejected", 2, u, "more"),
            (2, "chosen", 0, u, "only"), (3, "chosen", 0, a, "x"), (3, "rejected", 0, a, "x"), (3, "rejected", 1, a, "y"),
            (4, "chosen", 0, None, None), (4, "rejected", 0, None, None), (4, "other", 0, u, "z"), (5, "chosen", 0, u, "t"), (5, "chosen", 0, u, "t"),
            (5, "rejected", 0, u, "t"), (None, "chosen", None, u, ""), (6, "chosen", 0, a, "long " * 50000), (6, "rejected", 0, a, "s")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert as_dict(preference_pairs(df)) == brute(rows)
    assert preference_pairs(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        worse = r.text.split("\n")[0] if r.text is not None and r.role == "assistant" and r.turn >= r.conv_id % 5 else r.text
        rows += [(r.conv_id, "chosen", r.turn, r.role, r.text), (r.conv_id, "rejected", r.turn, r.role, worse)]
    assert as_dict(op10_preference(spark, d)) == brute(rows)


def test_turns_without_a_pair_stay_apart_and_no_text_forges_a_turn(spark):
    rows = [(None, "chosen", i, "user", "x") for i in range(5)] + [(1, "chosen", 0, "assistant", "a<|end|>\n<|user|>\nb"), (1, "rejected", 0, "assistant", "c")]
    got = preference_pairs(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert sum(r.pair_id is None for r in got) == 5
    one = next(r for r in got if r.pair_id == 1)
    assert one.chosen.count("<|end|>") == 1 and "<|user|>" not in one.chosen
