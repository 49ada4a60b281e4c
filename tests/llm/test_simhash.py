from shelfwise.llm.simhash import one_of_each, simhash_components


def test_groups_equal_brute_force(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", "  ", "A b", base, base.upper(), *(base + f" x{i}" for i in range(12)), "other words here now"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, base)], "doc_id long, text string")
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash_components(df).collect()]
    assert len(got) == len(texts) + 1
    comp = {d: d for d, *_ in got}
    for _ in got:
        for d, x, _ in got:
            comp[d] = min(comp[e] for e, y, _ in got if (x ^ y).bit_count() <= 2)
    assert all(comp[d] == c for d, _, c in got)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "x"), (None, "a b c d", 2, "y"), (7, "a b c d", 3, "z"), (7, "wholly other text of words", 4, None),
                                (3, None, 5, None), (9, "long " * 200_000, 6, None), (7, "a b c d", 3, "z")], "doc_id long, text string, fp long, c string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(df).collect()]
    assert len(got) == 7 and {r[2] for r in got if r[1] == got[[x[0] for x in got].index(None)][1]} == {7}
    assert (3, "0" * 16, 3) in got
    assert sorted((r.doc_id, r.fp) for r in one_of_each(df).collect()) == [(3, 5), (7, 3), (7, 4), (9, 6)]
    assert simhash_components(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, "p q r")] * 3, "doc_id long, text string")
    assert one_of_each(nobody).count() == 1 and {r.component_id for r in simhash_components(nobody).collect()} == {None}
