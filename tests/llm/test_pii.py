import hashlib
import re

from pyspark.sql import functions as F

from shelfwise.llm.pii import BASE, find_pii, mask, op9_pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) < 256 for p in v.split(".")) if kind == "ip" else False,
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(PLAIN[k], text or "") if ok(k, m[0])]


TEXTS = [None, "", "a@b.c_d@e.f x@y z@-.- ü@a.bc a.b@c.d@e.f 💥 q@w.e", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 9.9.9",
         "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 5 4111111111111111", "1 4111111111111111", "4111111111111111 x 4111111111111111-",
         "+49 (30) 1234-567. +1 +123456789012345678 ++12345678901 +55", "@" * 50, "1" * 3000, "a." * 3000 + "@b", "x@" + "a." * 6000 + "c",
         "é 10.0.0.1 " * 500, "7" * 19 + " 0" * 20]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_plain_patterns(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in BASE] for r in find_pii(frame(spark, TEXTS)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_query_digests_on_documents(spark):
    rows = {r.doc_id: r for r in op9_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) > 0
    for d in docs:
        want = brute(d.text)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert rows[d.doc_id].n_email == sum(k == "email" for k, *_ in want)


def test_context_and_checksums(spark):
    texts = ["call 555-123-4567 now", "lot 555-123-4567 now", "IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.",
             "ssn 123-45-6789", "ssn 000-45-6789"]
    got = [[s.kind for s in r.pii_spans] for r in find_pii(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["local_phone"], [], ["iban"], [], ["national_id"], []]


def test_iban_with_text_after(spark):
    de, no, gb = "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB82WEST12345698765432"
    cases = {f"IBAN {de.replace(' ', '')} Please pay": [de.replace(" ", "")], f"{de} BIC COBADEFF": [de], f"pay {de} 5 times": [de],
             f"{no} A 1 B 2 C 3": [no], f"REF AB12 3456 7890 {gb} {de} {no} X": [gb, de, no], f"{gb}X and x{gb}": [], f"é {de}00": [],
             f"DE89 3704 0044 0532 0130 01 {gb}, {no}": [gb, no], "RF18 5390 0754 7034 Ref 7": ["RF18 5390 0754 7034"], f"{de}\n{gb} OK": [de, gb]}
    for t, r in zip(cases, find_pii(frame(spark, list(cases))).orderBy("doc_id").collect()):
        got = [s for s in r.pii_spans if s.kind == "iban"]
        assert [s.value for s in got] == cases[t] and all(t[s.start:s.end] == s.value for s in got), t
    df = find_pii(frame(spark, [f"To {de} BIC COBADEFF now"]))
    assert df.select(mask(F.col("text"), F.col("pii_spans")).alias("m")).first().m == "To [iban] BIC COBADEFF now"


def test_context_on_both_sides(spark):
    texts = ["555-123-4567 (phone)", "123-45-6789 is my SSN", "555-123-4567" + " " * 41 + "phone", "555-123-4567" + " " * 35 + "phones",
             "123-45-6789, 987-65-4321 and 223-45-6789: my SSN"]
    got = [[s.value for s in r.pii_spans] for r in find_pii(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["555-123-4567"], ["123-45-6789"], [], [], ["123-45-6789", "223-45-6789"]]


def test_mask_unions_overlaps(spark):
    df = find_pii(frame(spark, ["mail é a@b.cd or 10.0.0.1!", "none", "see 1.2.3.4@a.bc now"]))
    got = [r.m for r in df.orderBy("doc_id").select(mask(F.col("text"), F.col("pii_spans")).alias("m")).collect()]
    assert got[:2] == ["mail é [email] or [ip]!", "none"] and got[2] == "see [email] now"


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string, kind string")).count() == 0
