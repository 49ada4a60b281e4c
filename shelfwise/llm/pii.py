"""Personal data found and masked with DataFrame functions only.

Regular expressions propose spans of each kind, validators (part ranges, Luhn,
mod-97, digit counts) confirm them, and words just before or after a span raise
its score; a span counts from ``min_score`` on. Email, ip, card and phone stand on
their validators alone; ``iban`` on mod-97; ``local_phone`` and ``national_id``
need a context word to reach the default threshold.

Positions come from the text between matches: the k-th match starts after the
first k + 1 gaps and k matches, so no position function is needed. An IBAN is
matched by its first four characters only; its end is the last word end at which
its country's length (any length for a code without one) and mod-97 agree, so
words, codes and numbers after it don't hide it. Patterns use
possessive runs and a look-behind (or the end of the last match), which finds the
same leftmost matches as the plain forms in linear time and without recursion.

Null text counts as empty and has no spans; repeated rows stay; other columns
of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
# Whole digit runs of 13 to 19 digits: shorter and longer runs could never be valid.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_REST = r"^(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?"  # one more character shows where a word is cut
IBAN_REACH = 61
# Characters of an IBAN by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN_VALID = "^(?:{}|(?!{})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}})$".format(
    "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()),
    "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values()))
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Words that name the kind of number beside them.
PHONE_WORDS = "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|teléfono|téléphone"
ID_WORDS = "ssn|social|security|national|identity|passport"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(_digits(value)), ""), worth)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    code = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _whole_iban(head: Column, rest: Column) -> Column:
    """The longest valid IBAN from its first four characters and the text after them; null without one."""
    words = F.split(F.concat(head, F.regexp_extract(rest, IBAN_REST, 0)), " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.try_element_at(F.filter(ends, lambda v: v.rlike(IBAN_VALID) & mod97(v)), F.lit(-1))


def _n_digits(low: int, high: int):
    return lambda v: F.length(_digits(v)).between(low, high)


# kind, pattern, validator, score before context, context words
KINDS = [
    ("email", EMAIL, lambda v: F.lit(True), 0.9, "mail|email"),
    ("ip", IP, lambda v: v.rlike(IP_VALID), 0.8, "ip|host|server|address"),
    ("card", CARD, lambda v: _n_digits(13, 19)(v) & luhn(v), 0.9, "card|visa|credit|debit"),
    ("phone", PHONE, _n_digits(9, 15), 0.8, PHONE_WORDS),
    ("iban", IBAN, lambda v: v.isNotNull(), 0.9, "iban|account|bank"),
    ("local_phone", LOCAL_PHONE, _n_digits(10, 10), 0.4, PHONE_WORDS),
    ("national_id", NATIONAL_ID, lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, ID_WORDS),
]
BASE = [k[0] for k in KINDS[:4]]


def _spans(text: Column, kind: str, pattern: str, valid, score: float, words: str, reach: int) -> Column:
    """Confirmed spans of one kind in text order, scored."""
    more = IBAN_REACH if kind == "iban" else 0
    edge = reach + 1  # one character more, so that a word cut by the reach is not taken for a whole one
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                         F.regexp_extract_all(text, F.lit(rf"{pattern}(?=((?s:.{{0,{edge + more}}})))"), F.lit(1)).alias("rest"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["value"]), F.lit(0))
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(edge))
        one = F.struct(s.alias("start"), e.alias("end"), x["value"].alias("value"), before.alias("before"), x["rest"].alias("after"))
        return F.struct(e.alias("at"), F.right(F.concat(before, F.coalesce(x["value"], F.lit(""))), F.lit(edge)).alias("tail"),
                        F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def whole(s: Column) -> Column:
        value = _whole_iban(s["value"], s["after"])
        n = F.length(value) - F.length(s["value"])
        return F.struct(s["start"].alias("start"), (s["end"] + n).alias("end"), value.alias("value"), s["before"].alias("before"),
                        F.substr(s["after"], n + 1, F.lit(edge)).alias("after"))

    near = rf"(?i)(?<![\p{{L}}])(?:{words})(?![\p{{L}}])"
    spans = F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(found, start, step, lambda a: a["out"]))
    spans = F.coalesce(spans, empty)
    if kind == "iban":
        spans = F.transform(spans, whole)
    spans = F.filter(spans, lambda s: valid(s["value"]))
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.when(s["before"].rlike(near) | s["after"].rlike(near), score + 0.3).otherwise(F.lit(score)).alias("score"))).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", min_score: float = 0.6, reach: int = 40) -> DataFrame:
    """The input with a column pii_spans: kind, start, end (exclusive, code points), value, score."""
    body = F.coalesce(F.col(text), F.lit(""))
    each = [_spans(body, *k, reach) for k in KINDS]
    return docs.withColumn("pii_spans", F.filter(F.concat(*each), lambda s: s["score"] >= min_score))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones: their union) replaced by its kind (the first one's, the longest at a tie) in brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], -s["e"]).alias("at"),
                        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    masked = F.aggregate(order, init, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    return F.when(F.size(spans) == 0, text).otherwise(masked)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    s = F.col("pii_spans")

    def of(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(s, lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(_digest(base), 256).alias("base_sha256"),
                        _digest(s).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
