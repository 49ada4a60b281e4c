import duckdb

from shelfwise.llm.url_filters import ORACLE, op2_url_filters, url_verdicts

CAP = "page_id long, url string, fetched long, list string"
ENT = "list string, kind string, pattern string, day long, action string"


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in op2_url_filters(spark, d).collect())
    duckdb.sql(f"create or replace view pages as select * from '{d}/pages.parquet'")
    assert got == sorted(duckdb.sql(ORACLE["op2_url_filters"]).fetchall()) and any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_intervals_and_kinds(spark):
    ent = [("a", "host", "X.com", 5, "add"), ("a", "host", "x.com", 8, "remove"), ("b", "domain", "x.com", 6, "add"), ("b", "domain", "x.com", 6, "add"),
           ("c", "prefix", "y.org/p/q", 0, "add"), ("d", "host", "z.net", 3, "add"), ("d", "host", "z.net", 3, "remove"), (None, "host", "x.com", 1, "add"),
           ("e", "domain", "com", 9, "add")]
    cap = [(1, "http://x.com/a", 4, "k"), (2, "http://u:p@X.COM.:80", 5, "k"), (3, "https://x.com?q", 7, "k"), (4, "http://x.com", 8, "k"),
           (5, "http://s.x.com/", 7, "k"), (6, "http://notx.com/", 7, "k"), (7, "http://y.org/p/q/r?x#y", 0, "k"), (8, "http://y.org/p/qq", 0, "k"),
           (9, "http://z.net", 3, "k"), (10, None, 3, "k"), (11, "no url", 3, "k"), (12, "http://x.com", None, "k"), (3, "https://x.com?q", 7, "k"),
           (None, "http://x.com", 9, None)]
    c, e = spark.createDataFrame(cap, CAP), spark.createDataFrame(ent, ENT)
    got = sorted(((r.page_id or 0, r.lists) for r in url_verdicts(c, e).collect()))
    assert got == [(0, "b,e"), (1, ""), (2, "a"), (3, "a,b"), (3, "a,b"), (4, "b"), (5, "b"), (6, ""), (7, "c"), (8, ""), (9, ""), (10, ""), (11, ""), (12, "")]
    assert url_verdicts(c, e.limit(0)).where("blocked").count() == 0 and url_verdicts(c, e.limit(0)).count() == len(cap)
    assert url_verdicts(c.limit(0), e).count() == 0


def test_hosts_in_any_spelling(spark):
    ent = [("a", "prefix", "Example.com/Path/", 0, "add"), ("b", "host", "[2001:DB8::2]", 0, "add"), ("c", "domain", ".Example.org", 0, "add"), ("d", "host", "x.com/", 0, "add")]
    cap = [(1, "http://EXAMPLE.com/Path/x", 1, "k"), (2, "http://example.com/path", 1, "k"), (3, "http://u@[2001:db8::2]:80/", 1, "k"), (4, "http://[2001:db8::3]/", 1, "k"),
           (5, "http://a.example.org", 1, "k"), (6, "http://example.org.", 1, "k"), (7, "http://x.com", 1, "k"), (8, "http://x.com/" + "s/" * 300, 1, "k")]
    c, e = spark.createDataFrame(cap, CAP), spark.createDataFrame(ent, ENT)
    assert sorted((r.page_id, r.lists) for r in url_verdicts(c, e).collect()) == [(1, "a"), (2, ""), (3, "b"), (4, ""), (5, "c"), (6, "c"), (7, "d"), (8, "d")]
