"""URL filters as an as-of join with dated lists (DataFrame functions only).

List entries are dated events (list, kind, pattern, day, action). Per list and
pattern each ``add`` is valid until the next event of that pattern: validity intervals
[day, next day). A capture is matched by the keys its URL can be listed under and
is held against the intervals that hold its fetch time.

Kinds: ``host`` (that host), ``domain`` (that host and all below it; a first dot does
not count), ``prefix`` (host and leading path segments). Hosts are compared in lower
case without user, port and final dot, in patterns of all kinds; paths as they are. An
IPv6 host is the address in its brackets. ``remove`` wins over ``add`` on one day.

A hot host or domain may be a key of a large part of all captures, so both sides
carry a salt: captures by their own hash, intervals once per salt. Verdicts are
made once per distinct (id, url, fetch time) and repeated rows get it each.

A null or hostless URL and a null fetch time match nothing; entries with a null
field are void; extra columns are dropped; an empty list leaves all captures
unblocked, an empty capture table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def keys(url: Column) -> Column:
    """All (kind:pattern) keys a URL can be listed under."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(F.lit("prefix:"), h, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(h != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), h)), domains, F.coalesce(paths, none)))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (null: still valid) of each add."""
    name, path = F.lower(F.regexp_extract("pattern", "^([^/]*)", 1)), F.regexp_replace(F.regexp_extract("pattern", "^[^/]*/(.*)$", 1), "/$", "")
    name = F.regexp_replace(F.when(F.col("kind") == "domain", F.regexp_replace(name, r"^\.", "")).otherwise(name), r"\.$", "")
    key = F.concat_ws(":", "kind", F.when((F.col("kind") == "prefix") & (path != ""), F.concat(name, F.lit("/"), path)).otherwise(name))
    day = (entries.dropna(subset=["list", "kind", "pattern", "day", "action"])
           .groupBy("list", key.alias("key"), "day").agg(F.max("action").alias("action")))  # remove > add
    w = Window.partitionBy("list", "key").orderBy("day")
    return (day.withColumn("valid_to", F.lead("day").over(w)).where(F.col("action") == "add")
            .select("list", "key", F.col("day").alias("valid_from"), "valid_to"))


def url_verdicts(captures: DataFrame, entries: DataFrame, salts: int = 32) -> DataFrame:
    """page_id, url, fetched, n_active (valid entries that match), lists (comma-joined, sorted) and blocked."""
    row = ["page_id", "url", "fetched"]
    once = captures.groupBy(*row).agg(F.count("*").alias("copies"))
    cand = (once.where("url is not null and fetched is not null").select(*row, F.explode(keys(F.col("url"))).alias("key"))
            .withColumn("salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")))
    valid = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = (cand.join(valid, ["key", "salt"])
            .where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
            .groupBy(*row).agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")))
    hits = hits.select(*[F.col(c).alias(f"h_{c}") for c in row], "n_active", "lists")
    same = F.col("page_id").eqNullSafe(F.col("h_page_id")) & (F.col("url") == F.col("h_url")) & (F.col("fetched") == F.col("h_fetched"))
    return (once.join(hits, same, "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*row, F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
                    F.col("n_active").isNotNull().alias("blocked")))


def _entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts, domains and first path segments of the pages."""
    h = host(F.col("url"))
    seg = F.regexp_extract(F.regexp_extract("url", PATH, 1), "^/([^/]+)", 1)
    p = pages.select("page_id", h.alias("host"), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1).alias("domain"),
                     F.when(seg != "", F.concat(h, F.lit("/"), seg)).otherwise(F.lit("")).alias("prefix")).where("host <> ''")

    def dated(kind: str, name: str, every: int, step: int, events: list) -> DataFrame:
        first = p.where(F.col(kind) != "").groupBy(F.col(kind).alias("pattern")).agg(F.min("page_id").alias("m")).where(F.col("m") % every == 0)
        ev = F.array(*[F.struct(((F.col("m") * step) % 360 + d).alias("day"), F.lit(a).alias("action")) for d, a in events])
        return first.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", F.inline(ev))
    return (dated("host", "abuse", 3, 7, [(0, "add"), (45, "remove"), (90, "add")])
            .unionByName(dated("domain", "spam", 2, 11, [(0, "add"), (100, "remove")]))
            .unionByName(dated("prefix", "adult", 5, 1, [(0, "add"), (10, "add"), (30, "remove")])))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    """Pages fetched on day page_id modulo 360, against lists derived from the pages' own hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages.withColumn("fetched", F.col("page_id") % 360), _entries(pages))


ORACLE = {"op2_url_filters": r"""
WITH p AS (
  SELECT page_id, url, page_id % 360 AS fetched,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages),
q AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain,
             CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^/?#]') THEN host || '/' || steps[1] ELSE '' END AS prefix
      FROM p WHERE host <> ''),
f AS (
  SELECT 'abuse' AS list, 'host' AS kind, host AS pattern, min(page_id) AS m, 3 AS every, 7 AS step FROM q GROUP BY host
  UNION ALL SELECT 'spam', 'domain', domain, min(page_id), 2, 11 FROM q WHERE domain <> '' GROUP BY domain
  UNION ALL SELECT 'adult', 'prefix', prefix, min(page_id), 5, 1 FROM q WHERE prefix <> '' GROUP BY prefix),
ev AS (
  SELECT list, kind, pattern, (m * step) % 360 + d AS day, action
  FROM f JOIN (VALUES ('host', 0, 'add'), ('host', 45, 'remove'), ('host', 90, 'add'), ('domain', 0, 'add'), ('domain', 100, 'remove'),
                      ('prefix', 0, 'add'), ('prefix', 10, 'add'), ('prefix', 30, 'remove')) v(k, d, action) ON k = kind
  WHERE m % every = 0),
m AS (
  SELECT p.page_id, p.url, p.fetched, e.list, e.kind, e.pattern, arg_max(e.action, e.day) AS last
  FROM p JOIN ev e ON e.day <= p.fetched AND p.host <> '' AND
    CASE e.kind WHEN 'host' THEN p.host = e.pattern WHEN 'domain' THEN p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)
         ELSE starts_with(p.host || '/' || array_to_string(p.steps, '/') || '/', e.pattern || '/') END
  GROUP BY ALL),
hit AS (SELECT page_id, url, fetched, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m WHERE last = 'add' GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND p.url = hit.url
"""}
QUERIES = {"op2_url_filters": op2_url_filters}
