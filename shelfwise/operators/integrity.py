"""Integrity operators C1-C8: the relational constraints as batch checks.

The rules are data (``operators.constraints``). They are compiled into few plans:

* NOT NULL, value lists, ranges and row conditions of a table are conditional sums
  of one aggregate, so the table is read once however many rules it has.
* The keys of a table are packed by the tasks that read it and compared where packs meet
  (``operators.packed_keys``; SQL UNIQUE lets NULL keys repeat); the same pass counts its row rules.
  Keys of types that cannot be packed are grouped in their own types.
* A reference is grouped by its columns with the count of its rows, then anti-joined with
  the referenced key. Nothing turns into text before the shuffle, a table that is
  already dealt by such a column is not dealt again, and references to one key share
  its shuffle.

``check_summary`` has a row for every rule, with status ``not_checked`` where the catalog
lacks its table or column. ``check`` gives the violating rows themselves, distributed.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators import packed_keys as PK
from shelfwise.operators.constraints import EDGES, RULES, Rule
from shelfwise.sources.catalog import TABLE_ORDER, Catalog

BY_ROW = ("not_null", "domain", "range", "row")
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def applies(cat: Catalog, r: Rule) -> bool:
    """The catalog has what the rule reads."""
    return (r.table in cat and set(r.columns) <= set(cat[r.table].columns)
            and (r.ref_table is None or (r.ref_table in cat and set(r.ref_columns) <= set(cat[r.ref_table].columns))))


def breaks(r: Rule) -> Column:
    """Whether a row violates a rule of its own (never NULL)."""
    if r.kind == "not_null":
        return F.col(r.columns[0]).isNull()
    if r.kind == "domain":
        sound = F.col(r.columns[0]).isin(*r.values)
    elif r.kind == "range":
        c = F.col(r.columns[0])
        sound = reduce(Column.__and__, ([c >= F.lit(r.low)] if r.low is not None else []) + ([c <= F.lit(r.high)] if r.high is not None else []))
    else:
        sound = F.expr(r.condition)
    return ~F.coalesce(sound, F.lit(True))


def _by_table(rules: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(r.table, []).append(r)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_counts(cat: Catalog, rules: list[Rule]) -> list[DataFrame]:
    out = []
    for table, some in _by_table(rules).items():
        sums = cat[table].agg(*(F.coalesce(F.sum(breaks(r).cast("long")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(some)))
        out.append(sums.select(F.inline(F.array(*(F.struct(F.lit(r.rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(some))))))
    return out


def _keyed(df: DataFrame, columns: Iterable[str], types: Iterable[str | None]) -> DataFrame:
    """The key alone, its parts as k0, k1, ... in the given types (None: their own)."""
    return df.select(*((F.col(c).cast(t) if t else F.col(c)).alias(f"k{i}") for i, (c, t) in enumerate(zip(columns, types))))


def _whole(keys: DataFrame) -> DataFrame:
    return keys.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys.columns)))


def _counted(keys: DataFrame) -> DataFrame:
    """Keys with the number of their rows (0 for NULL)."""
    return keys.groupBy(*keys.columns).agg(F.count("k0").alias("n"))


def _told(found: DataFrame, r: Rule) -> DataFrame:
    """rule, value and n of the keys found."""
    return found.select(F.lit(r.rule).alias("rule"), PK.text(c for c in found.columns if c != "n").alias("value"), "n")


def _can_pack(cat: Catalog, r: Rule) -> bool:
    return PK.forms(cat[r.table], r.columns) is not None


def _rule_at(rules: list[Rule]) -> Column:
    return F.array(*(F.lit(r.rule) for r in rules))[F.col("no")]


def duplicates(cat: Catalog, rules: list[Rule]) -> DataFrame:
    """rule, value and n of the keys that stand more than once."""
    keys, parts = [r for r in rules if _can_pack(cat, r)], []
    for table, some in _by_table(keys).items():
        found = PK.repeated(cat[table], [r.columns for r in some], [])
        parts.append(found.select(_rule_at(some).alias("rule"), F.col("key").cast("string").alias("value"), "n"))
    for r in rules:
        if r not in keys:  # by a type whose equality is Spark's to tell
            keyed = _whole(_keyed(cat[r.table], r.columns, [None] * len(r.columns)))
            parts.append(_told(_counted(keyed).where("n > 1"), r))
    return _union(parts)


def _common(own: T.DataType, other: T.DataType) -> str | None:
    """The type in which a reference and its key compare as their texts would; None: their own."""
    if own == other:
        return None
    return "long" if isinstance(own, WHOLE) and isinstance(other, WHOLE) else "string"


def orphans(cat: Catalog, rules: list[Rule]) -> DataFrame:
    """rule, value and n (rows that have it) of the references to no row."""
    parts = []
    for r in rules:
        df, ref = cat[r.table], cat[r.ref_table]
        types = [_common(df.schema[c].dataType, ref.schema[k].dataType) for c, k in zip(r.columns, r.ref_columns)]
        used, held = _counted(_whole(_keyed(df, r.columns, types))), _keyed(ref, r.ref_columns, types)
        parts.append(_told(used.join(held, held.columns, "left_anti"), r))
    return _union(parts)


def check_summary(cat: Catalog, rules: list[Rule] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """rule, table, kind, status and violations (0 when sound, NULL when not checked) of every rule."""
    rules = [r for r in (RULES if rules is None else rules) if not kinds or r.kind in kinds]
    can = [r for r in rules if applies(cat, r)]
    unique, references = ([r for r in can if r.kind == k] for k in ("unique", "foreign_key"))
    keys = [r for r in unique if _can_pack(cat, r)]
    rows, keyed = _by_table([r for r in can if r.kind in BY_ROW]), _by_table(keys)
    counts = _row_counts(cat, [r for t, some in rows.items() if t not in keyed for r in some])
    packs = []
    for table, some in keyed.items():  # the pass over its keys tells a table's row rules as well
        beside = rows.get(table, [])
        found = PK.repeated(cat[table], [r.columns for r in some], [breaks(r) for r in beside], told=False)
        packs.append(found.select(_rule_at(some + beside).alias("rule"), "n"))
    if packs:
        counts.append(_union(packs).groupBy("rule").agg(F.sum("n").alias("violations")))
    if len(keys) < len(unique):
        others = duplicates(cat, [r for r in unique if r not in keys])
        counts.append(others.groupBy("rule").agg(F.count(F.lit(1)).alias("violations")))
    if references:
        counts.append(orphans(cat, references).groupBy("rule").agg(F.sum("n").alias("violations")))
    checked = {r.rule for r in can}
    listed = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in (("rule", r.rule), ("table", r.table), ("kind", r.kind),
                                                                  ("status", "checked" if r.rule in checked else "not_checked")))) for r in rules))
    every = cat.spark.range(1).select(F.inline(listed))  # a fixed list
    if not counts:
        return every.withColumn("violations", F.lit(None).cast("long"))
    found = _union(counts)
    return every.join(found, "rule", "left").select(
        "rule", "table", "kind", "status", F.when(F.col("status") == "checked", F.coalesce("violations", F.lit(0))).alias("violations"))


def check(cat: Catalog, rules: list[Rule] | None = None) -> DataFrame:
    """rule, table, key and detail of every violation of the rules that apply: rows of a table are read once for its row rules."""
    can = [r for r in (RULES if rules is None else rules) if applies(cat, r)]
    parts = []

    def told(r: Rule) -> str:
        return {"not_null": f"NULL in {r.columns[0]}", "domain": f"{r.columns[0]} not in its list", "range": f"{r.columns[0]} outside its range",
                "row": r.condition}[r.kind]
    for table, some in _by_table([r for r in can if r.kind in BY_ROW]).items():
        df = cat[table]
        have = [c for c in some[0].key if c in df.columns] or df.columns[:1]
        key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in have))
        found = F.filter(F.array(*(F.when(breaks(r), F.struct(F.lit(r.rule).alias("rule"), F.lit(told(r)).alias("detail"))) for r in some)), lambda x: x.isNotNull())
        parts.append(df.select(F.lit(table).alias("table"), key.alias("key"), F.inline(found)).select("rule", "table", "key", "detail"))
    for kind, find, what in (("unique", duplicates, "duplicate key x"), ("foreign_key", orphans, "no such row, rows that refer to it: ")):
        some = [r for r in can if r.kind == kind]
        if some:
            tables = F.create_map(*(F.lit(x) for r in some for x in (r.rule, r.table)))
            parts.append(find(cat, some).select("rule", tables[F.col("rule")].alias("table"), F.col("value").alias("key"),
                                                F.concat(F.lit(what), F.col("n").cast("string")).alias("detail")))
    if not parts:
        return cat.spark.createDataFrame([], "rule string, table string, key string, detail string")
    return _union(parts)


def summary(violations_df: DataFrame) -> DataFrame:
    return violations_df.groupBy("rule", "table").agg(F.count(F.lit(1)).alias("violations"))


def load_order(edges: list[tuple[str, str]] | None = None) -> list[str]:
    """Every table, parents before children, over all references (a table's reference to itself aside).

    Tables without an order between them come in ``TABLE_ORDER``; a cycle raises with its tables.
    """
    edges = [(c, p) for c, p in (EDGES if edges is None else edges) if c != p]
    waits: dict[str, set[str]] = {t: set() for t in TABLE_ORDER}
    for child, parent in edges:
        waits.setdefault(parent, set())
        waits.setdefault(child, set()).add(parent)
    order: list[str] = []
    while waits:
        free = [t for t, parents in waits.items() if not parents & waits.keys()]
        if not free:
            raise ValueError("references in a cycle among " + ", ".join(sorted(waits)))
        order += free
        for t in free:
            del waits[t]
    return order
