"""Run registered queries on Spark and their oracle SQL on DuckDB; report matches.

usage: python tools/check_oracle.py [--sf DIR] [--gen-schemas] [names...]
"""
import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.registry import REGISTRY, present  # noqa: E402
from shelfwise.session import get_session  # noqa: E402
from shelfwise.sources.catalog import Catalog  # noqa: E402
from shelfwise.testing.compare import compare_query, duck_connect  # noqa: E402
from shelfwise.testing.oracle import oracle_sql_map  # noqa: E402

SPARK_TO_SQL = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
                "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--gen-schemas", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session("local[8]", 8)
    con = duck_connect(a.sf)
    sqls = oracle_sql_map()
    names = a.names or sorted(REGISTRY)
    schemas, bad = {}, []
    for n in names:
        t = time.time()
        cat = Catalog.from_tpch(spark, a.sf)
        try:
            df = present(REGISTRY[n](cat))
            if a.gen_schemas:
                schemas[n] = [(f.name, SPARK_TO_SQL[f.dataType.simpleString()]) for f in df.schema.fields]
            if n not in sqls:
                print(f"{n}: NO ORACLE rows={df.count()}", flush=True)
                continue
            r = compare_query(df, sqls[n], con)
        except Exception as e:  # noqa: BLE001
            r = {"error": str(e)[:600]}
        ok = r.get("values_match") and r.get("columns_match") and r.get("rows_match")
        if not ok:
            bad.append(n)
        print(f"{n}: {'OK' if ok else r} ({time.time() - t:.1f}s)", flush=True)
    if a.gen_schemas:
        path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                            "shelfwise", "testing", "oracle_schemas.py")
        existing = {}
        try:
            from shelfwise.testing.oracle_schemas import SCHEMAS as existing  # noqa: N811
        except ImportError:
            pass
        merged = dict(existing)
        merged.update(schemas)
        with open(path, "w") as fh:
            fh.write('"""Output column types per query (the output convention of ``registry.present``)."""\n\n')
            fh.write("SCHEMAS = {\n")
            for k in sorted(merged):
                fh.write(f"    {k!r}: {json.dumps(merged[k]).replace('[[', '[(').replace(']]', ')]').replace('], [', '), (')},\n")
            fh.write("}\n")
    print("MISMATCH:", bad)


if __name__ == "__main__":
    main()
