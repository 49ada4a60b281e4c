"""CSV ingest: NULL tokens, integer repair, ragged rows, BOM, quoted newlines,
reconciliation, resume and dry run."""

import os

import pytest

from shelfwise.sources.ingest import IngestError, load_all, load_predictions, persist_mart, read_table
from shelfwise.streaming.extract import extract

REGIONS = ("﻿region_id,region_code,region_name,country_code,is_active\n"
           "1,NE,Northeast,US,true\n"
           "2.0,SE,\"South\neast\",US,false\n"
           "3,MW,NaN,US\n"
           "4,SW,Southwest,US,true,extra\n"
           "5, ,N/A,<NA>,None\n")


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_read_table_repairs(spark, tmpdir_path):
    p = _write(tmpdir_path, "regions.csv", REGIONS)
    df = read_table(spark, p, "regions", multiline=True).data
    rows = {r.region_id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[2].region_name == "South\neast"          # quoted newline = one record
    assert rows[3].region_name is None and rows[3].is_active is None   # NaN token, short row padded
    assert rows[4].is_active is True                       # long row cut
    assert rows[5].region_code is None and rows[5].country_code is None and rows[5].is_active is None


def test_non_integral_is_rejected(spark, tmpdir_path):
    p = _write(tmpdir_path, "regions.csv", "region_id,region_code\n1.5,X\n7,Y\n")
    with pytest.raises(Exception):
        read_table(spark, p, "regions").data.collect()
    res = read_table(spark, p, "regions", permissive=True)
    assert [r.region_id for r in res.data.collect()] == [7]
    assert res.rejects.first()["_reject_columns"] == "region_id"


def test_unknown_header_rejected(spark, tmpdir_path):
    p = _write(tmpdir_path, "regions.csv", "region_id,bogus\n1,x\n")
    with pytest.raises(IngestError):
        read_table(spark, p, "regions")


def test_load_all_reconciles_and_resumes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    out = os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    _write(src, "regions.csv", REGIONS)
    _write(src, "channels.csv", "channel_id,channel_code,channel_name,channel_group,is_active\n1,IN,In,Physical,t\n")
    rep = {r.table: r for r in load_all(spark, src, out, tables=["regions", "channels", "stores"],
                                        multiline=True).collect()}
    assert rep["regions"].status == "loaded" and rep["regions"].csv_rows == 5 == rep["regions"].db_rows
    assert rep["stores"].status == "missing"
    rep2 = {r.table: r.status for r in load_all(spark, src, out, tables=["regions", "channels"], resume=True,
                                                multiline=True).collect()}
    assert rep2 == {"regions": "skipped", "channels": "skipped"}
    dry = load_all(spark, src, os.path.join(tmpdir_path, "dry"), tables=["channels"], dry_run=True).first()
    assert dry.status == "dry_run" and dry.csv_rows == 1
    with pytest.raises(IngestError):
        load_all(spark, src, out, tables=["stores"], fail_on_missing=True)


def test_predictions_and_persist(spark, tmpdir_path):
    _write(tmpdir_path, "sales_forecast_predictions.csv",
           "ds,y_true,sarimax,forecast_horizon,yhat,model_used\n2024-01-01,10,11.5,,,\n2024-02-01,,,h1,9.5,xgb\n")
    staged = load_predictions(spark, tmpdir_path)
    assert staged["stg_churn_predictions"].count() == 0
    fc = staged["stg_sales_forecast_predictions"].orderBy("ds").collect()
    assert float(fc[0].sarimax) == 11.5 and fc[1].model_used == "xgb"
    path = os.path.join(tmpdir_path, "mart")
    back = persist_mart(staged["stg_sales_forecast_predictions"], path, ["ds"])
    assert back.count() == 2


def test_bounded_extract(spark):
    df = spark.range(1234)
    batches = list(extract(df, max_rows=1000, batch_size=300))
    assert [len(b) for b in batches] == [300, 300, 300, 100]


def test_round_trip_csv_to_catalog(spark, tmpdir_path):
    """Bound tables -> CSV -> load_all -> Parquet catalog -> same query result."""
    from shelfwise.plans import business
    from shelfwise.sources.catalog import Catalog
    src = Catalog.from_tpch(spark, "/root/testdata/sf0.001")
    csv_dir, lake = os.path.join(tmpdir_path, "csv"), os.path.join(tmpdir_path, "lake")
    for t in ("orders", "order_items", "calendar_date"):
        src[t].write.option("header", True).csv(os.path.join(csv_dir, f"{t}.csv"))
    rep = {r.table: r.status for r in load_all(spark, csv_dir, lake, tables=["orders", "order_items",
                                                                             "calendar_date"]).collect()}
    assert set(rep.values()) == {"loaded"}, rep
    lake_cat = Catalog.from_parquet_dir(spark, lake)
    assert sorted(map(tuple, business.q01(lake_cat).collect())) == sorted(map(tuple, business.q01(src).collect()))


def test_extract_restarts_and_tells_a_cut(spark):
    df = spark.createDataFrame([(i // 3 if i > 4 else None, str(i)) for i in range(100)], "k int, v string").repartition(5)
    whole = list(extract(df, batch_size=10, key=["k"]))
    assert sorted(r["v"] for b in whole for r in b) == sorted(map(str, range(100))) and not any(b.cut for b in whole)
    assert all(a.token != b[0]["k"] for a, b in zip(whole, whole[1:]))
    again = list(extract(df, batch_size=10, key=["k"], after=whole[2].token))
    assert [r["k"] for b in whole[3:] for r in b] == [r["k"] for b in again for r in b]
    first = list(extract(df, max_rows=50, key=["k"]))
    rest = list(extract(df, key=["k"], after=first[-1].token))
    assert first[-1].cut and sorted(r["v"] for b in first + rest for r in b) == sorted(map(str, range(100)))
    assert len(list(extract(df))[0]) == 100 and not list(extract(df.limit(0), key=["k"]))
    two = list(extract(df, batch_size=7, key=["k", "v"]))
    assert [r["v"] for b in extract(df, key=["k", "v"], after=two[0].token) for r in b] == [r["v"] for b in two[1:] for r in b]


def _rep(df):
    return {r.table: r for r in df.collect()}


def test_a_failed_check_leaves_the_old_version(spark, tmpdir_path, monkeypatch):
    from shelfwise.sources import ingest
    from shelfwise.sources.catalog import Catalog
    src, out = os.path.join(tmpdir_path, "csv"), os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    _write(src, "channels.csv", "channel_id,channel_code\n1,IN\n2,WEB\n")
    assert _rep(load_all(spark, src, out, tables=["channels"]))["channels"].status == "loaded"
    _write(src, "channels.csv", "channel_id,channel_code\n1,IN\nx,WEB\n")  # a bad value
    assert _rep(load_all(spark, src, out, tables=["channels"], continue_on_error=True))["channels"].status == "failed"
    _write(src, "channels.csv", "channel_id,channel_code\n7,A\n8,B\n")
    counted = ingest.source_content
    monkeypatch.setattr(ingest, "source_content", lambda *a: (counted(*a)[0] + 1, "other"))
    got = _rep(load_all(spark, src, out, tables=["channels"], continue_on_error=True))["channels"]
    assert got.status == "count_mismatch" and "not published" in got.error
    with pytest.raises(IngestError):
        load_all(spark, src, out, tables=["channels"])
    assert sorted(r.channel_id for r in Catalog.from_parquet_dir(spark, out)["channels"].collect()) == [1, 2]
    monkeypatch.undo()
    load_all(spark, src, out, tables=["channels"], resume=True)
    assert sorted(r.channel_id for r in Catalog.from_parquet_dir(spark, out)["channels"].collect()) == [7, 8]


def test_resume_goes_by_content(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "csv"), os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    p = _write(src, "channels.csv", "channel_id,channel_code\n1,IN\n")
    status = lambda: _rep(load_all(spark, src, out, tables=["channels"], resume=True))["channels"].status
    assert status() == "loaded" and status() == "skipped"
    os.utime(p, (1, 1))
    assert status() == "skipped"  # another time, the same content
    _write(src, "channels.csv", "channel_id,channel_code\n1,UP\n")
    assert status() == "loaded" and status() == "skipped"  # the same size, other content


def test_rejects_are_counted_by_file(spark, tmpdir_path):
    from shelfwise.sources.ingest import rejects_by_file
    src, out = os.path.join(tmpdir_path, "csv", "channels.csv"), os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    _write(src, "a.csv", "channel_id,channel_code\n1,IN,more\n2,X\nbad,Y\n\n")
    _write(src, "b.csv", "channel_code,channel_id\nZ,3\nW\n\"a,b\",4,,\n")  # other order, a short row, a long one
    got = _rep(load_all(spark, os.path.dirname(src), out, tables=["channels"], permissive=True))["channels"]
    assert (got.status, got.csv_rows, got.db_rows, got.rejected_rows, got.cut_rows) == ("loaded", 6, 5, 1, 2)
    by_file = {(os.path.basename(r.file), r.reason): r.records for r in rejects_by_file(spark, out, "channels").collect()}
    assert by_file == {("a.csv", "cut"): 1, ("a.csv", "cast"): 1, ("b.csv", "cut"): 1}
    _write(src, "c.csv", "channel_id,colour\n1,red\n")
    with pytest.raises(IngestError, match="colour"):
        read_table(spark, src, "channels")


def test_paths_that_only_spark_reads(spark, tmpdir_path):
    from shelfwise.sources.catalog import Catalog
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lake.link./data", f"file://{tmpdir_path}")
    _write(tmpdir_path, "channels.csv", "channel_id,channel_code\n1,IN\n")
    assert _rep(load_all(spark, "viewfs://lake/data", "viewfs://lake/data/out", tables=["channels"]))["channels"].status == "loaded"
    assert Catalog.from_parquet_dir(spark, "viewfs://lake/data/out")["channels"].count() == 1
    with pytest.raises(FileNotFoundError):
        Catalog.from_parquet_dir(spark, "viewfs://lake/data/nowhere")
