"""CSV ingest (S1-S5, S8) and mart persistence.

Reading is a parallel CSV scan with an all-string schema built from the
files' own headers (of every file of a folder); NULL tokens and integer-looking
floats are repaired with column expressions, then every column is cast to the model
type. In strict mode the cast is ANSI (a bad value fails the load loudly, as COPY
would); ``permissive=True`` keeps such rows aside. Fields beyond the header are cut,
and the rows that lose some are told: both kinds reach the reject frame with their
file, record and reason.

``load_all`` writes each table to a new version folder, holds the records counted in
the source's text (without the CSV parser) against the rows written and rejected, and
only then publishes the version: a failed load or check leaves the old one. ``resume``
skips a table whose files have the content of the last load (size and time, or
else a checksum of their lines). The per-table loop runs on the driver; all row
work runs in Spark, and all paths go through the Hadoop file system.
"""

from __future__ import annotations

import csv
import io
import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources import storage
from shelfwise.sources.schemas import DDL, STAGING_DDL, schema

# Text tokens read as NULL (after trimming).
NULL_TOKENS = ("", "nan", "NaN", "NAN", "<NA>", "None", "none", "NULL", "null", "NaT", "#N/A", "n/a", "N/A")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class IngestError(ValueError):
    pass


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """First line of the file, parsed as CSV, names stripped, BOM removed."""
    first = storage.first_line(spark, path)
    if first is None:
        raise IngestError(f"CSV has no header: {path}")
    names = [n.strip() for n in next(csv.reader(io.StringIO(first)), [])]
    if names:
        names[0] = names[0].lstrip("\ufeff").strip()
    return names


def check_header(header: list[str], target: T.StructType, table: str) -> None:
    known = set(target.fieldNames())
    unknown = [c for c in header if c not in known]
    if unknown:
        raise IngestError(f"CSV columns not found on {table}: {', '.join(unknown)}")
    if len(set(header)) != len(header):
        raise IngestError(f"duplicate CSV columns for {table}")


def null_token(c: Column) -> Column:
    return F.trim(c).isin(*NULL_TOKENS) | c.isNull()


def normalize_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL tokens and blanks -> NULL on every (string) column."""
    cols = columns or df.columns
    return df.select(*[F.when(null_token(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def repair_integer(c: Column) -> Column:
    """S3: ``"1.0"`` -> ``"1"``; NaN -> NULL; other text unchanged so a later
    strict cast still fails on non-integral values like ``"1.5"``."""
    s = F.trim(c)
    as_double = s.try_cast("double")
    plain = s.rlike(r"^-?\d+$")
    zero_frac = s.rlike(r"^-?\d+\.0*$")
    integral_float = as_double.isNotNull() & (as_double == F.floor(as_double)) & ~F.isnan(as_double)
    return (F.when(c.isNull(), F.lit(None))
            .when(plain, s)
            .when(zero_frac, F.regexp_extract(s, r"^(-?\d+)", 1))
            .when(F.lower(s) == "nan", F.lit(None))
            .when(integral_float, as_double.cast("long").cast("string"))
            .otherwise(s))


@dataclass
class ReadResult:
    """``rejects`` has _file, _record, _reason (cut: kept without its surplus fields; cast: not kept) and _reject_columns."""

    data: DataFrame
    rejects: DataFrame


QUOTED = r'"(?:[^"]|"")*"'


def _read_files(spark: SparkSession, files: list[str], header: list[str], target: T.StructType, permissive: bool, multiline: bool):
    text = [T.StructField(c, T.StringType()) for c in header]
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multiline)
           .option("enforceSchema", True).option("escape", '"').option("columnNameOfCorruptRecord", "_record")
           .schema(T.StructType([*text, T.StructField("_record", T.StringType())])).csv(files))
    df = normalize_nulls(raw.withColumn("_file", F.col("_metadata.file_path")), header)
    types = {f.name: f.dataType for f in target.fields}
    fixed = {c: (repair_integer(F.col(c)) if isinstance(types[c], INTEGRAL) else F.col(c)) for c in header}
    tried = {c: fixed[c].try_cast(types[c]) for c in header}
    bad = F.concat_ws(",", *(F.when(fixed[c].isNotNull() & tried[c].isNull(), F.lit(c)) for c in header))
    fields = F.size(F.split(F.regexp_replace("_record", QUOTED, "q"), ",", -1))
    made = tried if permissive else {c: fixed[c].cast(types[c]) for c in header}
    cols = [(made[f.name] if f.name in made else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]
    # a record of the wrong length is told by the parser, one of a failing cast by its values
    record = F.coalesce("_record", F.to_csv(F.struct(*header)))
    why = F.when(bad != "", "cast").when(F.col("_record").isNotNull() & (fields > len(header)), "cut")
    rejects = df.select("_file", record.alias("_record"), why.alias("_reason"), bad.alias("_reject_columns")).where("_reason is not null")
    return (df.where(bad == "") if permissive else df).select(*cols), rejects


def read_table(spark: SparkSession, path: str, table: str, target: T.StructType | None = None,
               permissive: bool = False, multiline: bool = False) -> ReadResult:
    """Typed read of one CSV (file or folder) into ``table``'s schema; files of one folder may order their columns differently."""
    target = target or schema(table)
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in storage.files(spark, path):
        header = csv_header(spark, f.path)
        check_header(header, target, table)
        groups.setdefault(tuple(header), []).append(f.path)
    if not groups:
        raise IngestError(f"no CSV file: {path}")
    parts = [_read_files(spark, some, list(header), target, permissive, multiline) for header, some in groups.items()]
    return ReadResult(*(reduce(DataFrame.unionByName, frames) for frames in zip(*parts)))


def source_content(spark: SparkSession, files: list[str], multiline: bool = False) -> tuple[int, str]:
    """Records and a checksum of the files' text, without the CSV parser: blank lines and headers aside, quoted line ends inside a record."""
    lines = spark.read.text(files, wholetext=multiline)
    unquoted = F.regexp_replace("value", QUOTED, "q") if multiline else F.col("value")
    records = F.size(F.filter(F.split(unquoted, "\r\n|\r|\n"), lambda x: x != "")) if multiline else F.when(F.col("value") != "", 1).otherwise(0)
    got = lines.agg(F.sum(records.cast("long")), F.count("*"), F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("value", F.lit(1)))).first()
    return (got[0] or 0) - len(files), f"{got[1]}:{got[2]}:{got[3]}"


REPORT_SCHEMA = ("table string, status string, csv_rows bigint, db_rows bigint, seconds double, error string, "
                 "source_bytes bigint, rejected_rows bigint, cut_rows bigint, content string")
_REPORT = [f.split(" ")[0] for f in REPORT_SCHEMA.split(", ")]


def _manifest(spark: SparkSession, out_dir: str) -> dict[str, dict]:
    _, text = storage.latest(spark, storage.join(out_dir, "_manifest"))
    return json.loads(text) if text else {}


def load_all(spark: SparkSession, csv_dir: str, out_dir: str, tables: list[str] | None = None,
             resume: bool = False, dry_run: bool = False, fail_on_missing: bool = False,
             continue_on_error: bool = False, multiline: bool = False, permissive: bool = False) -> DataFrame:
    """Load every table's CSV into Parquet, parents first, with a
    row-count reconciliation and a per-table status report.

    Rejected and cut records are written to ``_rejects`` beside the table's versions.
    """
    from shelfwise.operators.integrity import load_order
    wanted = [t for t in load_order() if t in DDL and (tables is None or t in tables)]
    manifest = _manifest(spark, out_dir)
    report: list[dict] = []
    for table in wanted:
        began, row = time.time(), dict.fromkeys(_REPORT) | {"table": table}
        report.append(row)
        source, home = storage.join(csv_dir, f"{table}.csv"), storage.join(out_dir, table)
        files = storage.files(spark, source)
        if not files:
            if fail_on_missing:
                raise IngestError(f"missing CSV for {table}: {source}")
            row |= {"status": "missing", "seconds": 0.0}
            continue
        paths, listed = [f.path for f in files], [[f.path, f.size, f.modified] for f in files]
        row["source_bytes"] = sum(f.size for f in files)
        before = manifest.get(table, {})
        try:
            loaded = resume and before.get("status") == "loaded" and storage.current(spark, home) is not None
            if loaded and before.get("listed") == listed:
                row |= {k: before[k] for k in ("csv_rows", "db_rows", "content")} | {"status": "skipped", "seconds": 0.0}
                continue
            records, row["content"] = source_content(spark, paths, multiline)
            row["csv_rows"] = records
            if loaded and before.get("content") == row["content"]:
                row |= {"status": "skipped", "db_rows": before["db_rows"], "seconds": time.time() - began}
                manifest[table] |= {"listed": listed}
                continue
            read = read_table(spark, source, table, multiline=multiline, permissive=permissive)
            if dry_run:
                row |= {"status": "dry_run", "seconds": time.time() - began}
                continue
            version = f"v-{uuid.uuid4().hex}"
            target, aside = storage.join(home, version), storage.join(home, "_rejects", version)
            read.data.write.mode("error").parquet(target)
            read.rejects.write.mode("error").parquet(aside)
            kept = spark.read.schema(REJECTS).parquet(aside).groupBy("_reason").count().collect()
            told = {r["_reason"]: r["count"] for r in kept}
            row |= {"db_rows": spark.read.schema(schema(table)).parquet(target).count(), "cut_rows": told.get("cut", 0),
                    "rejected_rows": told.get("cast", 0)}
            if row["db_rows"] + row["rejected_rows"] != records:
                row["status"] = "count_mismatch"
                raise IngestError(f"{table}: {records} records in the source, {row['db_rows']} rows written and {row['rejected_rows']} rejected; not published")
            storage.publish(spark, home, version)
            row |= {"status": "loaded", "seconds": time.time() - began}
            manifest[table] = row | {"listed": listed}
        except Exception as e:  # noqa: BLE001 - recorded in the report
            row |= {"status": row["status"] or "failed", "error": str(e), "seconds": time.time() - began}
            if not continue_on_error:
                raise
        finally:
            if not dry_run and row["status"] in ("loaded", "failed", "count_mismatch"):
                manifest.setdefault(table, {})["last"] = {k: row[k] for k in ("status", "error")}
                storage.add_numbered(spark, storage.join(out_dir, "_manifest"), json.dumps(manifest))
    return spark.createDataFrame([tuple(r[c] for c in _REPORT) for r in report], REPORT_SCHEMA)


REJECTS = "_file string, _record string, _reason string, _reject_columns string"


def rejects_by_file(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """file, reason and records of a table's published load."""
    home = storage.join(out_dir, table)
    version = storage.latest(spark, storage.join(home, storage.PUBLISHED))[1]
    return (spark.read.schema(REJECTS).parquet(storage.join(home, "_rejects", version))
            .groupBy(F.col("_file").alias("file"), F.col("_reason").alias("reason")).agg(F.count("*").alias("records")))


# ---------------------------------------------------------------- S8
PREDICTION_FILES = {"stg_churn_predictions": "churn_predictions.csv",
                    "stg_profit_predictions": "profit_predictions.csv",
                    "stg_sales_forecast_predictions": "sales_forecast_predictions.csv"}


def load_predictions(spark: SparkSession, pred_dir: str, loaded_at=None, fail_on_missing: bool = False) -> dict[str, DataFrame]:
    """The three model-output CSVs as staging frames with ``loaded_at``.
    A missing file gives an empty frame (the union view then has no rows of
    that kind) and a warning; with ``fail_on_missing`` it raises."""
    import datetime as dt
    import warnings
    loaded_at = loaded_at or dt.datetime.now().replace(microsecond=0)
    out = {}
    for table, fname in PREDICTION_FILES.items():
        target = schema(table)
        path = storage.join(pred_dir, fname)
        if storage.exists(spark, path):
            df = read_table(spark, path, table, target).data
        elif fail_on_missing:
            raise IngestError(f"missing prediction file: {path}")
        else:
            warnings.warn(f"no prediction file {path}: {table} is empty", stacklevel=2)
            df = spark.createDataFrame([], target)
        stamp = loaded_at.isoformat(sep=" ") if hasattr(loaded_at, "isoformat") else str(loaded_at)
        out[table] = df.withColumn("loaded_at", F.lit(stamp).cast("timestamp_ntz"))
    return out


# ---------------------------------------------------------------- S6
def persist_mart(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise a mart as Parquet (optionally partitioned, e.g. by month)
    and return a DataFrame reading it back (lineage cut, partition pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


__all__ = ["NULL_TOKENS", "IngestError", "read_table", "load_all", "load_predictions", "rejects_by_file", "persist_mart",
           "normalize_nulls", "repair_integer", "csv_header", "STAGING_DDL"]
