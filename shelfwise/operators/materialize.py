"""Small materialisation helpers shared by plans.

``hold`` keeps a frame in Spark's block store from its first use on: nothing runs while
a plan is built, the frame is computed once for all parts of a plan that read it, and
a lost block is computed again. ``release`` lets all held frames of a session go.

``freeze`` writes a frame once to a fresh folder under the cluster's
``spark.checkpoint.dir`` and reads it back (a lineage cut in shared storage;
never a machine-local folder, never ``localCheckpoint``).
``attach_scalars`` puts the columns of a 1-row aggregate next to every row
of a frame as scalar subqueries (evaluated once, merged by Catalyst into a
single aggregate, no join at all).
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_HELD: list[DataFrame] = []


def freeze(df: DataFrame) -> DataFrame:
    from shelfwise.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfwise-frozen-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """For rows whose every computation gives the same result (``df`` must not depend on the order rows come in)."""
    _HELD.append(df.persist(StorageLevel.DISK_ONLY))
    return _HELD[-1]


def release(spark: SparkSession) -> None:
    for df in [d for d in _HELD if d.sparkSession is spark]:
        df.unpersist()
        _HELD.remove(df)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``one_row`` must be a global aggregate (exactly one row)."""
    for c in one_row.columns:
        df = df.withColumn(c, one_row.select(c).scalar())
    return df
