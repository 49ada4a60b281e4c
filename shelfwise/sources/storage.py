"""Files through the Hadoop file system: any path that Spark's readers can open.

Published versions: a table folder holds version folders and ``_published``, a
folder of small numbered files, each with a version's name. The highest number is
the current one; a number is only ever created, so readers see the old version or
the new one, on stores without an atomic rename too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

PUBLISHED = "_published"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []


def listing(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of what lies in a folder."""
    p, fs = _at(spark, folder)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))) if fs.exists(p) else ()


def files(spark: SparkSession, path: str) -> list[File]:
    """The file, or the data files of a folder (hidden ones aside)."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    found = fs.listStatus(p)
    return sorted((File(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found
                   if s.isFile() and (len(found) == 1 or s.getPath().getName()[0] not in "._")), key=lambda f: f.path)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, also of a compressed one."""
    p, fs = _at(spark, path)
    jvm = spark._jvm
    stream = fs.open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an existing one is never overwritten."""
    p, fs = _at(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of the newest complete file of a folder of numbered ones."""
    for name in reversed([n for n in names(spark, folder) if n.isdigit()]):
        text = read_text(spark, join(folder, name))
        if text.endswith("\n"):  # a file that is still being written has no end
            return int(name), text[:-1]
    return 0, None


def add_numbered(spark: SparkSession, folder: str, text: str) -> None:
    last = max([int(n) for n in names(spark, folder) if n.isdigit()], default=0)
    create_text(spark, join(folder, f"{last + 1:012d}"), text + "\n")


def publish(spark: SparkSession, table_dir: str, version: str, keep: int = 2) -> None:
    """Makes a version current and removes the oldest ones, but for ``keep``."""
    add_numbered(spark, join(table_dir, PUBLISHED), version)
    told = [n for n in names(spark, join(table_dir, PUBLISHED)) if n.isdigit()]
    held = {read_text(spark, join(table_dir, PUBLISHED, n)).strip() for n in told[-keep:]}
    for n in told[:-keep]:
        old = read_text(spark, join(table_dir, PUBLISHED, n)).strip()
        if old and old not in held:
            delete(spark, join(table_dir, old))
        delete(spark, join(table_dir, PUBLISHED, n))


def current(spark: SparkSession, table_dir: str) -> str | None:
    """Path of a table's published version, if it has one."""
    _, version = latest(spark, join(table_dir, PUBLISHED))
    return join(table_dir, version) if version else None
