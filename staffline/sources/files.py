"""Small driver-side file operations on whatever storage a path names (Hadoop file systems).

For metadata only: one-line files, listings of one folder, removal of folders. Tables are written and read
by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder. Hidden files (dot) are left out."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith("."))


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file with its whole text at once (under a hidden name first); False if it is there."""
    fs, p = _at(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.exists(p) and fs.rename(hidden, p):
        return True
    fs.delete(hidden, False)
    return False


def text_of(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.delete(p, True)


def stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time in ms) of every file under a path."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)
