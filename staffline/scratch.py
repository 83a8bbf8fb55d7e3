"""Written intermediates: scopes that remove them, and a cache that reuses them.

``written`` cuts lineage with a Parquet table in the shared folder. Inside ``scope`` every such table is noted and
removed at the end, so a job that has stored its result leaves nothing behind.

``cached`` keeps a table for others: its key is a hash of the query's normalised plan, its output columns and the
(path, size, time) of every file it reads, so a changed file or another filter is another key. A table younger than its
lifetime is read instead of computed again; older ones are removed when the same key is asked for, or by ``expire``. Plans
that read anything but files, draw random numbers or the clock, or run Python can't be told by their text: they are
computed every time.
"""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_dir
from .sources import files

LIFETIME = 3600  # seconds, as the loader this stands for keeps its tables
FOLDER = "staffline-cache"
_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staffline_scratch", default=None)


def written(df: DataFrame, folder: str = "staffline-tables", name: str = "") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its schema."""
    spark = df.sparkSession
    path = shared_dir(spark, folder, f"{name}{'-' if name else ''}{uuid.uuid4().hex}")
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside (and not by ``cached``) are removed at the end, also after a failure. Results must be stored or
    collected before."""
    noted: list[str] = []
    token = _noted.set(noted)
    try:
        yield noted
    finally:
        _noted.reset(token)
        for path in noted:
            files.remove(spark, path)


def _leaves(df: DataFrame) -> list:
    found = df._jdf.queryExecution().analyzed().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def fingerprint(df: DataFrame) -> str | None:
    """The key of a query over files, None where its plan doesn't tell what it computes."""
    spark = df.sparkSession
    roots: set[str] = set()
    for leaf in _leaves(df):
        if leaf.nodeName() != "LogicalRelation" or not hasattr(leaf, "relation") or "HadoopFsRelation" not in leaf.relation().getClass().getName():
            return None
        paths = leaf.relation().location().rootPaths()
        roots |= {paths.apply(i).toString() for i in range(paths.size())}
    key, old = "spark.sql.debug.maxToStringFields", spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set(key, "100000")  # nothing of the plan may be cut
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized()
        text = plan.toString()
    finally:
        spark.conf.set(key, old)
    if not plan.deterministic() or any(s in text.lower() for s in ("pythonudf", "mapinpandas", "mapinarrow", "flatmapgroups", "current_", "now()")):
        return None
    stamps = []
    for root in sorted(roots):  # listed by Spark's own parallel listing, and summed there
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        n, total = listing.select("path", "length", "modificationTime").agg(
            F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        stamps.append(f"{root} {n} {total}")
    return hashlib.sha256("\n".join([text, df.schema.json(), *stamps]).encode()).hexdigest()


def _versions(spark: SparkSession, key: str) -> list[tuple[str, float]]:
    """(path, age in seconds) of the whole tables under a key, newest first."""
    base = shared_dir(spark, FOLDER, key)
    now = time.time()
    names = sorted(files.listed(spark, base), reverse=True)
    return [(f"{base}/{n}", now - int(n.split("-")[0]) / 1e9) for n in names if files.exists(spark, f"{base}/{n}/_SUCCESS")]


def cached(df: DataFrame, lifetime: float = LIFETIME) -> DataFrame:
    """``df`` read from a table of the same query over the same files that is younger than ``lifetime`` seconds, else written
    for the next one. Queries that have no key are written anew."""
    spark = df.sparkSession
    if (key := fingerprint(df)) is None:
        return written(df)
    found = _versions(spark, key)
    if found and found[0][1] < lifetime:
        return spark.read.schema(df.schema).parquet(found[0][0])
    path = shared_dir(spark, FOLDER, key, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    for old, age in found:
        if age >= 2 * lifetime:  # readers of the last lifetime may be at work still
            files.remove(spark, old)
    return spark.read.schema(df.schema).parquet(path)


def expire(spark: SparkSession, lifetime: float = LIFETIME) -> int:
    """Removes cached tables older than ``lifetime`` seconds; returns how many."""
    base, n = shared_dir(spark, FOLDER), 0
    for key in files.listed(spark, base):
        for path, age in _versions(spark, key):
            if age >= lifetime:
                n += files.remove(spark, path)
    return n
