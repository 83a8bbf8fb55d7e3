"""Written tables that cut lineage, and other small helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and read back.

    Later jobs read the columns they need and a lost executor costs no recomputation; inside
    ``scratch.scope`` it is removed at the end."""
    return written(df, "llm", name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def sent_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` (a few narrow columns, written already) marked for sending to all tasks if it has at most
    ``most`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """The ``most`` rows of ``df`` that come first by the hash of ``key``, then by ``key``: the same rows
    at every run and partitioning. Rows far behind are left out before the sort, so that no task
    hands on more than its share."""
    h = F.xxhash64(*key)
    n = df.count()
    if n > most:
        bound = min((1 << 63) - 1, int((min(1.0, (1.2 * most + 1000) / n) - 0.5) * (1 << 64)))
        near = df.filter(h <= F.lit(bound))
        df = near if near.count() >= most else df  # few distinct keys may all hash high
    return df.orderBy(h, *key).limit(most)
