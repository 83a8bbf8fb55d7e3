"""Spark session helpers.

The library never builds its own session inside an operator; callers pass one in.
These helpers are for tests, the bench and the driver entry point, and for finding
the shared folder that lineage cuts and dataset tables go to.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "staffline") -> SparkSession:
    """A session tuned the way the operators expect: AQE on, UTC, no UI, NTZ timestamps kept.
    Local runs put this package on the Python workers' path (a cluster ships it with the job)."""
    pkg_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (pkg_root, os.environ.get("PYTHONPATH")) if p)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of intermediates are removed once their DataFrames are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured_root(spark: SparkSession) -> str | None:
    for getter in (lambda: spark.conf.get(_CHECKPOINT_KEY, None),
                   lambda: spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None),
                   lambda: spark.sparkContext.getCheckpointDir()):
        try:
            v = getter()
        except Exception:  # noqa: BLE001 - an unreadable setting counts as unset
            v = None
        if v:
            return v
    return None


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local[...]``, not ``local-cluster``)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach.

    On a cluster this is under the ``spark.checkpoint.dir`` the cluster names (or the checkpoint
    folder already set on the context). Only on a local master with neither set (tests) do we make
    one of our own; on any other master that is an error, as executors could not reach it.
    """
    root = _configured_root(spark)
    if not root:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="staffline-ckpt-")
        try:
            spark.conf.set(_CHECKPOINT_KEY, root)
        except Exception:  # noqa: BLE001 - some sessions reject core settings at runtime
            pass
        spark.sparkContext.setCheckpointDir(root)
    path = root.rstrip("/")
    for p in parts:
        path = f"{path}/{p}"
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint()`` has a shared target; returns it."""
    root = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root
