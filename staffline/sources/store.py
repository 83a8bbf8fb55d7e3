"""Data sets as units: versions, a log of what is published, retention and compaction.

A save writes every table of a data set into a new version folder and then publishes the version with one
log line that names the tables, their folders and schemas. Readers take the newest published version, so a
save that fails between tables changes nothing, a data set can be read and saved again, and old versions stay
readable until ``vacuum`` removes them. Folder names are hashes and version numbers; the names that users
give (owner, data set, file) stand in the log only, so no name needs escaping.

The log is one small file per save or delete. ``compact`` folds them into a Parquet snapshot and swaps it in with a
numbered manifest; readers take the newest manifest's snapshot and the log files it doesn't hold yet, so a
listing reads a bounded number of files however many saves there were.

    root/data/<hash of owner and data set>/<version>/<table>/   the rows
    root/log/<version>.json                                     one publication or deletion each
    root/snapshots/<number>/, root/manifests/<number>.json      folded log
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

TABLE = T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("schema", T.StringType())])
LOG_SCHEMA = T.StructType([
    T.StructField("owner", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("name", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("tables", T.MapType(T.StringType(), TABLE)),
])
BATCHES = "uploads"  # folder of versions that hold many data sets, by key
TAIL = 64  # log files beyond the snapshot from which a save compacts


def _version() -> str:
    """Ordered by time of the save, unique."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def key_of(owner: str, dataset_id: str) -> str:
    """The folder name of a data set: any characters in its names are fine."""
    return hashlib.sha256(json.dumps([owner, dataset_id]).encode()).hexdigest()[:32]


def _folder(root: str, owner: str, dataset_id: str) -> str:
    return f"{root}/data/{key_of(owner, dataset_id)}"


def publish(spark: SparkSession, root: str, line: str, entry: dict) -> bool:
    """One log line under the name ``line``; False if it is there already (a replayed batch)."""
    new = files.put(spark, f"{root}/log/{line}.json", json.dumps(entry))
    if len(log_files(spark, root)[1]) > TAIL:
        compact(spark, root)
    return new


def _manifest(spark: SparkSession, root: str) -> dict:
    names = files.listed(spark, f"{root}/manifests")
    return json.loads(files.text_of(spark, f"{root}/manifests/{names[-1]}")) if names else {"number": 0, "snapshot": None, "folded": []}


def log_files(spark: SparkSession, root: str) -> tuple[str | None, list[str]]:
    """What a reader of the log opens: the snapshot folder, and the log files it doesn't hold."""
    manifest = _manifest(spark, root)
    folded = set(manifest["folded"])
    tail = [f"{root}/log/{n}" for n in files.listed(spark, f"{root}/log") if n not in folded]
    return (f"{root}/snapshots/{manifest['snapshot']}" if manifest["snapshot"] else None), tail


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every publication and deletion known."""
    snapshot, tail = log_files(spark, root)
    out = spark.read.schema(LOG_SCHEMA).json(tail) if tail else spark.createDataFrame([], LOG_SCHEMA)
    return out.unionByName(spark.read.schema(LOG_SCHEMA).parquet(snapshot)) if snapshot else out


def _newest(log: DataFrame) -> DataFrame:
    """The entry that counts of each data set: the last by time, then by version."""
    rest = [f.name for f in LOG_SCHEMA.fields if f.name not in ("owner", "dataset_id")]
    last = log.groupBy("owner", "dataset_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "version")).alias("e"))
    return last.select("owner", "dataset_id", *[F.col(f"e.{c}").alias(c) for c in rest])


Derived = Callable[[Mapping[str, DataFrame]], DataFrame]


def save_dataset(spark: SparkSession, root: str, owner: str, dataset_id: str, tables: Mapping[str, DataFrame | Derived], name: str,
                 file_name: str, created_at: str, counted: str = "staff") -> str:
    """Stores all tables of a data set as one new version and publishes it; returns the version.
    ``counted``: the table whose rows the catalog shows. A function in place of a table is given the tables stored before
    it, so that a table made from others reads their files and doesn't compute them again."""
    version = _version()
    stored, written = {}, {}
    for table, df in tables.items():
        if not isinstance(df, DataFrame):
            df = df(written)
        path = f"{_folder(root, owner, dataset_id)}/{version}/{table}"
        df.write.parquet(path)
        written[table] = spark.read.schema(df.schema).parquet(path)
        stored[table] = {"path": path, "rows": written[table].count(), "schema": df.schema.json()}
    publish(spark, root, version, {
        "version": version, "owner": owner, "dataset_id": dataset_id, "deleted": False, "name": name, "file_name": file_name,
        "rows": stored.get(counted, {"rows": 0})["rows"], "created_at": _iso(created_at), "tables": stored})
    return version


def _iso(at: str) -> str:
    return at.replace(" ", "T")


def delete_dataset(spark: SparkSession, root: str, dataset_id: str, deleted_at: str, owner: str = "") -> None:
    """The data set is gone for readers; ``vacuum`` removes its files."""
    version = _version()
    publish(spark, root, version, {"version": version, "owner": owner, "dataset_id": dataset_id, "deleted": True, "created_at": _iso(deleted_at)})


def list_datasets(spark: SparkSession, root: str, owner: str) -> DataFrame:
    """An owner's data sets that are not deleted, newest first."""
    mine = _newest(entries(spark, root).where(F.col("owner") == F.lit(owner))).where(~F.col("deleted"))
    return mine.orderBy(F.desc("created_at"), "dataset_id").drop("deleted", "tables")


def versions(spark: SparkSession, root: str, owner: str, dataset_id: str) -> DataFrame:
    """Every published version of a data set, newest first."""
    mine = (F.col("owner") == F.lit(owner)) & (F.col("dataset_id") == F.lit(dataset_id)) & ~F.col("deleted")
    return entries(spark, root).where(mine).orderBy(F.desc("created_at"), F.desc("version"))


def load_dataset(spark: SparkSession, root: str, dataset_id: str, owner: str = "", version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a data set's newest version (or of a given one), by name; none if it is deleted or
    was never saved."""
    log = entries(spark, root).where((F.col("owner") == F.lit(owner)) & (F.col("dataset_id") == F.lit(dataset_id)))
    if version is not None:
        log = log.where((F.col("version") == F.lit(version)) & ~F.col("deleted"))
    row = _newest(log).first()
    if row is None or row["deleted"]:
        return {}
    out = {}
    for table, x in row["tables"].items():
        schema = T.StructType.fromJson(json.loads(x["schema"]))
        out[table] = spark.read.schema(schema).parquet(x["path"]) if x["path"] else spark.createDataFrame([], schema)
    return out


def read_dataset(spark: SparkSession, root: str, table: str, dataset_id: str, owner: str = "",
                 schema: T.StructType | None = None) -> DataFrame:
    """One table of a data set; without data an empty one (of ``schema``, if given)."""
    found = load_dataset(spark, root, dataset_id, owner).get(table)
    return found if found is not None else spark.createDataFrame([], schema or T.StructType([]))


def read_all(spark: SparkSession, root: str, owner: str, table: str, dataset_ids=None) -> DataFrame | None:
    """One table of all live data sets of an owner (or of the given ones) together, in one read; None if no live data set
    has it. The tables must have one schema."""
    mine = _newest(entries(spark, root).where(F.col("owner") == F.lit(owner))).where(~F.col("deleted"))
    if dataset_ids is not None:
        mine = mine.where(F.col("dataset_id").isin(list(dataset_ids)))
    rows = mine.select(F.col("tables")[table].alias("t")).where("t IS NOT NULL").collect()  # one path per live data set
    if not rows:
        return None
    schema = T.StructType.fromJson(json.loads(rows[0]["t"]["schema"]))
    paths = [r["t"]["path"] for r in rows if r["t"]["path"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str, forget_before: str | None = None) -> int:
    """Folds the log into a new snapshot of one file and swaps it in; returns the manifest's number. Entries that a
    newer one replaces stay (old versions remain readable), but what was deleted or replaced before
    ``forget_before`` is left out."""
    manifest = _manifest(spark, root)
    names = files.listed(spark, f"{root}/log")
    number = manifest["number"] + 1
    log = entries(spark, root)
    if forget_before is not None:
        log = _kept(log, forget_before)
    snapshot = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    log.coalesce(1).write.parquet(f"{root}/snapshots/{snapshot}")  # one row per save: metadata
    told = json.dumps({"number": number, "snapshot": snapshot, "folded": names})
    if not files.put(spark, f"{root}/manifests/{number:012d}.json", told):
        files.remove(spark, f"{root}/snapshots/{snapshot}")  # another compaction was first: its snapshot counts
    return number


def _kept(log: DataFrame, before: str) -> DataFrame:
    """The entries a reader can still ask for: not replaced or deleted before the given time."""
    cut = F.lit(before).cast("timestamp_ntz")
    later = (_newest(log.where(F.col("created_at") < cut)).select(
        F.col("owner").alias("o"), F.col("dataset_id").alias("d"), F.col("version").alias("v"), F.col("deleted").alias("gone")))
    both = log.join(later, F.col("owner").eqNullSafe(F.col("o")) & F.col("dataset_id").eqNullSafe(F.col("d")), "left")
    recent = F.col("created_at") >= cut
    return both.where(recent | ((F.col("version") == F.col("v")) & ~F.col("gone"))).drop("o", "d", "v", "gone")


def vacuum(spark: SparkSession, root: str, before: str) -> list[str]:
    """Removes what no reader that began at or after ``before`` can want: versions replaced or deleted before then, folders of
    saves that were never published and are older, and folded log files, snapshots and manifests that newer ones
    replace. Returns the folders of rows removed. Run it with a time further back than the longest job."""
    log = entries(spark, root)
    cut_ns = spark.sql(f"SELECT unix_micros(TIMESTAMP '{before} UTC')").first()[0] * 1000
    paths = lambda df: {r["path"] for r in df.select(F.explode(F.map_values("tables")).alias("t")).select("t.path")
                        .where("path IS NOT NULL").collect()}  # one path per stored table
    known, kept = paths(log), paths(_kept(log, before))
    removed = sorted(known - kept)
    for path in removed:
        files.remove(spark, path)
        if not files.listed(spark, folder := path.rsplit("/", 1)[0]):
            files.remove(spark, folder)
    used = {p[len(f"{root}/data/"):].split("/")[1] for p in known}
    for folder in files.listed(spark, f"{root}/data"):
        for version in files.listed(spark, f"{root}/data/{folder}"):
            if folder != BATCHES and version not in used and int(version.split("-")[0]) < cut_ns:
                files.remove(spark, f"{root}/data/{folder}/{version}")
                removed.append(f"{root}/data/{folder}/{version}")
    compact(spark, root, forget_before=before)
    manifest = _manifest(spark, root)
    current = {f"{root}/manifests/{n}" for n in files.listed(spark, f"{root}/manifests")[-1:]}
    replaced = [f"{root}/log/{n}" for n in manifest["folded"]]
    replaced += [f"{root}/snapshots/{n}" for n in files.listed(spark, f"{root}/snapshots") if n != manifest["snapshot"]]
    replaced += [p for n in files.listed(spark, f"{root}/manifests") if (p := f"{root}/manifests/{n}") not in current]
    for path in replaced:  # by their age on storage: a listing begun earlier may still read them
        if all(ms * 1_000_000 < cut_ns for _, _, ms in files.stamps(spark, path)):
            files.remove(spark, path)
    return removed
