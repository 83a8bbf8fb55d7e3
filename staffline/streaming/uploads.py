"""Upload ingestion as a Structured Streaming job (the reference's upload flow, re-aimed).

The reference stores one uploaded workbook per request: read the sheets, prepare the tables,
save them under a new dataset id and add a catalog row. Here an uploads folder is a streaming
file source (``binaryFile``, only ``*.xlsx``): each micro-batch parses its new workbooks with
the same ``mapInPandas`` parser as the batch source and, in ``foreachBatch``, writes the
company / staff / reviews rows of all workbooks of the batch (one job per table, by data set) and then
publishes one data set per workbook, named by its path below the uploads folder; unreadable files
give one row each. A replayed batch overwrites its own files and publishes nothing twice. The stream's own checkpoint lives
in the shared folder, so a restarted or failed query resumes without re-ingesting files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store
from ..sources.workbooks import _parse_batches, OUT_SCHEMA, sheet_table

BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
TABLES = ("company", "staff", "reviews")


def _dataset_of(prefix: str, path: str) -> str:
    """The workbook's path below the uploads folder, without its ending: equal names in two folders are two data sets."""
    return path[len(prefix):].lstrip("/").removesuffix(".xlsx") if path.startswith(prefix) else path


def _store_batch(root: str, owner: str, prefix: str, stream: str):
    def store_rows(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        version = f"{batch_id:020d}-{stream}"  # a replayed batch writes and publishes under the same names
        base = f"{root}/data/{store.BATCHES}/{version}"
        rows = rows.persist()
        try:
            paths = [r["path"] for r in rows.where(F.col("error").isNull()).select("path").distinct().collect()]  # one per workbook
            keys = {p: store.key_of(owner, _dataset_of(prefix, p)) for p in paths}
            named = spark.createDataFrame(list(keys.items()), "path string, key string")
            stored: dict[str, dict] = {p: {} for p in paths}
            for table in TABLES:
                t = sheet_table(rows, table, keep_path=True)
                schema = t.drop("path").schema.json()
                t.join(F.broadcast(named), "path").drop("path").write.mode("overwrite").partitionBy("key").parquet(f"{base}/{table}")
                n = {r["path"]: r["n"] for r in t.groupBy("path").agg(F.count("*").alias("n")).collect()}  # one per workbook
                for p in paths:
                    stored[p][table] = {"path": f"{base}/{table}/key={keys[p]}" if n.get(p) else None, "rows": n.get(p, 0),
                                        "schema": schema}
            now = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")").first()[0]
            for p in paths:
                dataset = _dataset_of(prefix, p)
                store.publish(spark, root, f"{version}-{keys[p]}", {
                    "version": version, "owner": owner, "dataset_id": dataset, "deleted": False, "name": dataset.split("/")[-1],
                    "file_name": p.split("/")[-1], "rows": stored[p]["staff"]["rows"], "created_at": now, "tables": stored[p]})
            (rows.where(F.col("error").isNotNull()).select("path", "error", F.lit(batch_id).cast("long").alias("batch_id"))
             .write.mode("overwrite").parquet(f"{root}/_errors/batch={version}"))
        finally:
            rows.unpersist()

    return store_rows


def ingest_uploads(spark: SparkSession, upload_dir: str, root: str, owner: str,
                   checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the ingestion stream; with ``available_now`` it processes what is there and stops.
    ``checkpoint`` is a lasting shared folder: with another one all files are read again."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(upload_dir).select("path", "content"))
    rows = files.mapInPandas(_parse_batches, OUT_SCHEMA)
    folder = spark._jvm.org.apache.hadoop.fs.Path(upload_dir)
    prefix = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    writer = (rows.writeStream.foreachBatch(_store_batch(root, owner, prefix, stream))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
