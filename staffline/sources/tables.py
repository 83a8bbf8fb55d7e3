"""Table source, stored results and other sinks (S2, S9-S12). Data sets are in ``sources.store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

RESULT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("result", T.VariantType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table with a fixed schema (no inference); a missing path gives an empty table."""
    try:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex) or "Path does not exist" in str(ex):
            return spark.createDataFrame([], schema)
        raise


def save_result(result: DataFrame, root: str, dataset_id: str, kind: str, created_at: str) -> None:
    """Append a result as rows (dataset_id, kind, result, created_at), one per result row: nothing is
    gathered into one record. ``result`` is a VARIANT, which carries its own field names and types, so results of
    all kinds share one table."""
    (to_records(null_clean(result))
     .select(F.lit(dataset_id).alias("dataset_id"), F.lit(kind).alias("kind"), F.parse_json("json").alias("result"),
             F.lit(created_at).cast("timestamp_ntz").alias("created_at"))
     .write.mode("append").parquet(f"{root}/_results"))


def read_results(spark: SparkSession, root: str, dataset_id: str, kind: str | None = None) -> DataFrame:
    df = read_table(spark, f"{root}/_results", RESULT_SCHEMA).where(F.col("dataset_id") == F.lit(dataset_id))
    return df if kind is None else df.where(F.col("kind") == F.lit(kind))


def result_fields(results: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(dataset_id, kind, created_at) and one column per field (name -> path, type) of stored results of any kinds; a
    result without the path (or whose value isn't of the type) gives null. No schema is needed."""
    return results.select("dataset_id", "kind", "created_at", *[
        F.try_variant_get("result", path, dtype).alias(name) for name, (path, dtype) in fields.items()])


def result_schema(results: DataFrame) -> DataFrame:
    """The fields and types that the stored results of each kind have (merged over their rows)."""
    return results.groupBy("dataset_id", "kind").agg(F.schema_of_variant_agg("result").alias("fields"))


def _clean_type(c, dtype: T.DataType):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dtype)).otherwise(c)
    if isinstance(dtype, T.StructType):
        return F.struct(*[_clean_type(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _clean_type(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _clean_type(v, dtype.valueType))
    return c


def null_clean(df: DataFrame) -> DataFrame:
    """NaN → null in every double column, also inside structs, arrays and the values of maps."""
    return df.select(*[_clean_type(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (``json``), null fields included, built on the executors."""
    return df.select(F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_report(lines: DataFrame, path: str) -> None:
    """The Markdown report (``report_lines``: a few dozen ordered lines) as one text file."""
    lines.orderBy("line_no").select("text").coalesce(1).write.mode("overwrite").text(path)
