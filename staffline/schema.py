"""Table schemas, column resolution and conforming.

All of this reads only ``df.schema`` on the driver; no data is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import coerce_timestamp

TS = T.TimestampNTZType()

COMPANY_SCHEMA = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("tax_id", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)

STAFF_SCHEMA = T.StructType(
    [
        T.StructField("employee_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("manager_id", T.LongType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("hire_date", TS),
        T.StructField("exit_date", TS),
        T.StructField("exit_reason", T.StringType()),
        T.StructField("last_promotion", TS),
        T.StructField("last_merit", TS),
    ]
)

# Columns the reference reads when present but does not list as expected.
STAFF_OPTIONAL = T.StructType(
    [
        T.StructField("exit_type", T.StringType()),
        # whether the row's own data set has an exit type column (tables made of several sets)
        T.StructField("has_exit_type", T.BooleanType()),
        T.StructField("company", T.StringType()),
        # the manager by name, for tables without manager ids
        T.StructField("manager_name", T.StringType()),
    ]
)

REVIEWS_SCHEMA = T.StructType(
    [
        T.StructField("employee_id", T.LongType()),
        T.StructField("rating", T.StringType()),
        T.StructField("cycle_end", TS),
        T.StructField("seq", T.LongType()),
    ]
)

TABLE_SCHEMAS = {"company": COMPANY_SCHEMA, "staff": STAFF_SCHEMA, "reviews": REVIEWS_SCHEMA}

# ---- fixed values: sheet and header names of the reference workbook, mapped to ours --------
SHEET_NAMES = {"empresa": "company", "colaboradores": "staff", "performance": "reviews"}
HEADER_NAMES = {
    "nome empresa": "company",
    "empresa": "company",
    "cnpj": "tax_id",
    "unidade": "unit",
    "cidade": "city",
    "uf": "state",
    "matricula": "employee_id",
    "nome": "name",
    "departamento": "department",
    "cargo": "role",
    "matricula do gestor": "manager_id",
    "gestor": "manager_name",
    "tipo_contrato": "contract_type",
    "genero": "gender",
    "data de admissão": "hire_date",
    "data de desligamento": "exit_date",
    "motivo de desligamento": "exit_reason",
    "tipo desligamento": "exit_type",
    "ultima promoção": "last_promotion",
    "ultimo mérito": "last_merit",
    "avaliação": "rating",
    "data de encerramento do ciclo": "cycle_end",
}
# ---------------------------------------------------------------------------------------------


def _norm(name: str) -> str:
    return name.strip().lower()


def resolve(df: DataFrame, name: str) -> str | None:
    """First column whose trimmed, lower-cased name equals ``name`` (trimmed, lower-cased).

    A reference header (e.g. ' Matricula ') also resolves to our name through ``HEADER_NAMES``.
    """
    want = _norm(name)
    for c in df.columns:
        if _norm(c) == want:
            return c
    target = HEADER_NAMES.get(want)
    for c in df.columns:
        n = _norm(c)
        if target is not None and (n == target or HEADER_NAMES.get(n) == target):
            return c
        if HEADER_NAMES.get(n) == want:
            return c
    return None


ID_COLUMNS = ("employee_id", "manager_id")


def id_text(c: Column) -> Column:
    """An id as trimmed text, blank as null; an integral number written with decimals ('12.0') loses
    them, leading zeros stay."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(t != "", t)


def _cast(c: Column, dtype: T.DataType, day_first: bool = False) -> Column:
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return coerce_timestamp(c, day_first)
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    return c.try_cast(dtype)


def conform(df: DataFrame, schema: T.StructType, optional: T.StructType | None = None,
            keep: tuple[str, ...] = (), day_first: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: resolve names, cast, add typed nulls for missing columns.

    Extra columns are dropped, except those named in ``optional`` (kept when present, cast) and
    in ``keep`` (passed through unchanged). Ids stay integers if they are, and are text otherwise.
    A column that was absent carries ``absent`` in its metadata (see ``absent``).
    Columns that already have the target type are passed through untouched, so a conformed
    table keeps its Parquet pushdown.
    """
    cols = []
    for f in schema.fields:
        src = resolve(df, f.name)
        if src is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name, metadata={"absent": True}))
        elif f.name in ID_COLUMNS:
            c = F.col(f"`{src}`")
            integral = isinstance(df.schema[src].dataType, T.IntegralType)
            cols.append((c.cast(f.dataType) if integral else id_text(c)).alias(f.name))
        elif df.schema[src].dataType == f.dataType:
            cols.append(F.col(f"`{src}`").alias(f.name))
        else:
            cols.append(_cast(F.col(f"`{src}`"), f.dataType, day_first).alias(f.name))
    for f in (optional.fields if optional else []):
        src = resolve(df, f.name)
        if src is not None:
            cols.append(_cast(F.col(f"`{src}`"), f.dataType, day_first).alias(f.name) if df.schema[src].dataType != f.dataType
                        else F.col(f"`{src}`").alias(f.name))
    cols += [F.col(f"`{k}`") for k in keep if k in df.columns]
    return df.select(*cols)


def absent(df: DataFrame, column: str) -> bool:
    """Whether ``column`` is missing, or was missing from the table that ``conform`` read."""
    return column not in df.columns or bool(df.schema[column].metadata.get("absent"))


def schema_report(spark: SparkSession, df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """(table, column, status) rows: 'ok', 'missing' or 'extra' per column."""
    present = {}
    for c in df.columns:
        n = _norm(c)
        present[HEADER_NAMES.get(n, n)] = c
    expected = [f.name for f in schema.fields]
    rows = [(table, name, "ok" if name in present else "missing") for name in expected]
    rows += [(table, src, "extra") for name, src in present.items() if name not in expected]
    return spark.createDataFrame(rows, "table string, column string, status string")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
