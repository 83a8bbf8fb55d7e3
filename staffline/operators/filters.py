"""Facets and filters."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ts_lit
from ..functions.text import non_blank

ALL = "all"


def facet_values(staff: DataFrame, column: str) -> DataFrame:
    """Distinct, non-null, non-blank values of a column, sorted (one partial aggregate)."""
    return staff.where(non_blank(F.col(column))).select(F.col(column).alias("value")).distinct().orderBy("value")


def _pick(df: DataFrame, column: str, values) -> DataFrame:
    """``None`` = no filter; ``'all'`` = every non-null value (the dashboard's default pick);
    a list = ``isin`` (an empty list means no filter, as an empty pick does)."""
    if values is None or column not in df.columns:
        return df
    if isinstance(values, str) and values == ALL:
        return df.where(F.col(column).isNotNull())
    values = list(values) if not isinstance(values, (str, int)) else [values]
    if not values:
        return df
    return df.where(F.col(column).isin(values))


def filter_staff(staff: DataFrame, company: str | None = None, department=None, role=None, manager_id=None,
                 contract_type=None, name: str | None = None) -> DataFrame:
    """Company equality, then department, role, manager and contract picks (chained, so
    each facet's options come from the already-filtered rows), then a case-insensitive regex
    name search. Pure row filters: they reach the Parquet scan where the column allows."""
    df = staff
    if company is not None and company != "Todas" and "company" in df.columns:
        df = df.where(F.col("company") == F.lit(company))
    df = _pick(df, "department", department)
    df = _pick(df, "role", role)
    df = _pick(df, "manager_id", manager_id)
    df = _pick(df, "contract_type", contract_type)
    if name:
        df = name_search(df, name)
    return df


def name_search(staff: DataFrame, pattern: str) -> DataFrame:
    """Names containing the (regex) pattern, case-insensitive with Unicode case folding;
    a null name never matches."""
    return staff.where(F.coalesce(F.col("name").rlike("(?iu)" + pattern), F.lit(False)))


def available_years(staff: DataFrame) -> DataFrame:
    """Sorted distinct calendar years of hire and exit dates."""
    ys = staff.select(F.explode(F.array(F.year("hire_date"), F.year("exit_date"))).alias("year"))
    return ys.where(F.col("year").isNotNull()).distinct().orderBy("year")


def hires_in_period(staff: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows hired in the given year and/or month (no filter when both are None)."""
    if year is not None:  # a range, which reaches a scan where the column is read as it is stored
        first, after = (year, month), (year, month + 1) if month is not None and month < 12 else (year + 1, 1)
        lo, hi = f"{first[0]:04d}-{first[1] or 1:02d}-01 00:00:00", f"{after[0]:04d}-{after[1]:02d}-01 00:00:00"
        return staff.where((F.col("hire_date") >= ts_lit(lo)) & (F.col("hire_date") < ts_lit(hi)))
    return staff if month is None else staff.where(F.month("hire_date") == F.lit(month))


def row_count(df: DataFrame) -> DataFrame:
    """Rows left after the filters, as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns and null count per column of a table, in one aggregate pass:
    (table, column, rows, nulls). ``df.limit(5)`` is the preview."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}")
                                                 for i, c in enumerate(df.columns)]
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"))
                     for i, c in enumerate(df.columns)])
    return a.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(rows)) \
        .select("table", "column", "rows", "nulls")


def select_present(df: DataFrame, columns: Iterable[str], rename: dict[str, str] | None = None) -> DataFrame:
    """C17: project and rename the listed columns that exist, in the listed order."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in columns if c in df.columns])
