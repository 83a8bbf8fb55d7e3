"""Bundles (A25-A27): several KPIs over one prepared staff table, read once.

The cells of one pass (``operators.cube``) are written as Parquet in the shared folder; the parts of a
bundle are aggregates of those, so the preparation runs once and a lost executor does not replay it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_AS_OF, ts_lit
from ..operators import attrition, cube, headcount, kpis, spells
from ..schema import absent
from ..session import shared_dir


def store_root(spark: SparkSession, fresh: bool = True) -> str:
    """Root of a dataset store in the shared checkpoint location (a new one per call unless
    ``fresh`` is False, so repeated runs do not see each other's rows)."""
    import uuid

    return shared_dir(spark, "staffline-store", uuid.uuid4().hex) if fresh else shared_dir(spark, "staffline-store")


def _tidy(df: DataFrame, section: str) -> DataFrame:
    """One-row metric frame → (section, metric, value) rows."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(section).alias("section"), F.inline(rows))


def _rated(staff: DataFrame, events: DataFrame) -> DataFrame:
    """The events that attrition is told from: none without a hire or exit column, so that rates are 0."""
    undated = absent(staff, "hire_date") or absent(staff, "exit_date")
    return events.where(F.lit(False)) if undated else events


TENURE = ("left_n", "left_v", "left_m", "left_k", "left_mv", "left_kv", "left_mi", "left_ki")


def overview(staff: DataFrame, year: int | None = None, month: int | None = None,
             as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Basic KPIs, period attrition, whole-history attrition, contract mix, monthly exits and
    tenure at exit as one tidy (section, metric, value) table, from one pass over staff."""
    counts = {**kpis.basic_counts(staff), **kpis.tenure_counts(staff)}
    cells = spells.materialize(cube.event_cells(staff, (), counts, ("contract_type",), years=attrition.needs_years(year, month)))
    rates = attrition.period_of(_rated(staff, cube.month_events(cells)), {"p_": (year, month), "t_": (None, None)}, as_of=as_of)
    sums = cube.row_counts(cells, (), [*kpis.BASIC, *TENURE])
    by_type = (cube.row_counts(cells, ("contract_type",), ["total_active"])
               .select("contract_type", F.col("total_active").cast("long").alias("quantity"))
               .where(F.col("contract_type").isNotNull() & (F.col("quantity") > 0)))
    exits = cube.month_events(cells).where(F.col("exits") > 0).select(F.col("exits").alias("c"))
    only = lambda p: rates.select(*[F.col(c).alias(c[2:]) for c in rates.columns if c.startswith(p)])
    parts = [
        _tidy(kpis.basic_of(sums), "basic_kpis"),
        _tidy(only("p_"), "attrition"),
        _tidy(only("t_"), "attrition_total"),
        kpis.mix_of(by_type).select(F.lit("contract_types").alias("section"), F.inline(F.array(
            F.struct(F.concat(F.col("contract_type"), F.lit(":quantity")).alias("metric"),
                     F.col("quantity").cast("double").alias("value")),
            F.struct(F.concat(F.col("contract_type"), F.lit(":pct")).alias("metric"),
                     F.col("pct").cast("double").alias("value"))))),
        _tidy(kpis.exits_of(exits), "monthly_dismissals"),
        _tidy(kpis.tenure_of(sums), "tenure"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def headcount_bundle(staff: DataFrame, year: int | None = None, month: int | None = None,
                     as_of: str = DEFAULT_AS_OF, anchor: str = "start") -> dict[str, DataFrame]:
    """The headcount analyses of one request (REST anchors a month at its first day), from one
    pass over staff."""
    dims = [d for d in ("department", "gender", "rating") if d in staff.columns]
    at = headcount.counted_at(staff, ts_lit(headcount.reference_date(year, month, as_of, anchor)))
    counts = {"at_rows": F.when(at, 1).otherwise(0),
              "at_ids": F.when(at & F.col("employee_id").isNotNull(), 1).otherwise(0)}
    cells = spells.materialize(cube.event_cells(staff, dims, counts, ("department",), bands=True))
    now = (cube.row_counts(cells, ("department",), list(counts)).where(F.col("department").isNotNull() & (F.col("at_rows") > 0))
           .select("department", F.col("at_ids").cast("long").alias("headcount")))
    series = lambda d: headcount.monthly_of(
        headcount.series_of(cube.month_events(cells, [d], ids=True), d, as_of), d)
    monthly = series("department")
    out = {
        "headcount_by_department": headcount.shares_of(now, "department"),
        "headcount_temporal": monthly,
        "headcount_growth": headcount.growth(monthly, "department"),
        "headcount_gender": series("gender"),
        "headcount_tenure": headcount.tenure_of(spells.band_deltas(cube.band_moves(cells)), as_of),
    }
    return {**out, "headcount_performance": series("rating")} if "rating" in dims else out


def attrition_bundle(staff: DataFrame, year: int | None = None, month: int | None = None,
                    as_of: str = DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """Period attrition and the monthly history of one request, from one pass over staff."""
    cells = spells.materialize(cube.event_cells(staff, (), years=attrition.needs_years(year, month)))
    ev = _rated(staff, cube.month_events(cells))
    return {
        "attrition_period": attrition.period_of(ev, {"": (year, month)}, as_of=as_of),
        "attrition_history": attrition.labelled(attrition.history_of(ev, (), as_of)),
    }
