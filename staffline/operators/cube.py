"""One pass over staff for a whole bundle: month events, band moves and row counts as one table.

Every staff row gives its month events (hire, leaving the headcount, exit) with the values of all
dimensions at once, its moves between tenure bands, and one row of counts. They are summed by
(kind, dimension values, month, bands) with a map-side partial aggregate, so what is shuffled and written is
at most cells x months, and staff is read once. Every series of a bundle (by department, gender, rating,
tenure band or in total), every period mean and every count is then an aggregate of these cells.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import voluntary_flag
from . import spells

MONTH, BAND, ROW = "month", "band", "row"
SUMS = ("delta", "delta_ids", "exits", "voluntary", "total", "moves")
MARKS = ("hire_mark", "year_mark")


def event_cells(staff: DataFrame, dims: Sequence[str] = (), counts: Mapping[str, Column] | None = None,
                count_by: Sequence[str] = (), mode: str = "compat", years: bool = False, bands: bool = False,
                id_col: str = "employee_id", starts: Sequence[int] = spells.TENURE_BAND_START_DAYS) -> DataFrame:
    """Cells (kind, dims..., mi, frm, to, sums and marks, counts...) of ``staff``.

    ``dims``: the dimensions of the month events. ``counts``: name -> numeric column of a row, summed by
    ``count_by``. ``delta`` counts spells, ``delta_ids`` those with an id. ``years`` marks the calendar years seen."""
    counts = dict(counts or {})
    keys = [*dims, *[c for c in count_by if c not in dims]]
    h, e = F.to_date("hire_date"), F.to_date("exit_date")
    spell = h.isNotNull() & (e.isNull() | (e > h))
    has_id = F.col(id_col).isNotNull() if id_col in staff.columns else F.lit(True)
    one, z = F.lit(1), F.lit(0)
    flag = lambda c: F.when(c, 1).otherwise(0)
    cols = {
        "_ch": spells.ceil_index(h), "_sp": flag(spell), "_ct": flag(spell & has_id),
        "_ce": F.when(spell, spells.ceil_index(e)), "_fe": spells.month_index(e), "_v": flag(voluntary_flag(staff, mode)),
        "_yh": F.year(h) * 12, "_ye": F.year(e) * 12,
    }
    n = len(starts)
    if bands:
        last_band = sum((F.date_add(h, starts[k]) < e).cast("int") for k in range(1, n)) + F.lit(1)
        cols["_lb"] = F.when(e.isNotNull(), last_band).otherwise(F.lit(0))
        for k in range(1, n):
            st = F.date_add(h, starts[k])
            cols[f"_s{k}"] = F.when(spell & (e.isNull() | (st < e)), spells.ceil_index(st))
    proj = staff.select(*keys, *[c.alias(k) for k, c in cols.items()], *[c.cast("double").alias(f"_c_{k}") for k, c in counts.items()])
    types = dict(proj.dtypes)

    def event(kind: str, mi: Column, frm: Column = z, to: Column = z, **values: Column) -> Column:
        use = {MONTH: dims, ROW: count_by}.get(kind, ())
        fields = [F.lit(kind).alias("kind")]
        fields += [(F.col(k) if k in use else F.lit(None).cast(types[k])).alias(k) for k in keys]
        fields += [mi.cast("int").alias("mi"), frm.cast("int").alias("frm"), to.cast("int").alias("to")]
        fields += [values.get(c, z).cast("int").alias(c) for c in (*SUMS, *MARKS)]
        fields += [(F.col(f"_c_{c}") if kind == ROW else F.lit(None).cast("double")).alias(c) for c in counts]
        return F.struct(*fields)

    c = F.col
    events = [
        event(MONTH, c("_ch"), delta=c("_sp"), delta_ids=c("_ct"), hire_mark=one),
        event(MONTH, c("_ce"), delta=-c("_sp"), delta_ids=-c("_ct")),
        event(MONTH, c("_fe"), exits=one, voluntary=c("_v")),
    ]
    if years:
        events += [event(MONTH, c("_yh"), year_mark=one), event(MONTH, c("_ye"), year_mark=one)]
    if bands:
        events += [
            event(BAND, c("_ch"), to=c("_ct"), total=c("_sp"), moves=one, hire_mark=one),
            event(BAND, c("_ce"), frm=F.when(c("_ct") > 0, c("_lb")).otherwise(z), total=F.lit(-1), moves=one),
            event(BAND, c("_fe"), exits=one, moves=one),
        ]
        for k in range(1, n):
            events.append(event(BAND, c(f"_s{k}"), frm=c("_ct") * k, to=c("_ct") * (k + 1), moves=one))
    if counts:
        events.append(event(ROW, F.lit(None)))
    flat = proj.select(F.inline(F.array(*events))).where(F.col("mi").isNotNull() | (F.col("kind") == ROW))
    return flat.groupBy("kind", *keys, "mi", "frm", "to").agg(
        *[F.sum(s).alias(s) for s in SUMS], *[F.max(m).alias(m) for m in MARKS], *[F.sum(k).alias(k) for k in counts])


def month_events(cells: DataFrame, by: Sequence[str] = (), ids: bool = False) -> DataFrame:
    """The month events of ``spells.month_events`` by any of the cells' dimensions (years included).
    ``ids``: the headcount counts rows with an id."""
    by = list(by)
    return (cells.where(F.col("kind") == MONTH).groupBy(*by, "mi").agg(
        F.sum("delta_ids" if ids else "delta").alias("delta"), F.sum("exits").alias("exits"), F.sum("voluntary").alias("voluntary"),
        F.max("hire_mark").alias("hire_mark"), F.max("year_mark").alias("year_mark"))
        .withColumn("month", spells.index_month(F.col("mi"))).drop("mi"))


def band_moves(cells: DataFrame) -> DataFrame:
    """(mi, frm, to, c, total, exits, hire_mark), as ``spells.band_deltas`` takes them."""
    return cells.where(F.col("kind") == BAND).groupBy("mi", "frm", "to").agg(
        F.sum("moves").alias("c"), F.sum("total").alias("total"), F.sum("exits").alias("exits"), F.max("hire_mark").alias("hire_mark"))


def row_counts(cells: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The counts summed by some of the columns they were counted by (all rows: one row of sums)."""
    return cells.where(F.col("kind") == ROW).groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
