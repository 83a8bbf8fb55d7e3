"""Headcount operators: at a date (A1, A2), monthly by group (A8-A10), by tenure band (A11),
growth (W1), growth summaries (A18, A19), period-vs-total comparison (J2), series slices
(C13-C15)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import TENURE_LABELS
from ..functions.dates import DEFAULT_AS_OF, month_floor, month_label, ts_lit
from ..functions.numeric import round_half_even
from ..schema import absent
from . import spells


def active_at(t: Column) -> Column:
    """Hired on/before ``t`` and not left by then (``exit > t`` or no exit)."""
    return F.coalesce(F.col("hire_date") <= t, F.lit(False)) & (F.col("exit_date").isNull() | (F.col("exit_date") > t))


def counted_at(staff: DataFrame, t: Column) -> Column:
    """``active_at``, and what stands in for it where the table came without date columns: without a
    hire column not having left decides, without an exit column the ``active`` column, and without
    that everyone counts."""
    if not absent(staff, "exit_date"):
        if not absent(staff, "hire_date"):
            return active_at(t)
        return F.col("exit_date").isNull() | (F.col("exit_date") > t)
    return F.coalesce(F.col("active"), F.lit(False)) if "active" in staff.columns else F.lit(True)


def reference_date(year: int | None, month: int | None, as_of: str = DEFAULT_AS_OF, anchor: str = "end") -> str:
    """A2: the instant a period is measured at. (y, m) → last day of the month (``anchor='end'``,
    dashboard) or its first day (``'start'``, REST); y → 31 Dec; otherwise ``as_of``."""
    import calendar

    if year is not None and month is not None:
        day = calendar.monthrange(year, month)[1] if anchor == "end" else 1
        return f"{year:04d}-{month:02d}-{day:02d} 00:00:00"
    if year is not None:
        return f"{year:04d}-12-31 00:00:00"
    return as_of


def share_of_total(grouped: DataFrame, value: str, out: str, digits: int | None = None) -> DataFrame:
    """``value / sum(value) * 100`` for every row of an already grouped frame.

    Its total is one global aggregate brought in as a scalar subquery, over the same exchange as
    the grouped frame itself: no window pulls rows into one task.
    """
    g = grouped
    total = g.agg(F.sum(value).alias("_total"))
    share = F.col(value) / F.col("_total") * F.lit(100.0)
    if digits is not None:
        share = round_half_even(share, digits)
    return spells.with_scalars(g, total).withColumn(out, share).drop("_total")


def headcount_at(staff: DataFrame, group: str = "department", at: str = DEFAULT_AS_OF) -> DataFrame:
    """A1: people active at ``at`` per non-null group: count of non-null ids and % of the total,
    largest first (ties by group)."""
    t = ts_lit(at)
    grouped = (
        staff.where(counted_at(staff, t) & F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("employee_id").alias("headcount"))
    )
    return shares_of(grouped, group)


def shares_of(grouped: DataFrame, group: str) -> DataFrame:
    return share_of_total(grouped, "headcount", "pct").orderBy(F.desc("headcount"), F.col(group))


def headcount_compare(staff: DataFrame, year: int | None, month: int | None, group: str = "department",
                      as_of: str = DEFAULT_AS_OF, anchor: str = "end") -> DataFrame:
    """Headcount per group at the period's reference date next to the headcount at ``as_of``
    (the full outer join of the two distributions, done as one aggregate with two conditional
    counts), difference and % change (null where the total is 0)."""
    tp = ts_lit(reference_date(year, month, as_of, anchor))
    tt = ts_lit(as_of)
    g = staff.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.when(counted_at(staff, tp), F.col("employee_id"))).alias("headcount_period"),
        F.count(F.when(counted_at(staff, tt), F.col("employee_id"))).alias("headcount_total"),
        F.count_if(counted_at(staff, tp)).alias("_np"),
        F.count_if(counted_at(staff, tt)).alias("_nt"),
    )
    g = g.where((F.col("_np") > 0) | (F.col("_nt") > 0))
    diff = F.col("headcount_period") - F.col("headcount_total")
    change = round_half_even(F.try_divide(diff.cast("double"), F.col("headcount_total").cast("double")) * 100, 2)
    return g.select(group, "headcount_period", "headcount_total", diff.alias("difference"),
                    change.alias("change_pct")).orderBy(F.desc("headcount_period"), F.col(group))


def _global_series(staff: DataFrame, group: str, as_of: str, end: str | None = None) -> DataFrame:
    """Per-group dense series on the global spine (bounds over all rows, null groups included)."""
    return series_of(spells.month_events(staff, [group], id_col="employee_id"), group, as_of, end)


def series_of(ev: DataFrame, group: str, as_of: str, end: str | None = None) -> DataFrame:
    """The dense series of month events that exist already (its exchange serves both branches)."""
    end_default = month_floor(F.to_date(ts_lit(as_of)))
    gb = ev.agg(
        F.min(F.when(F.col("hire_mark") > 0, F.col("month"))).alias("lo"),
        (F.coalesce(F.max(F.when(F.col("exits") > 0, F.col("month"))), end_default) if end is None
         else F.max(spells.end_month(end))).alias("hi"),
    )
    evg = spells.with_scalars(spells.drop_null_keys(ev, [group]), gb)
    x = spells.step_series(evg, [group], as_of, lo=F.col("lo"), hi=F.col("hi"))
    return x.where(F.col("lo").isNotNull() & (F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi")))


def headcount_monthly(staff: DataFrame, group: str = "department", as_of: str = DEFAULT_AS_OF,
                      end: str | None = None) -> DataFrame:
    """A8 (A9 gender, A10 rating): per spine month and non-null group, people active at the month
    start; (month, group) pairs with nobody active are absent. Ordered by month, group. ``end``: the last month
    instead of the last exit's (A24)."""
    return monthly_of(_global_series(staff, group, as_of, end), group)


def monthly_of(series: DataFrame, group: str) -> DataFrame:
    x = series.where(F.col("headcount") > 0)
    return x.select(month_label(F.col("month")).alias("month"), group, "headcount").orderBy("month", group)


def headcount_monthly_tenure(staff: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Per spine month with anyone active, headcount in each of the five tenure bands
    (whole days since hire / 30 at the month start, right-closed bands), zeros included.

    Band 0 of the event table carries the total and the series bounds; bands 1-5 the segments.
    One window pass per band (the band table is fixed-size, so the global bound window is
    bounded by 6 × months rows); band-0 rows with total > 0 emit the zero rows of the grid."""
    return tenure_of(spells.band_events(staff), as_of)


def tenure_of(ev: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """``headcount_monthly_tenure`` of band events that exist already."""
    w0 = Window.partitionBy()
    end_default = month_floor(F.to_date(ts_lit(as_of)))
    b0 = F.col("band_no") == 0
    ev = ev.withColumns({
        "lo": F.min(F.when(b0 & (F.col("hire_mark") > 0), F.col("month"))).over(w0),
        "hi": F.coalesce(F.max(F.when(b0 & (F.col("exits") > 0), F.col("month"))).over(w0), end_default),
    })
    x = spells.step_series(ev, ["band_no"], as_of, lo=F.col("lo"), hi=F.col("hi"))
    x = x.where(F.col("lo").isNotNull() & (F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi")))
    grid = F.array(*[F.struct(F.lit(k).alias("b"), F.lit(0).cast("long").alias("hc"), F.lit(1).alias("mark"))
                     for k in range(1, len(TENURE_LABELS) + 1)])
    own = F.array(F.struct(F.col("band_no").alias("b"), F.col("headcount").alias("hc"), F.lit(0).alias("mark")))
    rows = F.when(b0 & (F.col("headcount") > 0), grid).when(~b0, own)
    y = x.select("month", F.inline(rows)).groupBy("b", "month").agg(
        F.sum("hc").alias("headcount"), F.max("mark").alias("mark"))
    labels = F.array(*[F.lit(s) for s in TENURE_LABELS])
    return (
        y.where(F.col("mark") == 1)
        .select(month_label(F.col("month")).alias("month"), F.col("b").alias("band_no"),
                F.element_at(labels, F.col("b")).alias("tenure_band"), F.col("headcount").cast("long").alias("headcount"))
        .orderBy("month", "band_no")
    )


def growth(series: DataFrame, group: str = "department") -> DataFrame:
    """Change against the previous *present* row of the same group (lag over the group's
    month-ordered rows): absolute (null on the first row) and % rounded to 2 (0 on the first row)."""
    w = Window.partitionBy(group).orderBy("month")
    prev = F.lag("headcount").over(w)
    s = series.withColumn("prev_headcount", prev)
    diff = F.col("headcount") - F.col("prev_headcount")
    pct = round_half_even(F.try_divide(diff.cast("double"), F.col("prev_headcount").cast("double")) * 100, 2)
    return s.withColumns({"growth_abs": diff, "growth_pct": F.coalesce(pct, F.lit(0.0))})


def last_months(series: DataFrame, n: int) -> DataFrame:
    """Rows whose month is among the ``n`` latest distinct months of the whole series.
    The cut-off comes from its distinct months (calendar-bounded)."""
    s = series
    months = s.select("month").distinct()
    cut = months.select(F.col("month"), F.dense_rank().over(Window.orderBy(F.desc("month"))).alias("_r")) \
        .where(F.col("_r") == n).select(F.col("month").alias("_cut"))
    lo = months.agg(F.min("month").alias("_min"))
    bound = spells.with_scalars(lo, cut.agg(F.max("_cut").alias("_cut"))).select(
        F.coalesce("_cut", "_min").alias("_cut"))
    return spells.with_scalars(s, bound).where(F.col("month") >= F.col("_cut")).drop("_cut")


def growth_summary(series: DataFrame, group: str = "department", n: int = 12) -> DataFrame:
    """Per group present in the last ``n`` months: first and last headcount of its whole
    series, change, % change (0 when the first is 0), mean absolute and % growth over the last
    ``n`` months. Largest change first."""
    g = spells.materialize(growth(series, group))
    recent = last_months(g, n).groupBy(group).agg(
        round_half_even(F.avg("growth_abs"), 1).alias("avg_growth_abs"),
        round_half_even(F.avg("growth_pct"), 2).alias("avg_growth_pct"),
    )
    ends = g.groupBy(group).agg(
        F.min_by("headcount", "month").alias("first_headcount"),
        F.max_by("headcount", "month").alias("last_headcount"),
    )
    change = F.col("last_headcount") - F.col("first_headcount")
    pct = F.when(F.col("first_headcount") > 0,
                 round_half_even(change / F.col("first_headcount") * 100, 2)).otherwise(F.lit(0.0))
    return (
        ends.join(recent, group)
        .select(group, "first_headcount", "last_headcount", change.alias("change"), pct.alias("change_pct"),
                "avg_growth_abs", "avg_growth_pct")
        .orderBy(F.desc("change"), F.col(group))
    )


def growth_recent(series: DataFrame, group: str = "gender", n: int = 6) -> DataFrame:
    """Over the last ``n`` months, per group: sum of absolute growth and mean % growth
    (mean rounded to 6 decimals for engine-independent results)."""
    r = last_months(growth(series, group), n)
    return r.groupBy(group).agg(
        F.coalesce(F.sum("growth_abs"), F.lit(0)).cast("long").alias("growth_abs_sum"),
        round_half_even(F.avg("growth_pct"), 6).alias("growth_pct_avg"),
    )


def slice_months(series: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """One month ('yyyy-MM' equal), a year (label prefix) or a month of every year (suffix)."""
    if year is not None and month is not None:
        return series.where(F.col("month") == F.lit(f"{year:04d}-{month:02d}"))
    if year is not None:
        return series.where(F.col("month").startswith(f"{year:04d}"))
    if month is not None:
        return series.where(F.col("month").endswith(f"-{month:02d}"))
    return series


def latest_month(series: DataFrame) -> DataFrame:
    """C14: rows of the newest month of a series (checkpointed series, 1-row broadcast bound)."""
    s = spells.materialize(series)
    top = s.agg(F.max("month").alias("_top"))
    return s.join(F.broadcast(top), F.col("month") == F.col("_top")).drop("_top")
