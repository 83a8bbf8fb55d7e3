"""Attrition operators: monthly history (A3), period means (A4, A5), flags (A6), per group (A7),
history means (A17) and period-vs-total comparison (J5)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_AS_OF, date_lit, make_month, month_label
from ..functions.numeric import pct, round_half_even
from ..functions.text import voluntary_flag
from ..schema import absent
from . import spells

RATE_COLUMNS = ("attrition_total", "attrition_vol", "attrition_inv")


def _rates(df: DataFrame) -> DataFrame:
    inv = F.col("exits") - F.col("voluntary")
    return df.withColumns(
        {
            "involuntary": inv,
            "attrition_total": pct(F.col("exits"), F.col("headcount")),
            "attrition_vol": pct(F.col("voluntary"), F.col("headcount")),
            "attrition_inv": pct(inv, F.col("headcount")),
        }
    )


def history_frame(staff: DataFrame, by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF,
                  mode: str = "compat") -> DataFrame:
    """Monthly history with ``month`` as a DATE (internal form of ``attrition_history``)."""
    by = list(by)
    return history_of(spells.month_events(staff, by, mode), by, as_of)


def history_of(ev: DataFrame, by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF, end: str | None = None) -> DataFrame:
    """``history_frame`` of month events that exist already; ``end``: as in ``attrition_history``."""
    if by:
        ev = spells.drop_null_keys(ev, by)
    x = spells.step_series(ev, by, as_of, hi=spells.end_month(end))
    x = x.where(F.col("lo").isNotNull() & (F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi")))
    return _rates(x.drop("lo", "hi"))


def _dated(staff: DataFrame) -> DataFrame:
    """``staff``, or none of its rows if it came without a hire or exit column: rates are then 0."""
    undated = absent(staff, "hire_date") or absent(staff, "exit_date")
    return staff.where(F.lit(False)) if undated else staff


def attrition_history(staff: DataFrame, by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF,
                     mode: str = "compat", end: str | None = None) -> DataFrame:
    """A3: per month of the spine, headcount at the month start, exits in the month, voluntary,
    involuntary and the three rates in %. Months with headcount 0 stay, with rate 0.
    With ``by`` each group gets its own spine bounds (as the reference's per-department subsets).
    ``end`` (A24): the spine's last month instead of the last exit's, so hires after the last exit are seen."""
    staff = _dated(staff)
    by = list(by)
    return labelled(history_of(spells.month_events(staff, by, mode), by, as_of, end), by)


def labelled(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The history with its month as text."""
    return h.select(
        *by, month_label(F.col("month")).alias("month"), "headcount", "exits", "voluntary", "involuntary",
        *RATE_COLUMNS,
    )


def attrition_period(staff: DataFrame, year: int | None = None, month: int | None = None,
                    by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF, mode: str = "compat") -> DataFrame:
    """A4/A5: mean monthly attrition over the months of a period.

    Month list: (year, month) that month; year its 12 months (future ones too); month that month
    in every year seen in hire or exit dates; neither the whole spine. Months whose start
    headcount is 0 are skipped with their exits. Rates are the mean of the monthly rates
    (rounded to 1 decimal, half-even); ``avg_headcount`` is the truncated mean; mean counts are
    rounded to 1 decimal. No usable month → zeros (per group with ``by``; one row overall).
    One pass: month events → one window → conditional aggregates; no spine join.
    """
    staff = _dated(staff)
    by = list(by)
    ev = spells.month_events(staff, by, mode, years=needs_years(year, month))
    return period_of(ev, {"": (year, month)}, by, as_of)


def needs_years(year: int | None, month: int | None) -> bool:
    """Whether the months of a period hang on the calendar years that occur."""
    return year is None and month is not None


def _months(year: int | None, month: int | None) -> tuple[Column | None, Column]:
    """How far a series must reach for a period, and which of its months belong to it."""
    m = F.col("month")
    if year is not None and month is not None:
        target = date_lit(f"{year:04d}-{month:02d}-01")
        return target, m == target
    if year is not None:
        return date_lit(f"{year:04d}-12-01"), F.year(m) == F.lit(year)
    if month is not None:
        return (make_month(F.array_max(F.col("years")), F.lit(month)),
                (F.month(m) == F.lit(month)) & F.array_contains(F.col("years"), F.year(m)))
    return None, (m >= F.col("lo")) & (m <= F.col("hi"))


def period_of(ev: DataFrame, periods: dict[str, tuple[int | None, int | None]], by: Sequence[str] = (),
              as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """``attrition_period`` of month events that exist already, for several periods (name prefix ->
    year, month) at once: all are conditional aggregates of one dense series."""
    by = list(by)
    if by:
        ev = spells.drop_null_keys(ev, by)
    need_years = any(needs_years(*p) for p in periods.values())
    parts = {name: _months(*p) for name, p in periods.items()}
    reach = [r for r, _ in parts.values() if r is not None]
    extend_to = reach[0] if len(reach) == 1 else F.greatest(*reach) if reach else None
    x = _rates(spells.step_series(ev, by, as_of, extend_to=extend_to, years=need_years))
    sums = {"r_total": ("avg", "attrition_total"), "r_vol": ("avg", "attrition_vol"), "r_inv": ("avg", "attrition_inv"),
            "s_hc": ("sum", "headcount"), "s_ex": ("sum", "exits"), "s_vol": ("sum", "voluntary"), "s_inv": ("sum", "involuntary")}
    aggs, out = [], [F.col(b) for b in by]
    for name, (_, cond) in parts.items():
        use = F.col("lo").isNotNull() & cond & (F.col("headcount") > 0)
        aggs += [getattr(F, f)(F.when(use, F.col(c))).alias(name + k) for k, (f, c) in sums.items()]
        aggs.append(F.count_if(use).alias(name + "n"))
        n = F.coalesce(F.col(name + "n"), F.lit(0))
        rate = lambda c, name=name: F.coalesce(round_half_even(F.col(name + c), 1), F.lit(0.0))
        mean = lambda c, name=name, n=n: F.when(n > 0, round_half_even(F.col(name + c) / n, 1)).otherwise(F.lit(0.0))
        out += [
            rate("r_total").alias(name + "attrition_total"), rate("r_vol").alias(name + "attrition_vol"),
            rate("r_inv").alias(name + "attrition_inv"),
            F.when(n > 0, F.floor(F.col(name + "s_hc") / n)).otherwise(F.lit(0)).cast("long").alias(name + "avg_headcount"),
            mean("s_ex").alias(name + "avg_exits"), mean("s_vol").alias(name + "avg_voluntary"),
            mean("s_inv").alias(name + "avg_involuntary"), n.cast("long").alias(name + "months_used"),
        ]
    return x.groupBy(*by).agg(*aggs).select(*out)


def attrition_by_department(staff: DataFrame, as_of: str = DEFAULT_AS_OF, mode: str = "compat",
                           group: str = "department") -> DataFrame:
    """Whole-history attrition of each group's own subset (own spine bounds per group)."""
    return attrition_period(staff, None, None, by=[group], as_of=as_of, mode=mode)


def period_flags(staff: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """With year and month, ``active`` = hired on/before the month's last day and not
    left by then; ``exited_in_period`` = exit inside [first day, last day]. Without both, the
    load-time flags (no exit → active; nobody exited in the period)."""
    if year is not None and month is not None:
        start = date_lit(f"{year:04d}-{month:02d}-01")
        end = F.last_day(start)
        h, e = F.to_date("hire_date"), F.to_date("exit_date")
        active = F.coalesce(h <= end, F.lit(False)) & (e.isNull() | (e > end))
        exited = F.coalesce((e >= start) & (e <= end), F.lit(False))
        return staff.withColumns({"active": active, "exited_in_period": exited})
    if year is None and month is None:
        return staff.withColumns({"active": F.col("exit_date").isNull(), "exited_in_period": F.lit(False)})
    return staff.withColumn("exited_in_period", F.lit(False)) if "active" in staff.columns else staff.withColumns(
        {"active": F.col("exit_date").isNull(), "exited_in_period": F.lit(False)})


def period_flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if(F.col("active")).alias("active"),
        F.count_if(F.col("exited_in_period")).alias("exited"),
    )


def attrition_flagged(flagged: DataFrame, mode: str = "compat") -> DataFrame:
    """Exits flagged in the period ÷ rows flagged active, one aggregate pass."""
    vol = voluntary_flag(flagged, mode)
    a = flagged.agg(
        F.count_if(F.col("active")).alias("a"),
        F.count_if(F.col("exited_in_period")).alias("d"),
        F.count_if(F.col("exited_in_period") & vol).alias("dv"),
    )
    di = F.col("d") - F.col("dv")
    ok = F.col("a") > 0

    def rate(x: Column) -> Column:
        return F.when(ok, round_half_even(x / F.col("a") * 100, 1)).otherwise(F.lit(0.0))

    return a.select(
        rate(F.col("d")).alias("attrition_total"),
        rate(F.col("dv")).alias("attrition_vol"),
        rate(di).alias("attrition_inv"),
        F.when(ok, F.col("a")).otherwise(0).cast("long").alias("active"),
        F.when(ok, F.col("d")).otherwise(0).cast("long").alias("exits"),
        F.when(ok, F.col("dv")).otherwise(0).cast("long").alias("voluntary"),
        F.when(ok, di).otherwise(0).cast("long").alias("involuntary"),
    )


def history_means(history: DataFrame) -> DataFrame:
    """Means over all history rows (zero-headcount months included)."""
    return history.agg(
        F.floor(F.avg("headcount")).cast("long").alias("avg_headcount"),
        F.floor(F.avg("exits")).cast("long").alias("avg_exits"),
        round_half_even(F.avg("attrition_total"), 1).alias("avg_attrition_total"),
        round_half_even(F.avg("attrition_vol"), 1).alias("avg_attrition_vol"),
        round_half_even(F.avg("attrition_inv"), 1).alias("avg_attrition_inv"),
    )


COMPARE_MEASURES = ("attrition_total", "attrition_vol", "attrition_inv",
                    "avg_headcount", "avg_exits", "avg_voluntary", "avg_involuntary")


def attrition_compare(staff: DataFrame, year: int | None, month: int | None, as_of: str = DEFAULT_AS_OF,
                     mode: str = "compat") -> DataFrame:
    """The seven period measures next to the whole-history ones, with differences: both are
    conditional aggregates of one series, so staff is read once."""
    ev = spells.month_events(_dated(staff), (), mode, years=needs_years(year, month))
    j = period_of(ev, {"p_": (year, month), "t_": (None, None)}, as_of=as_of)
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("measure"), F.col(f"p_{c}").cast("double").alias("period"),
                 F.col(f"t_{c}").cast("double").alias("total"))
        for i, c in enumerate(COMPARE_MEASURES)
    ])
    out = j.select(F.inline(rows))
    return out.select("measure", "period", "total", (F.col("period") - F.col("total")).alias("difference"))
