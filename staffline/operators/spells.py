"""Validity intervals → monthly series without a months × rows join (J4, W7, §4.2).

A spell ``[hire, exit)`` is active at month start ``m`` iff ``ceil(hire) <= m < ceil(exit)``, where
``ceil`` maps a date to itself if it is a month start and to the next month start otherwise.
So every spell becomes at most two signed events (+1 at ``ceil(hire)``, −1 at ``ceil(exit)``) and
one exit event at ``trunc(exit)``. Events are summed per (group, month) with a map-side partial
aggregate, so the shuffle carries at most groups × months rows per map task, and a running sum
over the month-grain rows yields the headcount. Work is linear in the number of spells.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.dates import DEFAULT_AS_OF, month_floor, month_sequence, ts_lit
from ..functions.text import voluntary_flag

# Day offsets where a spell moves to the next tenure band: whole days / 30 with right-closed
# bands (0,6], (6,12], (12,24], (24,36], (36,inf) months → first day of each band.
TENURE_BAND_START_DAYS = (0, 181, 361, 721, 1081)


def month_index(d: Column) -> Column:
    """Months since year 0 of a DATE (an int key: cheap to hash, compare and aggregate)."""
    return F.year(d) * 12 + F.month(d) - 1


def ceil_index(d: Column) -> Column:
    """``month_index`` of ``month_ceil(d)``."""
    return month_index(d) + F.when(F.dayofmonth(d) == 1, 0).otherwise(1)


def index_month(i: Column) -> Column:
    """Month start DATE of a month index (applied on month-grain rows only)."""
    return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def _events(projected: DataFrame, by: list[str], structs: list[Column], aggs: list[Column]) -> DataFrame:
    """Unpack per-row event structs (plain column references: all date arithmetic already ran
    in the codegen'd projection) and sum them per (by, month index) with a partial aggregate."""
    return (
        projected.select(*[F.col(b) for b in by], F.inline(F.array(*structs)))
        .where(F.col("mi").isNotNull())
        .groupBy(*by, "mi")
        .agg(*aggs)
        .withColumn("month", index_month(F.col("mi")))
        .drop("mi")
    )


def month_events(staff: DataFrame, by: Sequence[str] = (), mode: str = "compat", years: bool = False,
                 id_col: str | None = None) -> DataFrame:
    """Month-grain change table: (by..., month, delta, exits, voluntary, hire_mark[, year_mark]).

    ``delta`` is the net headcount change at that month start; ``exits``/``voluntary`` count
    exits dated inside the month (from every row with an exit, also spells that never became
    active); ``hire_mark`` is 1 where some hire date ceils to the month (bounds of the series).
    Null group keys are kept here (they matter for global bounds); callers drop them.
    With ``years`` each hire and exit also marks January of its year (``year_mark``), so the set
    of calendar years seen comes out of the same single pass.
    With ``id_col`` only rows with a non-null id count in the headcount (group series count ids).
    """
    by = list(by)
    h = F.to_date("hire_date")
    e = F.to_date("exit_date")
    valid = h.isNotNull() & (e.isNull() | (e > h))
    if id_col is not None:
        valid = valid & F.col(id_col).isNotNull()
    proj = staff.select(
        *[F.col(b) for b in by],
        ceil_index(h).alias("_ch"),
        F.when(valid, 1).otherwise(0).alias("_d"),
        F.when(valid, ceil_index(e)).alias("_ce"),
        month_index(e).alias("_fe"),
        F.when(voluntary_flag(staff, mode), 1).otherwise(0).alias("_v"),
        (F.year(h) * 12).alias("_yh"),
        (F.year(e) * 12).alias("_ye"),
    )
    z, one = F.lit(0), F.lit(1)

    def ev(mi, delta, exits, vol, hire_mark, year_mark=z):
        fields = [mi.alias("mi"), delta.alias("delta"), exits.alias("exits"), vol.alias("voluntary"),
                  hire_mark.alias("hire_mark")]
        if years:
            fields.append(year_mark.alias("year_mark"))
        return F.struct(*fields)

    structs = [
        ev(F.col("_ch"), F.col("_d"), z, z, one),        # hire (+1 when the spell is valid; bound mark always)
        ev(F.col("_ce"), F.lit(-1), z, z, z),            # leaves the headcount at ceil(exit)
        ev(F.col("_fe"), z, one, F.col("_v"), z),        # exit counted in its calendar month
    ]
    if years:
        structs += [ev(F.col("_yh"), z, z, z, z, one), ev(F.col("_ye"), z, z, z, z, one)]
    aggs = [F.sum("delta").alias("delta"), F.sum("exits").alias("exits"), F.sum("voluntary").alias("voluntary"),
            F.max("hire_mark").alias("hire_mark")]
    if years:
        aggs.append(F.max("year_mark").alias("year_mark"))
    return _events(proj, by, structs, aggs)


def band_events(staff: DataFrame, starts: Sequence[int] = TENURE_BAND_START_DAYS,
                id_col: str | None = "employee_id") -> DataFrame:
    """Month-grain change table per tenure band: (band_no, month, delta, exits, voluntary, hire_mark).

    A valid spell enters band 1 at ceil(hire), moves from band k to k+1 at ceil(hire + starts[k])
    while still employed, and leaves its last band at ceil(exit). Each of these is one
    *transition* row (month, from band, to band; 0 = outside), so a spell emits at most
    len(starts) + 1 rows plus one exit mark. Transitions are summed per (month, from, to) with a
    partial aggregate and only then, on month-grain rows, split into per-band deltas.
    Band 0 carries the total headcount (+1 on entering, −1 on leaving) and the marks that fix
    the series bounds: hire months (``hire_mark``, every row) and exit months (``exits``).
    With ``id_col`` only rows with a non-null id are counted in bands 1-5 (the reference counts
    ids per band); band 0 counts every row (months with anyone active).
    """
    h = F.to_date("hire_date")
    e = F.to_date("exit_date")
    spell = h.isNotNull() & (e.isNull() | (e > h))
    counted = spell & F.col(id_col).isNotNull() if id_col is not None and id_col in staff.columns else spell
    n = len(starts)
    # the band a spell is in just before its exit: 1 + number of band starts before the exit
    last_band = sum((F.date_add(h, starts[k]) < e).cast("int") for k in range(1, n)) + F.lit(1)
    cols = [ceil_index(h).alias("_ch"), spell.alias("_sp"), counted.alias("_ct"),
            F.when(spell, ceil_index(e)).alias("_ce"), month_index(e).alias("_fe"),
            F.when(e.isNotNull(), last_band).otherwise(F.lit(0)).alias("_lb")]
    for k in range(1, n):
        st = F.date_add(h, starts[k])
        cols.append(F.when(spell & (e.isNull() | (st < e)), ceil_index(st)).alias(f"_s{k}"))
    proj = staff.select(*cols)
    z, one = F.lit(0), F.lit(1)
    ct = F.col("_ct")

    def tr(mi, frm, to, total, exits=z, hire_mark=z):
        return F.struct(mi.alias("mi"), frm.alias("frm"), to.alias("to"), total.alias("total"),
                        exits.alias("exits"), hire_mark.alias("hire_mark"))

    structs = [
        # enter band 1 (total +1 when the spell is valid); the hire month is a bound mark for every row
        tr(F.col("_ch"), z, F.when(ct, one).otherwise(z), F.when(F.col("_sp"), one).otherwise(z), hire_mark=one),
        # leave the last band at ceil(exit)
        tr(F.col("_ce"), F.when(ct, F.col("_lb")).otherwise(z), z, F.lit(-1)),
        # exit month mark (bounds)
        tr(F.col("_fe"), z, z, z, exits=one),
    ]
    for k in range(1, n):
        structs.append(tr(F.col(f"_s{k}"), F.when(ct, F.lit(k)).otherwise(z), F.when(ct, F.lit(k + 1)).otherwise(z), z))
    trans = (
        proj.select(F.inline(F.array(*structs)))
        .where(F.col("mi").isNotNull() & ((F.col("frm") != F.col("to")) | (F.col("total") != 0)
                                          | (F.col("exits") > 0) | (F.col("hire_mark") > 0)))
        .groupBy("mi", "frm", "to")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("total").alias("total"), F.sum("exits").alias("exits"),
             F.max("hire_mark").alias("hire_mark"))
    )
    return band_deltas(trans)


def band_deltas(trans: DataFrame) -> DataFrame:
    """Per-band month events of summed transitions (mi, frm, to, c, total, exits, hire_mark)."""
    z = F.lit(0)
    # month-grain: each transition group → (band 0 total) + (from band −c) + (to band +c)
    deltas = F.array(
        F.struct(z.alias("band_no"), F.col("total").alias("delta"), F.col("exits").alias("exits"),
                 F.col("hire_mark").alias("hire_mark")),
        F.struct(F.when(F.col("frm") > 0, F.col("frm")).alias("band_no"), (-F.col("c")).alias("delta"),
                 z.alias("exits"), z.alias("hire_mark")),
        F.struct(F.when(F.col("to") > 0, F.col("to")).alias("band_no"), F.col("c").alias("delta"),
                 z.alias("exits"), z.alias("hire_mark")),
    )
    return (
        trans.select("mi", F.inline(deltas))
        .where(F.col("band_no").isNotNull())
        .groupBy("band_no", "mi")
        .agg(F.sum("delta").alias("delta"), F.sum("exits").alias("exits"), F.lit(0).alias("voluntary"),
             F.max("hire_mark").alias("hire_mark"))
        .withColumn("month", index_month(F.col("mi")))
        .drop("mi")
    )


def step_series(events: DataFrame, by: Sequence[str] = (), as_of: str = DEFAULT_AS_OF,
                extend_to: Column | None = None, lo: Column | None = None, hi: Column | None = None,
                years: bool = False) -> DataFrame:
    """Dense monthly series from month-grain events in one window pass (no spine join).

    Per group, ordered by month: the running sum of ``delta`` is the headcount from that event
    month until the next event month, so each event row expands to the months up to the next
    one (``sequence`` + ``explode``); exits stay on their own month. Bounds come from window
    aggregates over the same partition: ``lo``/``hi`` as in ``bounds`` unless given as columns.
    The expansion ends at ``hi`` (or ``greatest(hi, extend_to)``). Rows are month-grain, so the
    window is small even when one group holds most spells.

    Returns (by..., month, headcount, exits, voluntary, lo, hi[, years]).
    """
    by = list(by)
    w_all = Window.partitionBy(*by)
    w_ord = Window.partitionBy(*by).orderBy("month")
    w_run = w_ord.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end_default = month_floor(F.to_date(ts_lit(as_of)))
    lo_c = lo if lo is not None else F.min(F.when(F.col("hire_mark") > 0, F.col("month"))).over(w_all)
    hi_c = hi if hi is not None else F.coalesce(F.max(F.when(F.col("exits") > 0, F.col("month"))).over(w_all),
                                                end_default)
    cols = [*[F.col(b) for b in by], F.col("month"), F.col("exits"), F.col("voluntary"),
            F.sum("delta").over(w_run).cast("long").alias("headcount"),
            F.lead("month").over(w_ord).alias("_next"),
            lo_c.alias("lo"), hi_c.alias("hi")]
    if years:
        cols.append(F.array_sort(F.collect_set(F.when(F.col("year_mark") > 0, F.year("month"))).over(w_all)).alias("years"))
    x = events.select(*cols)
    end = F.col("hi") if extend_to is None else F.greatest(F.col("hi"), extend_to)
    last = F.least(F.coalesce(F.add_months(F.col("_next"), -1), end), end)
    x = x.withColumn("_m", F.explode(month_sequence(F.col("month"), last)))
    first = F.col("_m") == F.col("month")
    return x.select(
        *by, F.col("_m").alias("month"), "headcount",
        F.when(first, F.col("exits")).otherwise(F.lit(0)).cast("long").alias("exits"),
        F.when(first, F.col("voluntary")).otherwise(F.lit(0)).cast("long").alias("voluntary"),
        "lo", "hi", *(["years"] if years else []),
    )


def end_month(end: str | None) -> Column | None:
    """The last month of a series that was given an end, None for the data's own."""
    return None if end is None else month_floor(F.to_date(ts_lit(end)))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of an intermediate that several branches read: a Parquet table in the shared
    folder, so it is made once, a lost executor does not replay it, and each branch reads only
    the columns it needs. ``scratch.scope`` removes it."""
    if getattr(df, "_staffline_written", False):
        return df
    out = scratch.written(df)
    out._staffline_written = True
    return out


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (global bounds, totals, min/max) to every row of
    ``df`` through one scalar subquery (``DataFrame.scalar()``) returning a struct of them: no
    join at all, and the one-row plan runs once, its value a constant inside the main plan.
    ``one_row`` must be a global aggregate (exactly one row)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("v")).scalar()
    out = df.withColumn("__scalars", packed)
    return out.withColumns({c: F.col("__scalars").getField(c) for c in one_row.columns}).drop("__scalars")


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                           spread_by: str) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``left_key = right_key`` (``right`` unique per key), with
    left rows whose key is null spread by the hash of ``spread_by``: they can never match, but hash
    partitioning would otherwise send all of them to one task (a null manager can be a third of
    the table). The salt reads one more column and no others, and takes any value, so its spread
    grows with the table. A hot non-null key is split by AQE's skew-join handling."""
    salt = F.when(F.col(left_key).isNull(), F.xxhash64(spread_by)).otherwise(F.lit(0).cast("long"))
    lj = left.withColumn("__salt", salt)
    # 0 for every right row (keys are not null), written from the data so that the optimizer
    # keeps it as a join key instead of folding it into a filter on the left salt
    rj = right.withColumn("__rsalt", F.when(F.col(right_key).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    cond = (lj[left_key] == rj[right_key]) & (lj["__salt"] == rj["__rsalt"])
    return lj.join(rj, cond, "left").drop("__salt", "__rsalt")


def drop_null_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    cond = None
    for b in by:
        cond = F.col(b).isNotNull() if cond is None else cond & F.col(b).isNotNull()
    return df if cond is None else df.where(cond)
