"""Load-and-prepare steps: date coercion (C2), core fields (C4), latest review (J1, W2), S14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_AS_OF, coerce_timestamp, months_30, order_evidence, ts_lit
from ..schema import REVIEWS_SCHEMA, STAFF_OPTIONAL, STAFF_SCHEMA, conform

STAFF_DATE_COLUMNS = ("hire_date", "exit_date", "last_promotion", "last_merit")


# ---- fixed values: the date range the reference can hold (pandas nanosecond timestamps); ----
# dates outside it become missing there, e.g. a 9999-12-31 "no exit" placeholder.
DATE_RANGE = ("1677-09-22", "2262-04-11")
# ---------------------------------------------------------------------------------------------


def coerce_dates(df: DataFrame, cols=STAFF_DATE_COLUMNS, day_first: bool = False) -> DataFrame:
    """Turn text (or any type) date columns into TIMESTAMP_NTZ; unparseable values become null.

    Columns that are already timestamps are only cast, so Parquet timestamp columns stay
    prunable and pushdown-friendly.
    """
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        t = df.schema[c].dataType.typeName()
        if t in ("timestamp_ntz",):
            continue
        if t in ("timestamp", "date"):
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
        else:
            out = out.withColumn(c, coerce_timestamp(F.col(c), day_first))
    return out


def date_orders(raw: DataFrame, cols=STAFF_DATE_COLUMNS, by: str = "dataset_id", default_day_first: bool = False) -> DataFrame:
    """How each date column of each data set writes its dates, learned from values that have one reading only:
    (by, column, day_first_seen, month_first_seen, day_first, conflict). More evidence wins; none or a tie
    is the default; ``conflict``: both kinds occur. One aggregate, summed inside each task before the shuffle."""
    sums = []
    for c in (present := [c for c in cols if c in raw.columns]):
        d, m = order_evidence(F.col(f"`{c}`"))
        sums += [F.sum(d).alias(f"d_{c}"), F.sum(m).alias(f"m_{c}")]
    seen = raw.groupBy(by).agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("day_first_seen"),
                              F.col(f"m_{c}").alias("month_first_seen")) for c in present])
    d, m = F.col("day_first_seen"), F.col("month_first_seen")
    return seen.select(by, F.inline(rows)).withColumns({
        "day_first": F.when(d != m, d > m).otherwise(F.lit(default_day_first)), "conflict": (d > 0) & (m > 0)})


def coerce_dates_learned(raw: DataFrame, cols=STAFF_DATE_COLUMNS, by: str = "dataset_id", default_day_first: bool = False) -> DataFrame:
    """C2 with the order of day and month as ``date_orders`` finds it for each data set and column. The evidence (one
    row per data set) is joined by data set; a null data set is one of its own."""
    present = [c for c in cols if c in raw.columns and raw.schema[c].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date")]
    if not present:
        return coerce_dates(raw, cols)
    orders = date_orders(raw, present, by, default_day_first).groupBy(F.col(by).alias("__by")).agg(
        *[F.bool_or(F.when(F.col("column") == c, F.col("day_first"))).alias(f"__first_{c}") for c in present])
    both = raw.join(orders, F.col(by).eqNullSafe(F.col("__by")), "left")
    out = both.withColumns({c: coerce_timestamp(F.col(f"`{c}`"), F.coalesce(F.col(f"__first_{c}"), F.lit(default_day_first)))
                            for c in present})
    return coerce_dates(out.drop("__by", *[f"__first_{c}" for c in present]), cols)


def date_findings(raw: DataFrame, cols=STAFF_DATE_COLUMNS, day_first: bool = False,
                  date_range: tuple[str, str] | None = None) -> DataFrame:
    """(column, unparsed, out_of_range): how many non-blank values of each date column no date
    was read from, and how many dates lie outside ``date_range``. One aggregate over ``raw``."""
    lo, hi = (F.expr(f"DATE '{d}'") for d in date_range or DATE_RANGE)
    present = [c for c in cols if c in raw.columns]
    read = coerce_dates(raw.select(*[F.col(c) for c in present], *[F.col(c).cast("string").alias(f"__{c}") for c in present]),
                        present, day_first)
    row = F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.count_if((F.trim(f"__{c}") != "") & F.col(c).isNull()).alias("unparsed"),
        F.count_if(~F.col(c).cast("date").between(lo, hi)).alias("out_of_range")) for c in present])
    return read.agg(row.alias("r")).select(F.inline("r"))


def truncate_days(df: DataFrame, cols=STAFF_DATE_COLUMNS, date_range: tuple[str, str] = DATE_RANGE) -> DataFrame:
    """Cut staff dates to midnight (decision Q2: month starts are then exact day boundaries) and
    null out dates outside ``date_range`` as the reference does (a far-future placeholder is
    "no date", and cannot stretch a monthly series over thousands of years; ``date_findings``
    counts them). NTZ → DATE → NTZ never consults the session time zone."""
    lo, hi = (F.expr(f"DATE '{d}'") for d in date_range)

    def day(c: str):
        d = F.col(c).cast("date")
        return F.when(d.between(lo, hi), d).cast("timestamp_ntz").alias(c, metadata=df.schema[c].metadata)

    return df.withColumns({c: day(c) for c in cols if c in df.columns})


def core_fields(df: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """``active`` (no exit date) and ``tenure_months`` (whole days from hire to ``as_of``, / 30)."""
    return df.withColumns(
        {
            "active": F.col("exit_date").isNull(),
            "tenure_months": months_30(F.to_date(ts_lit(as_of)), F.to_date("hire_date")),
        }
    )


def latest_review(reviews: DataFrame, nulls: str = "last") -> DataFrame:
    """Latest rating per employee.

    Order is (cycle_end, seq) with a null cycle_end sorting after every date (``nulls='last'``,
    the reference's rule: such a review wins), ties broken by the later ``seq``. ``max_by`` is
    aggregated map-side first, so the shuffle carries at most one row per (employee, map task);
    a hot employee never lands whole in one task.
    """
    null_key = F.col("cycle_end").isNull() if nulls == "last" else F.col("cycle_end").isNotNull()
    order = F.struct(null_key.alias("n"), F.col("cycle_end").alias("c"), F.col("seq").alias("s"))
    return (
        reviews.where(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(F.max_by("rating", order).alias("rating"), F.max_by("cycle_end", order).alias("cycle_end"))
    )


def attach_rating(staff: DataFrame, reviews: DataFrame, nulls: str = "last") -> DataFrame:
    """Left join of the latest rating onto staff (an existing rating column is replaced, Q22)."""
    rid, sid = reviews.schema["employee_id"].dataType, staff.schema["employee_id"].dataType
    if rid != sid:  # text ids on one side: compare as text
        reviews = reviews.withColumn("employee_id", F.col("employee_id").cast("string"))
        staff = staff.withColumn("employee_id", F.col("employee_id").cast("string"))
    last = latest_review(reviews, nulls).select("employee_id", "rating")
    base = staff.drop("rating") if "rating" in staff.columns else staff
    return base.join(last, "employee_id", "left").select(*base.columns, "rating")


def prepare_staff(staff: DataFrame, reviews: DataFrame | None = None, as_of: str = DEFAULT_AS_OF,
                  day_first: bool = False, date_range: tuple[str, str] | None = None) -> DataFrame:
    """Conform → coerce dates → cut to days → core fields → latest rating."""
    s = conform(staff, STAFF_SCHEMA, STAFF_OPTIONAL, day_first=day_first)
    s = truncate_days(coerce_dates(s), date_range=date_range or DATE_RANGE)
    s = core_fields(s, as_of)
    if reviews is not None:
        r = conform(reviews, REVIEWS_SCHEMA, day_first=day_first)
        if "seq" not in reviews.columns:
            r = r.withColumn("seq", F.monotonically_increasing_id())
        s = attach_rating(s, r)
    else:
        s = s.withColumn("rating", F.lit(None).cast("string"))
    return s
