"""Single-pass KPIs: tenure at exit (A12), contract mix (A13, O3), monthly exits (A14), basic
KPIs (A15), data-quality report (A16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import absent
from ..functions.dates import DEFAULT_AS_OF, months_30, ts_lit
from ..functions.numeric import round_half_even
from ..functions.text import CLT_VALUE, FEMALE_VALUES, LEADER_PATTERN, MALE_VALUES, contains_any, voluntary_flag
from .headcount import share_of_total


def _active(df: DataFrame):
    return F.col("active") if "active" in df.columns else F.col("exit_date").isNull()


def tenure_at_exit(staff: DataFrame, mode: str = "compat") -> DataFrame:
    """Mean months (whole days / 30) from hire to exit among rows not active, total,
    voluntary and involuntary, rounded to 1. With no voluntary row all three are the total;
    with no row at all, zeros."""
    return tenure_of(_summed(staff, tenure_counts(staff, mode)))


def _summed(staff: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return staff.agg(*[F.sum(c).alias(k) for k, c in counts.items()])


def tenure_counts(staff: DataFrame, mode: str = "compat") -> dict[str, Column]:
    """Per row, what ``tenure_of`` needs the sums of: leavers, their months (m) and how many are known (k),
    in total, voluntary (v) and involuntary (i)."""
    left = ~_active(staff) if "active" in staff.columns else F.lit(True)
    tenure = months_30(F.to_date("exit_date"), F.to_date("hire_date"))
    vol = voluntary_flag(staff, mode)
    flag = lambda c: F.when(c, 1).otherwise(0)
    known = tenure.isNotNull()
    return {"left_n": flag(left), "left_v": flag(left & vol),
            "left_m": F.when(left, tenure), "left_k": flag(left & known),
            "left_mv": F.when(left & vol, tenure), "left_kv": flag(left & vol & known),
            "left_mi": F.when(left & ~vol, tenure), "left_ki": flag(left & ~vol & known)}


def tenure_of(sums: DataFrame) -> DataFrame:
    """``tenure_at_exit`` of the sums of ``tenure_counts``."""
    empty = F.coalesce(F.col("left_n"), F.lit(0)) == 0
    mean = lambda k: round_half_even(F.try_divide(F.col(f"left_m{k}"), F.col(f"left_k{k}")), 1)
    return sums.select(
        F.when(empty, F.lit(0.0)).otherwise(mean("")).alias("tenure_total"),
        F.when(empty, F.lit(0.0)).when(F.col("left_v") > 0, mean("v")).otherwise(mean("")).alias("tenure_vol"),
        F.when(empty, F.lit(0.0)).when(F.col("left_v") > 0, mean("i")).otherwise(mean("")).alias("tenure_inv"),
    )


def contract_mix(staff: DataFrame) -> DataFrame:
    """Active staff per contract type (null types left out), count and % of the counted
    rows rounded to 1, largest first."""
    grouped = (
        staff.where(_active(staff) & F.col("contract_type").isNotNull())
        .groupBy("contract_type")
        .agg(F.count(F.lit(1)).alias("quantity"))
    )
    return mix_of(grouped)


def mix_of(grouped: DataFrame) -> DataFrame:
    return share_of_total(grouped, "quantity", "pct", digits=1).orderBy(F.desc("quantity"), "contract_type")


def contract_top(staff: DataFrame, k: int = 4) -> DataFrame:
    """O3: the ``k`` largest contract types (a top-k report: the limit is the feature)."""
    return contract_mix(staff).orderBy(F.desc("quantity"), "contract_type").limit(k)


def monthly_exits(staff: DataFrame) -> DataFrame:
    """Total exits, months having exits, mean exits per such month (rounded to 1)."""
    per_month = (
        staff.where(F.col("exit_date").isNotNull())
        .groupBy(F.trunc(F.to_date("exit_date"), "MM").alias("m"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return exits_of(per_month)


def exits_of(per_month: DataFrame) -> DataFrame:
    """``monthly_exits`` of the exits by month (``c``, months without any left out)."""
    a = per_month.agg(F.avg("c").alias("avg"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("months"))
    return a.select(
        F.coalesce(round_half_even(F.col("avg"), 1), F.lit(0.0)).alias("avg_exits_per_month"),
        F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("total_exits"),
        F.col("months").cast("long").alias("months_with_exits"),
    )


def basic_kpis(staff: DataFrame) -> DataFrame:
    """Active total; count and % (of all active rows, rounded to 1) of CLT contracts,
    women, men and leaders — one aggregate pass."""
    return basic_of(_summed(staff, basic_counts(staff)))


def basic_counts(staff: DataFrame) -> dict[str, Column]:
    """Per row, what ``basic_of`` needs the sums of."""
    act = _active(staff)
    clt = F.coalesce(F.upper("contract_type") == F.lit(CLT_VALUE), F.lit(False))
    fem = F.coalesce(F.lower("gender").isin(*FEMALE_VALUES), F.lit(False))
    masc = F.coalesce(F.lower("gender").isin(*MALE_VALUES), F.lit(False))
    lead = contains_any(F.col("role"), LEADER_PATTERN)
    flag = lambda c: F.when(act & c, 1).otherwise(0)
    return {"total_active": flag(F.lit(True)), "clt_count": flag(clt), "female_count": flag(fem), "male_count": flag(masc),
            "leader_count": flag(lead)}


BASIC = ("total_active", "clt_count", "female_count", "male_count", "leader_count")


def basic_of(sums: DataFrame) -> DataFrame:
    """``basic_kpis`` of the sums of ``basic_counts``."""
    a = sums.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in BASIC])
    n = F.col("total_active")

    def share(c: str):
        return F.when(n > 0, round_half_even(F.col(c) / n * 100, 1)).otherwise(F.lit(0.0))

    return a.select(
        "total_active", "clt_count", share("clt_count").alias("clt_pct"),
        "female_count", share("female_count").alias("female_pct"),
        "male_count", share("male_count").alias("male_pct"),
        "leader_count", share("leader_count").alias("leader_pct"),
    )


def quality_report(staff: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """(severity, rule, value) rows from one aggregate: errors (empty table, no hire column,
    exit before hire), warnings (no exit column, null hire, hire after ``as_of``), then the
    statistics rows (total, active, exited). Rules that do not fire are absent; an empty table gives only its error row."""
    h, e = F.col("hire_date"), F.col("exit_date")
    act = _active(staff)
    a = staff.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(h.isNull()).alias("null_hire"),
        F.count_if(h > ts_lit(as_of)).alias("future_hire"),
        F.count_if(e.isNotNull() & h.isNotNull() & (e < h)).alias("exit_before_hire"),
        F.count_if(act).alias("active"),
        F.count_if(~act).alias("exited"),
    )
    n = F.col("total")
    no_hire, no_exit = absent(staff, "hire_date"), absent(staff, "exit_date")

    def rule(order, severity, name, value, fires):
        return F.struct(F.lit(order).alias("ord"), F.lit(severity).alias("severity"), F.lit(name).alias("rule"),
                        value.cast("long").alias("value"), fires.alias("fires"))

    rows = F.array(
        rule(1, "error", "empty_table", F.lit(0), n == 0),
        rule(1, "error", "missing_hire_column", F.lit(0), F.lit(no_hire) & (n > 0)),
        rule(2, "warning", "missing_exit_column", F.lit(0), F.lit(no_exit) & (n > 0)),
        rule(2, "error", "exit_before_hire", F.col("exit_before_hire"), (n > 0) & (F.col("exit_before_hire") > 0)),
        rule(3, "warning", "null_hire_date", F.col("null_hire"), (n > 0) & (F.col("null_hire") > 0) & F.lit(not no_hire)),
        rule(4, "warning", "future_hire_date", F.col("future_hire"), (n > 0) & (F.col("future_hire") > 0)),
        rule(5, "stat", "total_rows", n, n > 0),
        rule(6, "stat", "active", F.col("active"), n > 0),
        rule(7, "stat", "exited", F.col("exited"), n > 0),
    )
    return a.select(F.inline(rows)).where(F.col("fires")).select("severity", "rule", "value")
