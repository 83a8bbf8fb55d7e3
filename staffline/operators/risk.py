"""Explainable attrition-risk model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import (
    PROMOTION_GAP_EDGES, PROMOTION_GAP_LABELS, RISK_EDGES, RISK_LABELS, band_number,
)
from ..functions.dates import DEFAULT_AS_OF, months_30, ts_lit
from ..functions.numeric import round_half_even
from ..functions.text import capitalize_first
from . import spells

# ---- fixed values (rating scores, default weights, reason phrases of the reference) --------
RATING_SCORES = {
    "excepcional": 10,
    "acima do esperado": 7,
    "dentro do esperado": 4,
    "abaixo do esperado": 1,
}
RATING_DEFAULT = 4
DEFAULT_WEIGHTS = {"perf": 0.30, "promo": 0.25, "casa": 0.15, "eq": 0.15, "merito": 0.15}
REASON_LOW_PERFORMANCE = "baixa performance"
REASON_NO_PROMOTION = "muito tempo sem promoção"
REASON_LARGE_TEAM = "gestor com equipe grande"
REASON_NO_MERIT = "sem mérito recente"
REASON_NEW_HIRE = "pouco tempo de casa (fase inicial)"
REASON_NONE = "Perfil estável"
REASON_HIGH = 0.6
REASON_LOW_TENURE = 0.2
HIGH_RISK = 60
# ---------------------------------------------------------------------------------------------

SCORE_INPUTS = {
    "score_perf_inv": "perf_raw",
    "score_promotion": "months_since_promotion",
    "score_tenure": "tenure_months",
    "score_merit": "months_since_merit",
    "score_team": "team_size",
}


def team_size(staff: DataFrame) -> DataFrame:
    """Size of each row's manager's team (rows sharing its manager id), 0 without a manager.
    A per-manager aggregate joined back — a hot manager is combined map-side and, on the join,
    split by AQE's skew handling, instead of one window partition holding the whole team; rows
    without a manager are spread instead of meeting in one null-key partition."""
    if "manager_id" not in staff.columns:
        return staff.withColumn("team_size", F.lit(0).cast("long"))
    teams = (
        staff.where(F.col("manager_id").isNotNull())
        .groupBy(F.col("manager_id").alias("_mgr"))
        .agg(F.count("employee_id").alias("_team"))
    )
    joined = spells.left_join_spread_nulls(staff, teams, "manager_id", "_mgr", spread_by="employee_id")
    return joined.withColumn("team_size", F.coalesce(F.col("_team"), F.lit(0)).cast("long")).drop("_mgr", "_team")


def rating_score(c: Column) -> Column:
    """Lower-cased rating → score, anything else (null included) → the default."""
    low = F.lower(c)
    expr = None
    for k, v in RATING_SCORES.items():
        expr = F.when(low == F.lit(k), F.lit(v)) if expr is None else expr.when(low == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(RATING_DEFAULT)).cast("double")


def risk_features(staff: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Months since promotion and merit (null stays null), team size, rating score."""
    now = F.to_date(ts_lit(as_of))
    df = team_size(staff)
    return df.withColumns({
        "months_since_promotion": months_30(now, F.to_date("last_promotion")),
        "months_since_merit": months_30(now, F.to_date("last_merit")),
        "perf_raw": rating_score(F.col("rating")) if "rating" in df.columns else F.lit(float(RATING_DEFAULT)),
    })


def minmax(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Min-max scaling of several columns to [0, 1]; null (or non-numeric) → 0 before the
    min and max are taken; a constant column scales to 0. All mins and maxes come from one
    global aggregate (partial per task), joined back as a broadcast 1-row table."""
    clean = {src: F.coalesce(F.col(src).try_cast("double"), F.lit(0.0)) for src in set(columns.values())}
    aggs = []
    for src, c in clean.items():
        aggs += [F.min(c).alias(f"_min_{src}"), F.max(c).alias(f"_max_{src}")]
    stats = df.agg(*aggs)
    j = spells.with_scalars(df, stats)
    out = {}
    for name, src in columns.items():
        lo, hi = F.col(f"_min_{src}"), F.col(f"_max_{src}")
        rng = hi - lo
        out[name] = F.when(rng.isNull() | (rng == 0), F.lit(0.0)).otherwise((clean[src] - lo) / rng)
    return j.withColumns(out).drop(*[f"_{m}_{s}" for s in clean for m in ("min", "max")])


def risk_scores(staff: DataFrame, as_of: str = DEFAULT_AS_OF, weights: dict | None = None) -> DataFrame:
    """Five scaled scores and the weighted risk in [0, 100] (weights need not sum to 1)."""
    w = dict(DEFAULT_WEIGHTS, **(weights or {}))
    # the features are read twice (global min/max, then scaling): written once instead of
    # re-running the review and team aggregations; the min/max pass reads its five columns only
    f = risk_features(staff, as_of)
    keep = [c for c in ("employee_id", "name", "department", "role", "rating", "manager_id") if c in f.columns]
    f = spells.materialize(f.select(*keep, "tenure_months", "months_since_promotion", "months_since_merit",
                                    "team_size", "perf_raw"))
    s = minmax(f, SCORE_INPUTS).withColumn("score_perf_inv", F.lit(1.0) - F.col("score_perf_inv"))
    risk = (F.lit(w["perf"]) * F.col("score_perf_inv") + F.lit(w["promo"]) * F.col("score_promotion")
            + F.lit(w["casa"]) * F.col("score_tenure") + F.lit(w["eq"]) * F.col("score_team")
            + F.lit(w["merito"]) * F.col("score_merit")) * F.lit(100.0)
    return s.withColumn("risk", F.least(F.greatest(risk, F.lit(0.0)), F.lit(100.0)))


def risk_reasons(scored: DataFrame) -> DataFrame:
    """The reasons behind a score, natively (no Python UDF): phrases joined by ', ' with the
    first letter upper-cased, or the stable-profile text when none applies."""
    parts = F.concat_ws(
        ", ",
        F.when(F.col("score_perf_inv") > REASON_HIGH, F.lit(REASON_LOW_PERFORMANCE)),
        F.when(F.col("score_promotion") > REASON_HIGH, F.lit(REASON_NO_PROMOTION)),
        F.when(F.col("score_team") > REASON_HIGH, F.lit(REASON_LARGE_TEAM)),
        F.when(F.col("score_merit") > REASON_HIGH, F.lit(REASON_NO_MERIT)),
        F.when(F.col("score_tenure") < REASON_LOW_TENURE, F.lit(REASON_NEW_HIRE)),
    )
    return scored.withColumn("reasons", F.when(parts == "", F.lit(REASON_NONE)).otherwise(capitalize_first(parts)))


def risk_summary(scored: DataFrame) -> DataFrame:
    """Mean risk and % of rows above the high-risk line, both rounded to 1."""
    return scored.agg(
        round_half_even(F.avg("risk"), 1).alias("avg_risk"),
        round_half_even(F.avg((F.col("risk") > HIGH_RISK).cast("double")) * 100, 1).alias("high_risk_pct"),
    )


def _band_rows(scored: DataFrame, band: Column, labels: tuple, value: str) -> DataFrame:
    """Per band aggregates in one pass (conditional aggregates, no join), then one row per band."""
    k = len(labels)
    if value == "share":
        aggs = [F.count_if(band == i).alias(f"_v{i}") for i in range(1, k + 1)] + [F.count_if(band.isNotNull()).alias("_n")]
    else:
        aggs = [F.avg(F.when(band == i, F.col("risk"))).alias(f"_v{i}") for i in range(1, k + 1)]
    a = scored.agg(*aggs)
    if value == "share":
        vals = [F.when(F.col("_n") > 0, F.col(f"_v{i}") / F.col("_n") * 100.0) for i in range(1, k + 1)]
        name = "share_pct"
    else:
        vals = [round_half_even(F.col(f"_v{i}"), 6) for i in range(1, k + 1)]
        name = "avg_risk"
    rows = F.array(*[F.struct(F.lit(i).alias("band_no"), F.lit(labels[i - 1]).alias("band"), vals[i - 1].alias(name))
                     for i in range(1, k + 1)])
    return a.select(F.inline(rows))


def risk_histogram(scored: DataFrame) -> DataFrame:
    """Share of rows per risk band [0,20], (20,40], …, (80,100]; empty bands give 0."""
    band = band_number(F.col("risk"), RISK_EDGES, include_lowest=True)
    return _band_rows(scored, band, RISK_LABELS, "share")


def risk_by_promotion_gap(scored: DataFrame) -> DataFrame:
    """Mean risk per months-since-promotion band (0,3], …, (24,inf); 0 and null fall out;
    an empty band has a null mean."""
    band = band_number(F.col("months_since_promotion"), PROMOTION_GAP_EDGES, include_lowest=False)
    return _band_rows(scored, band, PROMOTION_GAP_LABELS, "mean")


def risk_ranking(scored: DataFrame) -> DataFrame:
    """Every row, highest risk first (ties by employee id), with its reasons."""
    r = risk_reasons(scored) if "reasons" not in scored.columns else scored
    cols = [c for c in ("employee_id", "name", "department", "role", "rating") if c in r.columns]
    return r.select(*cols, "risk", "reasons").orderBy(F.desc("risk"), "employee_id")
