"""Trend and forecast (A23), rule-based alerts (I1, W5, O5) and the Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_AS_OF, months_30
from ..functions.numeric import round_half_even
from ..schema import absent
from . import attrition, cube, spells

# ---- fixed values: thresholds and texts of the reference's rules and report ---------------
RISE_FACTOR = 1.2
MEAN_RATE_LIMIT = 5.0
DEPARTMENT_RATE_LIMIT = 8.0
TENURE_LIMIT = 12
TREND_STEP = 0.1
TREND_UP, TREND_DOWN, TREND_FLAT = "crescente", "decrescente", "estável"
MSG_RISE = ("⚠️ Attrition aumentou significativamente nos últimos meses. "
            "Recomenda-se investigar causas raiz.")
REC_RISE = "Realizar pesquisa de clima organizacional e entrevistas de desligamento."
MSG_MEAN = "⚠️ Attrition médio (%s%%) está acima do benchmark de mercado (3-5%%)."
MSG_DEPT = "🚨 Departamento '%s' apresenta attrition crítico (%s%%)."
REC_DEPT = "Priorizar ações de retenção no departamento %s."
MSG_TENURE = "⚠️ Tenure médio baixo (%s meses). Colaboradores estão saindo muito cedo."
REC_TENURE = "Melhorar processo de onboarding e engajamento nos primeiros meses."
MSG_FEW_MONTHS = "Dados insuficientes para análise preditiva. Necessário histórico de pelo menos 3 meses."
MSG_FORECAST = "Tendência %s identificada. Previsão de attrition para os próximos 3 meses: %s%%, %s%%, %s%%"
REPORT_TITLE = "# 📊 Relatório de Pessoas"
REPORT_SUMMARY = "## Resumo Executivo"
REPORT_MEAN = "- **Attrition Médio**: %s%%"
REPORT_PERIOD = "- **Período Analisado**: %s a %s"
REPORT_ACTIVE = "- **Total de Colaboradores Ativos**: %s"
REPORT_ALERTS = "## 🚨 Alertas Críticos"
REPORT_RECS = "## 💡 Recomendações de Ação"
REPORT_FOOTER = "*Relatório gerado automaticamente.*"
# ---------------------------------------------------------------------------------------------


def _cells(staff: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """One pass over staff for all rules: the cells by department, and the events attrition is told from (none
    without a hire or exit column)."""
    active = F.col("active") if "active" in staff.columns else F.col("exit_date").isNull()
    left = ~F.col("active") if "active" in staff.columns else F.col("exit_date").isNotNull()
    tenure = F.when(left, months_30(F.to_date("exit_date"), F.to_date("hire_date")))
    counts = {"n_active": F.when(active, 1).otherwise(0), "left_m": tenure, "left_k": F.when(tenure.isNotNull(), 1).otherwise(0)}
    cells = spells.materialize(cube.event_cells(staff, ("department",), counts, mode=mode))
    undated = absent(staff, "hire_date") or absent(staff, "exit_date")
    return cells, cells.where(F.lit(False)) if undated else cells


def fmt1(c: Column) -> Column:
    """Text of a value with one decimal, rounded half-even first (Python's formatting rule)."""
    return F.format_string("%.1f", round_half_even(c, 1))


def forecast(history: DataFrame, horizon: int = 3) -> DataFrame:
    """Least-squares line of the monthly total rate on the month index 0..n−1; trend label
    (±0.1 on the slope), the next ``horizon`` values (clipped at 0, 1 decimal), slope (3 decimals)
    and the message. Fewer than 3 months → the message only. One aggregate over the month-grain
    history; the index is the month distance from the first month (the spine is dense)."""
    x = history.withColumn("_m", F.to_date(F.concat(F.col("month"), F.lit("-01"))))
    first = F.min("_m").over(Window.partitionBy())  # month-grain history: bounded by the calendar
    x = x.withColumn("_x", F.months_between(F.col("_m"), first).cast("double"))
    a = x.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("attrition_total", "_x").alias("slope"),
        F.regr_intercept("attrition_total", "_x").alias("intercept"),
    )
    slope = F.coalesce(F.col("slope"), F.lit(0.0))
    intercept = F.col("intercept")
    trend = F.when(slope > TREND_STEP, F.lit(TREND_UP)).when(slope < -TREND_STEP, F.lit(TREND_DOWN)).otherwise(F.lit(TREND_FLAT))
    preds = [slope * (F.col("n") + F.lit(i)) + intercept for i in range(horizon)]
    ok = F.col("n") >= 3
    cols = [F.when(ok, trend).alias("trend"), F.when(ok, round_half_even(slope, 3)).alias("slope")]
    for i, p in enumerate(preds):
        cols.append(F.when(ok, F.greatest(F.lit(0.0), round_half_even(p, 1))).alias(f"forecast_{i + 1}"))
    msg = F.format_string(MSG_FORECAST, trend, *[fmt1(p) for p in preds[:3]])
    cols.append(F.when(ok, msg).otherwise(F.lit(MSG_FEW_MONTHS)).alias("message"))
    return a.select(*cols)


def _history_rules(history: DataFrame) -> DataFrame:
    """Rise over the last three history rows (W5) and mean rate over the benchmark."""
    w = Window.orderBy(F.desc("month"))  # month-grain history: bounded by the calendar
    last3 = history.select("month", "attrition_total", F.row_number().over(w).alias("_r")).where(F.col("_r") <= 3)
    a = last3.agg(
        F.max(F.when(F.col("_r") == 1, F.col("attrition_total"))).alias("r_last"),
        F.max(F.when(F.col("_r") == 3, F.col("attrition_total"))).alias("r_third"),
        F.count(F.lit(1)).alias("k"),
    )
    m = history.agg(F.avg("attrition_total").alias("mean_rate"))
    return spells.with_scalars(a, m)


def insights(staff: DataFrame, as_of: str = DEFAULT_AS_OF, mode: str = "compat") -> DataFrame:
    """Alert and recommendation rows (line_no, kind, rule, subject, value, message) from
    four rules: rising rate, mean rate above 5%, worst department above 8%, mean tenure of
    leavers below 12 months. Rules that do not fire give no rows."""
    cells, dated = _cells(staff, mode)
    return _rules(cells, dated, _history(dated, as_of), as_of)


def _history(dated: DataFrame, as_of: str) -> DataFrame:
    """The monthly history of the cells."""
    return attrition.labelled(attrition.history_of(cube.month_events(dated), (), as_of))


def _rules(cells: DataFrame, dated: DataFrame, hist: DataFrame, as_of: str) -> DataFrame:
    """The rows of ``insights`` over the cells and their history."""
    hr = _history_rules(hist)
    dept = attrition.period_of(cube.month_events(dated, ["department"]), {"": (None, None)}, ["department"], as_of)
    worst = dept.agg(
        F.min_by("department", F.struct((-F.col("attrition_total")).alias("r"), F.col("department").alias("d"))).alias("worst"),
        F.max("attrition_total").alias("worst_rate"),
    )
    ten = cube.row_counts(cells, (), ("left_m", "left_k")).select(
        F.try_divide(F.col("left_m"), F.col("left_k")).alias("tenure"))
    j = spells.with_scalars(spells.with_scalars(hr, worst), ten)
    rise = (F.col("k") >= 3) & (F.col("r_last") > F.col("r_third") * RISE_FACTOR)
    high = F.coalesce(F.col("mean_rate") > MEAN_RATE_LIMIT, F.lit(False))
    crit = F.coalesce(F.col("worst_rate") > DEPARTMENT_RATE_LIMIT, F.lit(False))
    short = F.coalesce(F.col("tenure") < TENURE_LIMIT, F.lit(False))
    nul_s = F.lit(None).cast("string")
    def line(no, kind, rule, subject, value, message, fires):
        return F.struct(F.lit(no).alias("line_no"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"),
                        subject.alias("subject"), value.cast("double").alias("value"),
                        (F.lit(message) if isinstance(message, str) else message).alias("message"), fires.alias("fires"))

    rows = F.array(
        line(1, "alert", "attrition_rising", nul_s, F.col("r_last"), MSG_RISE, rise),
        line(2, "alert", "attrition_above_benchmark", nul_s, F.col("mean_rate"),
             F.format_string(MSG_MEAN, fmt1(F.col("mean_rate"))), high),
        line(3, "alert", "department_critical", F.col("worst"), F.col("worst_rate"),
             F.format_string(MSG_DEPT, F.col("worst"), fmt1(F.col("worst_rate"))), crit),
        line(4, "alert", "short_tenure", nul_s, F.col("tenure"), F.format_string(MSG_TENURE, fmt1(F.col("tenure"))), short),
        line(5, "recommendation", "attrition_rising", nul_s, F.col("r_last"), REC_RISE, rise),
        line(6, "recommendation", "department_critical", F.col("worst"), F.col("worst_rate"),
             F.format_string(REC_DEPT, F.col("worst")), crit),
        line(7, "recommendation", "short_tenure", nul_s, F.col("tenure"), REC_TENURE, short),
    )
    out = j.select(F.inline(rows)).where(F.col("fires"))
    return out.select("line_no", "kind", "rule", "subject", round_half_even(F.col("value"), 6).alias("value"),
                      "message")


def trends(hist: DataFrame) -> DataFrame:
    """The trend of the monthly rate as a row like the alerts' (rule ``attrition_trend``, subject the trend's name, value
    its slope); none with fewer than three months."""
    f = forecast(hist).where(F.col("trend").isNotNull())
    return f.select(F.lit(8).alias("line_no"), F.lit("trend").alias("kind"), F.lit("attrition_trend").alias("rule"),
                    F.col("trend").alias("subject"), F.col("slope").alias("value"), "message")


def insights_with_trends(staff: DataFrame, as_of: str = DEFAULT_AS_OF, mode: str = "compat") -> DataFrame:
    """``insights`` and ``trends`` from one pass over staff."""
    cells, dated = _cells(staff, mode)
    hist = _history(dated, as_of)
    return _rules(cells, dated, hist, as_of).unionByName(trends(hist))


def report_lines(staff: DataFrame, as_of: str = DEFAULT_AS_OF, mode: str = "compat") -> DataFrame:
    """The report as ordered (line_no, text) Markdown lines: summary (mean rate, period,
    active total), alerts, recommendations (numbered), footer. Built from metric rows with
    ``format_string``; the rows are few, ``line_no`` orders them."""
    cells, dated = _cells(staff, mode)
    hist = _history(dated, as_of)
    hs = hist.agg(F.avg("attrition_total").alias("mean_rate"), F.min("month").alias("m0"),
                  F.max("month").alias("m1"), F.count(F.lit(1)).alias("nh"))
    act = cube.row_counts(cells, (), ("n_active",)).select(F.coalesce(F.col("n_active"), F.lit(0)).cast("long").alias("n_active"))
    ins = spells.materialize(_rules(cells, dated, hist, as_of))  # a handful of rows, read twice
    alerts = ins.where(F.col("kind") == "alert").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "message"))).alias("alerts"))
    recs = ins.where(F.col("kind") == "recommendation").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "message"))).alias("recs"))
    # one row holding every metric; checkpointed because three branches read it
    j = spells.materialize(spells.with_scalars(spells.with_scalars(spells.with_scalars(hs, act), alerts), recs))
    has_h = F.col("nh") > 0
    n_al = F.size("alerts")
    n_rc = F.size("recs")
    thousands = F.format_number(F.col("n_active"), 0)  # '4,216': comma thousands separator
    fixed_lines = [
        (10, F.lit(REPORT_TITLE), F.lit(True)), (11, F.lit(""), F.lit(True)),
        (12, F.lit(REPORT_SUMMARY), F.lit(True)), (13, F.lit(""), F.lit(True)),
        (14, F.format_string(REPORT_MEAN, fmt1(F.col("mean_rate"))), has_h),
        (15, F.format_string(REPORT_PERIOD, F.col("m0"), F.col("m1")), has_h),
        (16, F.format_string(REPORT_ACTIVE, thousands), F.lit(True)),
        (17, F.lit(""), F.lit(True)),
    ]
    fixed_lines += [
        (20, F.lit(REPORT_ALERTS), n_al > 0), (21, F.lit(""), n_al > 0), (59, F.lit(""), n_al > 0),
        (60, F.lit(REPORT_RECS), n_rc > 0), (61, F.lit(""), n_rc > 0), (99, F.lit(""), n_rc > 0),
        (100, F.lit("---"), F.lit(True)), (101, F.lit(""), F.lit(True)), (102, F.lit(REPORT_FOOTER), F.lit(True)),
    ]
    structs = [F.struct(F.lit(k).alias("line_no"), t.alias("text"), c.alias("keep")) for k, t, c in fixed_lines]
    base = j.select(F.inline(F.array(*structs))).where(F.col("keep")).select("line_no", "text")
    al = j.select(F.posexplode("alerts").alias("i", "a")).select(
        (F.lit(22) + F.col("i")).alias("line_no"), F.concat(F.lit("- "), F.col("a.message")).alias("text"))
    rc = j.select(F.posexplode("recs").alias("i", "r")).select(
        (F.lit(62) + F.col("i")).alias("line_no"),
        F.format_string("%d. %s", F.col("i") + 1, F.col("r.message")).alias("text"))
    return base.unionByName(al).unionByName(rc)
