"""Registered queries over the test tables: name → callable(spark, sf_dir) → DataFrame.

Every query reads the whole test tables (through the staff/reviews mapping of FIXTURES.md) and
evaluates at the fixed instant ``AS_OF``. Period parameters are fixed per query (June 2000,
year 2000, March of every year) so that Spark and the DuckDB oracle answer the same question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixture, scratch
from .operators import (attrition, facets, filters, headcount, insights, kpis, name_index, prepare, risk, spells,
                        summaries)
from .plans import bundles
from .schema import STAFF_SCHEMA, schema_report
from .sources import store, tables

AS_OF = fixture.AS_OF
YEAR, MONTH, ONLY_MONTH = 2000, 6, 3


def staff(spark: SparkSession, sf_dir: str, with_rating: bool = False) -> DataFrame:
    reviews = fixture.reviews(spark, sf_dir) if with_rating else None
    return prepare.prepare_staff(fixture.staff(spark, sf_dir), reviews, AS_OF)


def dates_as_text(df: DataFrame) -> DataFrame:
    """Timestamps as 'yyyy-MM-dd' text in row-level outputs (engine-neutral comparison)."""
    return df.select(*[
        F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)) else F.col(f.name)
        for f in df.schema.fields
    ])


# ---- attrition --------------------------------------------------------------------------------
def q_attrition_history(spark, sf_dir):
    return attrition.attrition_history(staff(spark, sf_dir), as_of=AS_OF)


def q_attrition_history_by_department(spark, sf_dir):
    """A3 with ``by``: each department's own monthly history on its own spine."""
    return attrition.attrition_history(staff(spark, sf_dir), by=["department"], as_of=AS_OF)


def q_period_label(spark, sf_dir):
    """Period texts for every month of the history spine: month/year, year and month-only."""
    from .functions.dates import period_label

    h = attrition.attrition_history(staff(spark, sf_dir), as_of=AS_OF).select("month")
    y = F.substring("month", 1, 4).cast("int")
    m = F.substring("month", 6, 2).cast("int")
    return h.select("month", period_label(y, m).alias("label_month_year"), period_label(y, None).alias("label_year"),
                    period_label(None, m).alias("label_month"), period_label(None, None).alias("label_all"))


def q_attrition_history_means(spark, sf_dir):
    return attrition.history_means(attrition.attrition_history(staff(spark, sf_dir), as_of=AS_OF))


def q_attrition_period_month(spark, sf_dir):
    return attrition.attrition_period(staff(spark, sf_dir), YEAR, MONTH, as_of=AS_OF)


def q_attrition_period_year(spark, sf_dir):
    return attrition.attrition_period(staff(spark, sf_dir), YEAR, None, as_of=AS_OF)


def q_attrition_period_month_all_years(spark, sf_dir):
    return attrition.attrition_period(staff(spark, sf_dir), None, ONLY_MONTH, as_of=AS_OF)


def q_attrition_period_all(spark, sf_dir):
    return attrition.attrition_period(staff(spark, sf_dir), None, None, as_of=AS_OF)


def q_attrition_flagged(spark, sf_dir):
    return attrition.attrition_flagged(attrition.period_flags(staff(spark, sf_dir), YEAR, MONTH))


def q_period_flags(spark, sf_dir):
    return attrition.period_flag_counts(attrition.period_flags(staff(spark, sf_dir), YEAR, MONTH))


def q_attrition_by_department(spark, sf_dir):
    return attrition.attrition_by_department(staff(spark, sf_dir), as_of=AS_OF)


def q_attrition_compare(spark, sf_dir):
    return attrition.attrition_compare(staff(spark, sf_dir), YEAR, MONTH, as_of=AS_OF)


# ---- headcount -------------------------------------------------------------------------------
def q_headcount_at(spark, sf_dir):
    at = headcount.reference_date(YEAR, MONTH, AS_OF, anchor="end")
    return headcount.headcount_at(staff(spark, sf_dir), "department", at)


def q_headcount_at_month_start(spark, sf_dir):
    """A2 with the REST anchor: a (year, month) period is measured at its first day."""
    at = headcount.reference_date(YEAR, MONTH, AS_OF, anchor="start")
    return headcount.headcount_at(staff(spark, sf_dir), "department", at)


def q_headcount_gender_at(spark, sf_dir):
    return headcount.headcount_at(staff(spark, sf_dir), "gender", AS_OF)


def q_headcount_compare(spark, sf_dir):
    return headcount.headcount_compare(staff(spark, sf_dir), YEAR, MONTH, "department", AS_OF)


def q_headcount_monthly(spark, sf_dir):
    return headcount.headcount_monthly(staff(spark, sf_dir), "department", AS_OF)


def q_headcount_monthly_gender(spark, sf_dir):
    return headcount.headcount_monthly(staff(spark, sf_dir), "gender", AS_OF)


def q_headcount_monthly_rating(spark, sf_dir):
    return headcount.headcount_monthly(staff(spark, sf_dir, with_rating=True), "rating", AS_OF)


def q_headcount_monthly_tenure(spark, sf_dir):
    return headcount.headcount_monthly_tenure(staff(spark, sf_dir), AS_OF)


def q_headcount_growth(spark, sf_dir):
    return headcount.growth(q_headcount_monthly(spark, sf_dir), "department")


def q_growth_summary(spark, sf_dir):
    return headcount.growth_summary(q_headcount_monthly(spark, sf_dir), "department", 12)


def q_growth_gender_recent(spark, sf_dir):
    return headcount.growth_recent(q_headcount_monthly_gender(spark, sf_dir), "gender", 6)


def q_headcount_slice(spark, sf_dir):
    return headcount.slice_months(q_headcount_monthly(spark, sf_dir), year=YEAR)


def q_tenure_band_latest(spark, sf_dir):
    return headcount.latest_month(q_headcount_monthly_tenure(spark, sf_dir))


def q_rating_latest(spark, sf_dir):
    return headcount.latest_month(q_headcount_monthly_rating(spark, sf_dir))


def q_headcount_growth_recent(spark, sf_dir):
    return headcount.last_months(q_headcount_growth(spark, sf_dir), 12)


# ---- single-pass KPIs ------------------------------------------------------------------------
def q_tenure_at_exit(spark, sf_dir):
    return kpis.tenure_at_exit(staff(spark, sf_dir))


def q_contract_mix(spark, sf_dir):
    return kpis.contract_mix(staff(spark, sf_dir))


def q_contract_top4(spark, sf_dir):
    return kpis.contract_top(staff(spark, sf_dir), 4)


def q_monthly_exits(spark, sf_dir):
    return kpis.monthly_exits(staff(spark, sf_dir))


def q_basic_kpis(spark, sf_dir):
    return kpis.basic_kpis(staff(spark, sf_dir))


def q_quality_report(spark, sf_dir):
    return kpis.quality_report(staff(spark, sf_dir), AS_OF)


# ---- preparation -----------------------------------------------------------------------------
def q_latest_review(spark, sf_dir):
    return prepare.latest_review(fixture.reviews(spark, sf_dir)).select("employee_id", "rating")


def q_prepare_staff(spark, sf_dir):
    return dates_as_text(staff(spark, sf_dir, with_rating=True))


def q_core_fields(spark, sf_dir):
    return staff(spark, sf_dir).select("employee_id", "active", "tenure_months")


def q_coerce_dates(spark, sf_dir):
    """Dates written out as text in three formats (and an unparseable text for a missing exit),
    then coerced back."""
    s = fixture.staff(spark, sf_dir)
    k = F.col("employee_id") % 3
    hire_txt = (F.when(k == 0, F.date_format("hire_date", "yyyy-MM-dd"))
                .when(k == 1, F.date_format("hire_date", "dd/MM/yyyy"))
                .otherwise(F.date_format("hire_date", "yyyy-MM-dd HH:mm:ss")))
    exit_txt = F.coalesce(F.date_format("exit_date", "dd/MM/yyyy"), F.lit("abc"))
    txt = s.select("employee_id", hire_txt.alias("hire_date"), exit_txt.alias("exit_date"))
    return dates_as_text(prepare.coerce_dates(txt, ("hire_date", "exit_date"), day_first=True))


# ---- risk ------------------------------------------------------------------------------------
def _scored(spark, sf_dir):
    return risk.risk_scores(staff(spark, sf_dir, with_rating=True), AS_OF)


def q_team_size(spark, sf_dir):
    return risk.team_size(staff(spark, sf_dir)).select("employee_id", "manager_id", "team_size")


def q_risk_features(spark, sf_dir):
    return risk.risk_features(staff(spark, sf_dir, with_rating=True), AS_OF).select(
        "employee_id", "months_since_promotion", "months_since_merit", "team_size", "perf_raw", "tenure_months")


def q_minmax_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("employee_id", "score_perf_inv", "score_promotion", "score_tenure",
                                         "score_merit", "score_team")


def q_risk_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("employee_id", "risk")


def q_risk_reasons(spark, sf_dir):
    return risk.risk_reasons(_scored(spark, sf_dir)).select("employee_id", "reasons")


def q_risk_summary(spark, sf_dir):
    return risk.risk_summary(_scored(spark, sf_dir))


def q_risk_histogram(spark, sf_dir):
    return risk.risk_histogram(_scored(spark, sf_dir))


def q_risk_by_promotion_gap(spark, sf_dir):
    return risk.risk_by_promotion_gap(_scored(spark, sf_dir))


def q_risk_ranking(spark, sf_dir):
    return risk.risk_ranking(_scored(spark, sf_dir))


# ---- forecast, alerts, report ----------------------------------------------------------------
def q_attrition_forecast(spark, sf_dir):
    return insights.forecast(q_attrition_history(spark, sf_dir))


def q_insights(spark, sf_dir):
    return insights.insights(staff(spark, sf_dir), AS_OF)


def q_report_lines(spark, sf_dir):
    return insights.report_lines(staff(spark, sf_dir), AS_OF)


def q_overview(spark, sf_dir):
    return bundles.overview(staff(spark, sf_dir), YEAR, MONTH, AS_OF)


def q_insights_with_trends(spark, sf_dir):
    return insights.insights_with_trends(staff(spark, sf_dir), AS_OF)


def q_report_file(spark, sf_dir):
    """The report written as one text file and read back: its lines and how often each stands in it."""
    path = f"{bundles.store_root(spark)}/report"
    tables.write_report(q_report_lines(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count("*").alias("lines"))


def q_month_numbers(spark, sf_dir):
    """Month names of the history's months, and the numbers read back from them."""
    from .functions.dates import month_name, month_number

    h = attrition.attrition_history(staff(spark, sf_dir), as_of=AS_OF).select("month")
    name = month_name(F.substring("month", 6, 2).cast("int"))
    return h.select("month", name.alias("name"), month_number(name).cast("long").alias("number"))


def q_attrition_history_until(spark, sf_dir):
    """The history up to a given month, beyond the last exit."""
    return attrition.attrition_history(staff(spark, sf_dir), as_of=AS_OF, end="2002-06-01 00:00:00")


def q_headcount_monthly_until(spark, sf_dir):
    return headcount.headcount_monthly(staff(spark, sf_dir), "department", AS_OF, end="2002-06-01 00:00:00")


def q_period_flags_default(spark, sf_dir):
    """C11: no period at all, and a year alone (which leaves the flags of loading)."""
    s = staff(spark, sf_dir)
    flagged = lambda *p: attrition.period_flag_counts(attrition.period_flags(s, *p))
    return (flagged().select(F.lit("none").alias("period"), "active", "exited")
            .unionByName(flagged(YEAR).select(F.lit("year").alias("period"), "active", "exited")))


# ---- series from stored summaries -------------------------------------------------------------
def _summaries(spark, sf_dir) -> str:
    """Two halves of all staff saved with their summaries; one half is saved wrongly first, and a third data set is
    saved and deleted."""
    root, s = bundles.store_root(spark), spells.materialize(staff(spark, sf_dir))
    half = lambda i: s.where(F.col("employee_id") % 2 == i)
    save = lambda d, rows, n: summaries.save_with_summary(
        spark, root, "owner-1", d, {"staff": rows}, d, f"{d}.xlsx", f"2001-12-0{n} 00:00:00")
    save("odd", half(0), 1)
    save("even", half(0), 2)
    save("extra", s, 3)
    store.delete_dataset(spark, root, "extra", "2001-12-04 00:00:00", "owner-1")
    save("odd", half(1), 5)
    return root


def q_history_from_summaries(spark, sf_dir):
    return summaries.history(spark, _summaries(spark, sf_dir), "owner-1", as_of=AS_OF)


def q_headcount_from_summaries(spark, sf_dir):
    return summaries.headcount_monthly(spark, _summaries(spark, sf_dir), "owner-1", as_of=AS_OF)


def q_prepare_staff_cached(spark, sf_dir):
    """The table that a second preparation of the same files reads."""
    scratch.cached(staff(spark, sf_dir))
    return scratch.cached(staff(spark, sf_dir)).select("employee_id", "department", "active", "tenure_months")


# ---- filters ---------------------------------------------------------------------------------
def q_facet_values(spark, sf_dir):
    return filters.facet_values(staff(spark, sf_dir), "department")


def q_staff_filtered(spark, sf_dir):
    df = filters.filter_staff(staff(spark, sf_dir), company="NATION_1", department=["BUILDING", "MACHINERY"],
                              role=filters.ALL, contract_type=["CLT", "PJ"])
    return df.select("employee_id", "name", "company", "department", "role", "contract_type")


def q_staff_filtered_count(spark, sf_dir):
    df = filters.filter_staff(staff(spark, sf_dir), company="NATION_1", department=["BUILDING", "MACHINERY"],
                              role=filters.ALL, contract_type=["CLT", "PJ"])
    return filters.row_count(df)


def q_name_search(spark, sf_dir):
    return filters.name_search(staff(spark, sf_dir), "CUSTOMER#00000012").select("employee_id", "name")


PICKS = {"company": "NATION_1", "department": ["BUILDING", "MACHINERY"], "role": filters.ALL, "contract_type": ["CLT", "PJ"]}


def q_facets_cascade(spark, sf_dir):
    """Options and counts of all pick lists, each under those before it."""
    return facets.facet_options(staff(spark, sf_dir), PICKS)


def q_facets_others(spark, sf_dir):
    """The same, each under all others."""
    return facets.facet_options(staff(spark, sf_dir), PICKS, cascade=False)


def _by_manager_name(spark, sf_dir):
    named = F.concat(F.lit("G"), F.col("manager_id") % 10)
    raw = fixture.staff(spark, sf_dir).withColumn("gestor", named).drop("manager_id")
    return prepare.prepare_staff(raw, None, AS_OF)


def q_staff_of_named_managers(spark, sf_dir):
    """Staff that came without manager ids: the pick reads the manager's name instead."""
    return facets.filtered(_by_manager_name(spark, sf_dir), {"manager": ["G1", "G7"]}).select("employee_id", "manager_name")


def q_facets_of_named_managers(spark, sf_dir):
    return facets.facet_options(_by_manager_name(spark, sf_dir), {"department": ["BUILDING"]}, ("department", "manager"))


def q_name_search_indexed(spark, sf_dir):
    """The name search over an index stored beside the data set."""
    root, s = bundles.store_root(spark), staff(spark, sf_dir).select("employee_id", "name")
    index = lambda stored: name_index.build_index(stored["staff"])
    store.save_dataset(spark, root, "owner-1", "ds-a", {"staff": s, "name_index": index}, "a", "a.xlsx", "2001-12-01 00:00:00")
    found = store.load_dataset(spark, root, "ds-a", "owner-1")
    return name_index.search(found["staff"], found["name_index"], "customer#0*12")


def q_available_years(spark, sf_dir):
    return filters.available_years(staff(spark, sf_dir))


def q_hires_in_period(spark, sf_dir):
    return dates_as_text(filters.hires_in_period(staff(spark, sf_dir), YEAR, MONTH).select("employee_id", "hire_date"))


def q_table_profile(spark, sf_dir):
    return filters.table_profile(fixture.staff(spark, sf_dir), "staff")


def q_table_preview(spark, sf_dir):
    """The first five rows of the staff table (by id: a preview is the feature)."""
    return dates_as_text(fixture.staff(spark, sf_dir).orderBy("employee_id").limit(5))


def q_schema_report(spark, sf_dir):
    return schema_report(spark, fixture.staff(spark, sf_dir), STAFF_SCHEMA, "staff")


# ---- dataset store ---------------------------------------------------------------------------
DEPARTMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _departments(spark, sf_dir) -> list[tuple[str, DataFrame]]:
    """The whole staff table as (name, rows) by department: the listed ones, then the rest (null
    included) if there is any."""
    s = spells.materialize(fixture.staff(spark, sf_dir))
    listed = [(dept.lower(), s.where(F.col("department") == dept)) for dept in DEPARTMENTS]
    rest = s.where(~F.coalesce(F.col("department").isin(*DEPARTMENTS), F.lit(False)))
    return listed if rest.isEmpty() else [*listed, ("other", rest)]


def _save_department(spark, root, i, name, rows, at) -> None:
    store.save_dataset(spark, root, "owner-1", f"ds-{i}", {"staff": rows}, name, f"{name}.xlsx", at)


def _store_departments(spark, sf_dir) -> str:
    """The whole staff table as one dataset per department, each saved and registered."""
    root = bundles.store_root(spark)
    for i, (name, rows) in enumerate(_departments(spark, sf_dir)):
        _save_department(spark, root, i, name, rows, f"2001-12-0{i + 1} 00:00:00")
    return root


def q_dataset_roundtrip(spark, sf_dir):
    """Two datasets of the whole staff table; the second under another owner."""
    root = bundles.store_root(spark)
    for owner in ("owner-1", "owner-2"):
        store.save_dataset(spark, root, owner, "ds-a", {"staff": fixture.staff(spark, sf_dir)}, "a", "a.xlsx", "2001-12-01 00:00:00")
    return dates_as_text(store.read_dataset(spark, root, "staff", "ds-a", "owner-1"))


def q_dataset_catalog(spark, sf_dir):
    root = _store_departments(spark, sf_dir)
    return store.list_datasets(spark, root, "owner-1").select("dataset_id", "name", "file_name", "rows")


def q_dataset_delete(spark, sf_dir):
    root = _store_departments(spark, sf_dir)
    store.delete_dataset(spark, root, "ds-0", "2001-12-08 00:00:00", "owner-1")
    return store.list_datasets(spark, root, "owner-1").select("dataset_id", "name", "file_name", "rows")


def q_dataset_resaved(spark, sf_dir):
    """Saved, deleted and saved again: every dataset is there once, with its rows as read back."""
    root = bundles.store_root(spark)
    parts, read = _departments(spark, sf_dir), None
    for i, (name, rows) in enumerate(parts):
        _save_department(spark, root, i, name, rows, f"2001-12-0{i + 1} 00:00:00")
    for i, (name, rows) in enumerate(parts):
        store.delete_dataset(spark, root, f"ds-{i}", "2001-12-08 00:00:00", "owner-1")
        _save_department(spark, root, i, name, rows, "2001-12-09 00:00:00")
        back = store.read_dataset(spark, root, "staff", f"ds-{i}", "owner-1").agg(F.count("*").alias("rows"))
        back = back.select(F.lit(f"ds-{i}").alias("dataset_id"), "rows")
        read = back if read is None else read.unionByName(back)
    listed = store.list_datasets(spark, root, "owner-1").select("dataset_id", "name", "file_name")
    return listed.join(read, "dataset_id", "left").select("dataset_id", "name", "file_name", "rows")


def q_save_analysis(spark, sf_dir):
    """The history stored as self-describing rows and read back into typed columns."""
    root = bundles.store_root(spark)
    history = q_attrition_history(spark, sf_dir)
    tables.save_result(history, root, "ds-a", "attrition_history", "2001-12-01 00:00:00")
    back = tables.read_results(spark, root, "ds-a", "attrition_history")
    fields = {f.name: (f"$.{f.name}", f.dataType.simpleString()) for f in history.schema.fields}
    return tables.result_fields(back, fields).select("kind", *fields)


def q_saved_results(spark, sf_dir):
    """Three kinds of results in one table, one measure of each read by its path."""
    root, at = bundles.store_root(spark), "2001-12-01 00:00:00"
    tables.save_result(q_attrition_history(spark, sf_dir), root, "ds-a", "attrition_history", at)
    tables.save_result(q_contract_mix(spark, sf_dir), root, "ds-a", "contract_mix", at)
    tables.save_result(q_basic_kpis(spark, sf_dir), root, "ds-a", "basic_kpis", at)
    read = tables.result_fields(tables.read_results(spark, root, "ds-a"), {
        "exits": ("$.exits", "bigint"), "quantity": ("$.quantity", "bigint"), "leaders": ("$.leader_count", "bigint")})
    return read.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("exits").alias("exits"),
                                    F.sum("quantity").alias("quantity"), F.sum("leaders").alias("leaders"))


def q_dataset_tables(spark, sf_dir):
    """Staff and reviews as one data set, read and saved again as its next version; people reviewed by department."""
    root, at = bundles.store_root(spark), "2001-12-0%d 00:00:00"
    save = lambda ts, n: store.save_dataset(spark, root, "owner-1", "ds (a)/ção", ts, "a", "a.xlsx", at % n)
    save({"staff": fixture.staff(spark, sf_dir), "reviews": fixture.reviews(spark, sf_dir)}, 1)
    save(store.load_dataset(spark, root, "ds (a)/ção", "owner-1"), 2)
    found = store.load_dataset(spark, root, "ds (a)/ção", "owner-1")
    reviewed = found["reviews"].groupBy("employee_id").agg(F.count("*").alias("n"))
    return (found["staff"].join(reviewed, "employee_id", "left").groupBy("department")
            .agg(F.count("*").alias("people"), F.count("n").alias("reviewed"), F.sum("n").alias("reviews")))


def q_dataset_versions(spark, sf_dir):
    """Two versions of one data set, the log folded in between: both are readable, the newest is what a reader gets."""
    root = bundles.store_root(spark)
    people = fixture.staff(spark, sf_dir)
    first = store.save_dataset(spark, root, "owner-1", "ds-a", {"staff": people}, "a", "a.xlsx", "2001-12-01 00:00:00")
    store.compact(spark, root)
    left = people.where("exit_date IS NOT NULL")
    store.save_dataset(spark, root, "owner-1", "ds-a", {"staff": left}, "a", "a.xlsx", "2001-12-02 00:00:00")
    by = lambda df, c: df.groupBy("department").agg(F.count("*").alias(c))
    old = store.load_dataset(spark, root, "ds-a", "owner-1", first)["staff"]
    return by(old, "first_rows").join(by(store.read_dataset(spark, root, "staff", "ds-a", "owner-1"), "newest_rows"), "department", "left")


def q_dataset_vacuum(spark, sf_dir):
    """All staff rows on storage by department after one data set was deleted and the store vacuumed."""
    root = _store_departments(spark, sf_dir)
    store.delete_dataset(spark, root, "ds-0", "2001-12-08 00:00:00", "owner-1")
    store.vacuum(spark, root, "2001-12-09 00:00:00")
    on_disk = spark.read.schema("department STRING").parquet(f"{root}/data/*/*/staff")
    return on_disk.groupBy("department").agg(F.count("*").alias("rows"))


# ---- input variants --------------------------------------------------------------------------
def _as_exported(spark, sf_dir) -> DataFrame:
    """All staff rows as a spreadsheet export has them: text ids of three forms, hire dates spelled in
    five ways."""
    s = fixture.staff(spark, sf_dir)
    k, h = F.col("employee_id"), F.col("hire_date")
    text = lambda f: F.date_format(h, f)
    return s.select(
        F.when(k % 3 == 0, F.concat(F.lit("A-"), k)).when(k % 3 == 1, F.lpad(k.cast("string"), 10, "0"))
        .otherwise(F.concat(F.lit(" "), k, F.lit(".0 "))).alias(" Matricula "),
        F.when(k % 5 == 0, text("M/d/yyyy")).when(k % 5 == 1, text("yyyy-MM-dd HH:mm"))
        .when(k % 5 == 2, text("yyyyMMdd")).when(k % 5 == 3, F.concat(text("yyyy-MM-dd"), F.lit("T00:00:00.125Z")))
        .otherwise(F.lit("n/a")).alias("data de admissão"), "department")


def q_text_ids_and_dates(spark, sf_dir):
    s = prepare.prepare_staff(_as_exported(spark, sf_dir), None, AS_OF)
    return dates_as_text(s.select("employee_id", "hire_date", "department"))


def q_date_findings(spark, sf_dir):
    raw = _as_exported(spark, sf_dir).withColumnRenamed("data de admissão", "hire_date")
    return prepare.date_findings(raw, ("hire_date",), date_range=("1996-01-01", "2262-04-11"))


def _two_exports(spark, sf_dir) -> DataFrame:
    """All staff as two exports, one with the day first and one with the month first."""
    s = fixture.staff(spark, sf_dir)
    odd = F.col("employee_id") % 2 == 1
    text = lambda c: F.when(odd, F.date_format(c, "dd/MM/yyyy")).otherwise(F.date_format(c, "MM/dd/yyyy"))
    return s.select(F.when(odd, F.lit("day")).otherwise(F.lit("month")).alias("dataset_id"), "employee_id",
                    text("hire_date").alias("hire_date"), text("exit_date").alias("exit_date"))


def q_learned_dates(spark, sf_dir):
    return dates_as_text(prepare.coerce_dates_learned(_two_exports(spark, sf_dir)))


def q_date_orders(spark, sf_dir):
    return prepare.date_orders(_two_exports(spark, sf_dir))


def q_mixed_exit_types(spark, sf_dir):
    """All staff as two data sets, one with an exit type column and one without."""
    s = staff(spark, sf_dir)
    odd = F.col("employee_id") % 2 == 1
    s = s.withColumns({"has_exit_type": odd, "exit_type": F.when(odd & (F.col("manager_id") % 3 == 0), F.lit("Voluntário"))})
    return attrition.attrition_history(s, as_of=AS_OF)


def q_headcount_without_hire_column(spark, sf_dir):
    s = prepare.prepare_staff(fixture.staff(spark, sf_dir).drop("hire_date"), None, AS_OF)
    return headcount.headcount_at(s, "department", AS_OF)


def q_headcount_without_dates(spark, sf_dir):
    s = prepare.prepare_staff(fixture.staff(spark, sf_dir).drop("hire_date", "exit_date"), None, AS_OF)
    return headcount.headcount_at(s, "department", AS_OF)


def q_rates_without_exit_column(spark, sf_dir):
    s = prepare.prepare_staff(fixture.staff(spark, sf_dir).drop("exit_date"), None, AS_OF)
    p = attrition.attrition_period(s, YEAR, None, as_of=AS_OF).select("attrition_total", "attrition_vol", "attrition_inv")
    found = kpis.quality_report(s, AS_OF).where(F.col("rule") == "missing_exit_column")
    return spells.with_scalars(p, found.agg(F.max("severity").alias("severity"), F.max("rule").alias("rule")))


def q_display_projection(spark, sf_dir):
    return filters.select_present(staff(spark, sf_dir), ["name", "role", "no_such_column", "department", "employee_id"],
                                  {"name": "nome", "role": "cargo"})


def _tidy_parts(parts: dict, keys: dict[str, str | None], value: dict[str, str]) -> DataFrame:
    """The frames of a bundle as one table (section, month, item, value)."""
    out = None
    for name, df in parts.items():
        item = F.col(keys[name]).cast("string") if keys[name] else F.lit(None).cast("string")
        month = F.col("month") if "month" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(name).alias("section"), month.alias("month"), item.alias("item"),
                         F.col(value.get(name, "headcount")).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_headcount_bundle(spark, sf_dir):
    """A26 for June 2000, all parts as one tidy table."""
    parts = bundles.headcount_bundle(staff(spark, sf_dir, with_rating=True), YEAR, MONTH, AS_OF)
    keys = {"headcount_by_department": "department", "headcount_temporal": "department", "headcount_growth": "department",
            "headcount_gender": "gender", "headcount_tenure": "tenure_band", "headcount_performance": "rating"}
    return _tidy_parts(parts, keys, {"headcount_growth": "growth_pct"})


def q_attrition_bundle(spark, sf_dir):
    """A27 for the year 2000, both parts as one tidy table."""
    parts = bundles.attrition_bundle(staff(spark, sf_dir), YEAR, None, AS_OF)
    return _tidy_parts(parts, {"attrition_period": None, "attrition_history": None},
                       {"attrition_period": "attrition_total", "attrition_history": "attrition_total"})


def q_null_clean(spark, sf_dir):
    """A result with NaN marks (even period headcounts) cleaned to nulls before storing."""
    g = q_headcount_compare(spark, sf_dir)
    g = g.withColumn("marked", F.when(F.col("headcount_period") % 2 == 0, F.lit(float("nan")))
                     .otherwise(F.col("headcount_period").cast("double")))
    return tables.null_clean(g)


def q_result_json(spark, sf_dir):
    return tables.to_records(q_contract_mix(spark, sf_dir))


def q_scan_staff(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/orders.parquet", T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampNTZType()),
    ])).select(F.col("o_orderkey").alias("employee_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("hire_date"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
