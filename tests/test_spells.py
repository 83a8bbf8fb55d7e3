"""Month-delta rewrite = nested-loop definition (property tests on random spells and edge rows)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staffline.operators import headcount, attrition
from tests import brute
from tests.helpers import prepared

AS_OF = "2001-12-01 00:00:00"
AS_OF_D = dt.date(2001, 12, 1)

dates = st.one_of(st.none(), st.dates(min_value=dt.date(1999, 1, 1), max_value=dt.date(2002, 3, 31)))
# month starts are over-represented: they are the edge of every rule
month_starts = st.builds(lambda y, m: dt.date(y, m, 1), st.integers(1999, 2001), st.integers(1, 12))
any_date = st.one_of(dates, month_starts)
reasons = st.sampled_from([None, "Pedido de demissão", "Dispensa", "DEMISSÃO", "Involuntário", "Voluntário", "outro"])
spell = st.fixed_dictionaries({
    "hire_date": any_date, "exit_date": any_date, "exit_reason": reasons,
    "department": st.sampled_from([None, "A", "B", "C"]),
})
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _hist(spark, rows):
    got = attrition.attrition_history(prepared(spark, rows), as_of=AS_OF).orderBy("month").collect()
    return [tuple(r) for r in got]


@SETTINGS
@given(st.lists(spell, min_size=0, max_size=25))
def test_history_equals_nested_loop(spark, rows):
    assert _hist(spark, rows) == brute.history(rows, AS_OF_D)


@SETTINGS
@given(st.lists(spell, min_size=1, max_size=25))
def test_monthly_by_group_equals_nested_loop(spark, rows):
    got = headcount.headcount_monthly(prepared(spark, rows), "department", AS_OF).collect()
    assert sorted(tuple(r) for r in got) == brute.monthly_by(rows, "department", AS_OF_D)


@SETTINGS
@given(st.lists(spell, min_size=1, max_size=25))
def test_tenure_bands_equal_nested_loop(spark, rows):
    got = headcount.headcount_monthly_tenure(prepared(spark, rows), AS_OF).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.tenure_bands(rows, AS_OF_D))


@SETTINGS
@given(st.lists(spell, min_size=1, max_size=20), st.sampled_from([(2000, 6), (2000, None), (None, 3), (None, None), (2002, None)]))
def test_period_equals_nested_loop(spark, rows, period):
    y, m = period
    got = attrition.attrition_period(prepared(spark, rows), y, m, as_of=AS_OF).collect()[0].asDict()
    used = brute.period(rows, AS_OF_D, y, m)
    if not used:
        assert got["months_used"] == 0 and got["attrition_total"] == 0.0 and got["avg_headcount"] == 0
        return
    n = len(used)
    assert got["months_used"] == n
    assert got["avg_headcount"] == int(sum(u[0] for u in used) / n)
    assert abs(got["avg_exits"] - round(sum(u[1] for u in used) / n, 1)) < 1e-9
    mean_rate = sum(u[1] / u[0] * 100 for u in used) / n
    assert abs(got["attrition_total"] - round(mean_rate, 1)) <= 0.05 + 1e-9


EDGE_ROWS = [
    {"hire_date": dt.date(2000, 1, 15), "exit_date": dt.date(2000, 3, 1), "exit_reason": "Dispensa"},     # leaves on the 1st
    {"hire_date": dt.date(2000, 2, 3), "exit_date": dt.date(2000, 2, 20), "exit_reason": "Pedido"},       # same month
    {"hire_date": dt.date(2000, 5, 1), "exit_date": dt.date(2000, 4, 10), "exit_reason": "Involuntário"}, # exit before hire
    {"hire_date": dt.date(2000, 6, 1), "exit_date": dt.date(2000, 6, 1)},                                 # exit = hire
    {"hire_date": None, "exit_date": dt.date(2000, 7, 9), "exit_reason": "DEMISSÃO"},                    # null hire
    {"hire_date": dt.date(1999, 12, 1), "exit_date": None},                                               # month start hire
    {"hire_date": dt.date(1999, 11, 20), "exit_date": None},                                              # earliest, mid-month
    {"hire_date": None, "exit_date": None},
]


def test_edge_rows_history(spark):
    got = _hist(spark, EDGE_ROWS)
    assert got == brute.history(EDGE_ROWS, AS_OF_D)
    by_month = {r[0]: r for r in got}
    # the spine starts at the first month start on/after the earliest hire
    assert got[0][0] == "1999-12"
    # leaver on 2000-03-01: not in March's headcount, counted in March's exits
    assert by_month["2000-03"][2] == 1 and by_month["2000-02"][1] == 3 and by_month["2000-03"][1] == 2


def test_empty_table(spark):
    df = prepared(spark, [])
    assert attrition.attrition_history(df, as_of=AS_OF).count() == 0
    row = attrition.attrition_period(df, as_of=AS_OF).collect()[0]
    assert row["months_used"] == 0 and row["attrition_total"] == 0.0


def test_group_without_exit_runs_to_as_of(spark):
    rows = [{"hire_date": dt.date(2001, 9, 5), "exit_date": None, "department": "A"}]
    got = attrition.attrition_history(prepared(spark, rows), by=["department"], as_of=AS_OF).collect()
    assert [r["month"] for r in got] == ["2001-10", "2001-11", "2001-12"]


def test_group_series_count_ids_only(spark):
    from tests.helpers import staff_df
    from staffline.operators.prepare import prepare_staff

    rows = [{"hire_date": dt.date(2001, 1, 1), "department": "A"}, {"hire_date": dt.date(2001, 1, 1), "department": "A"}]
    df = staff_df(spark, rows)
    df = df.withColumn("employee_id", __import__("pyspark.sql.functions", fromlist=["when"]).when(
        df.employee_id == 1, None).otherwise(df.employee_id))
    p = prepare_staff(df, None, AS_OF)
    got = {r["month"]: r["headcount"] for r in headcount.headcount_monthly(p, "department", AS_OF).collect()}
    assert got["2001-01"] == 1
    tb = {(r["month"], r["band_no"]): r["headcount"] for r in headcount.headcount_monthly_tenure(p, AS_OF).collect()}
    assert tb[("2001-01", 1)] == 1
    # the history counts rows
    h = {r["month"]: r["headcount"] for r in attrition.attrition_history(p, as_of=AS_OF).collect()}
    assert h["2001-01"] == 2


def test_tenure_band_day_edges(spark):
    """Hire dates chosen so that at 2001-06-01 the tenure is exactly 180/181, 360/361, 720/721,
    1080/1081 days: right-closed bands put 180 in 0-6m, 181 in 6-12m, and so on."""
    m = dt.date(2001, 6, 1)
    days = [180, 181, 360, 361, 720, 721, 1080, 1081]
    rows = [{"hire_date": m - dt.timedelta(days=d), "exit_date": None} for d in days]
    got = {r["band_no"]: r["headcount"] for r in headcount.headcount_monthly_tenure(prepared(spark, rows), AS_OF)
           .where("month = '2001-06'").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1}
    assert sorted(tuple(r) for r in headcount.headcount_monthly_tenure(prepared(spark, rows), AS_OF).collect()) == \
        sorted(brute.tenure_bands(rows, AS_OF_D))


def test_exit_type_column_decides_alone(spark):
    from pyspark.sql import functions as F

    rows = [{"hire_date": dt.date(2000, 1, 1), "exit_date": dt.date(2000, 3, 10), "exit_reason": "Pedido de demissão"},
            {"hire_date": dt.date(2000, 1, 1), "exit_date": dt.date(2000, 3, 11), "exit_reason": "Dispensa"}]
    df = prepared(spark, rows)
    typed = df.withColumn("exit_type", F.when(F.col("employee_id") == 2, F.lit("Voluntário")).otherwise(F.lit(None)))
    march = {r["month"]: r for r in attrition.attrition_history(typed, as_of=AS_OF).collect()}["2000-03"]
    # the type column exists, so the reason is ignored even where the type is null
    assert (march["exits"], march["voluntary"]) == (2, 1)
    plain = {r["month"]: r for r in attrition.attrition_history(df, as_of=AS_OF).collect()}["2000-03"]
    assert plain["voluntary"] == 1


def test_far_future_placeholder_is_no_exit(spark):
    rows = [{"hire_date": dt.date(2001, 1, 1), "exit_date": dt.date(9999, 12, 31)},
            {"hire_date": dt.date(2001, 1, 1), "exit_date": dt.date(2001, 5, 5)}]
    got = _hist(spark, rows)
    assert got[-1][0] == "2001-05" and len(got) == 5  # the spine ends at the real last exit
    assert got[0][1] == 2 and got[-1][1] == 2


keyed_spell = st.fixed_dictionaries({
    "hire_date": any_date, "exit_date": any_date, "exit_reason": reasons,
    "department": st.sampled_from(["A", "B", "C"]),
})


@SETTINGS
@given(st.lists(keyed_spell, min_size=1, max_size=25))
def test_invariants(spark, rows):
    df = prepared(spark, rows)
    hist = {r["month"]: r for r in attrition.attrition_history(df, as_of=AS_OF).collect()}
    by_dept = {}
    for r in headcount.headcount_monthly(df, "department", AS_OF).collect():
        by_dept[r["month"]] = by_dept.get(r["month"], 0) + r["headcount"]
    bands = {}
    for r in headcount.headcount_monthly_tenure(df, AS_OF).collect():
        bands[r["month"]] = bands.get(r["month"], 0) + r["headcount"]
    for m, r in hist.items():
        assert r["voluntary"] + r["involuntary"] == r["exits"]
        assert by_dept.get(m, 0) == r["headcount"]       # no null keys: groups add up to the total
        assert bands.get(m, 0) == r["headcount"]         # bands add up to the total


@SETTINGS
@given(st.lists(spell, min_size=1, max_size=20))
def test_spell_closed_before_the_spine_changes_nothing(spark, rows):
    base = _hist(spark, rows)
    hires = [r["hire_date"] for r in rows if r["hire_date"] is not None]
    if not hires:
        return
    # a spell that ends before the first month start of the spine (and is hired after the
    # earliest hire) adds nothing to any spine month
    lo = brute.ceil_month(min(hires))
    extra = {"hire_date": min(hires), "exit_date": min(hires), "exit_reason": None, "department": None}
    if extra["exit_date"] >= lo or all(r["exit_date"] is None for r in rows):
        return  # (without any exit the spine ends now; the extra exit would end it)
    assert _hist(spark, rows + [extra]) == base


review = st.fixed_dictionaries({
    "employee_id": st.integers(1, 4),
    "rating": st.sampled_from(["Excepcional", "Acima do esperado", "Dentro do esperado", "Abaixo do esperado"]),
    "cycle_end": st.one_of(st.none(), st.sampled_from([dt.datetime(2000, 1, 1), dt.datetime(2000, 6, 1),
                                                       dt.datetime(2001, 1, 1)])),
})


@SETTINGS
@given(st.lists(review, min_size=1, max_size=20))
def test_latest_review_equals_sorted_last(spark, rows):
    from staffline.operators.prepare import latest_review

    data = [(r["employee_id"], r["rating"], r["cycle_end"], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "employee_id long, rating string, cycle_end timestamp_ntz, seq long")
    got = {r["employee_id"]: r["rating"] for r in latest_review(df).collect()}
    # brute force: stable sort by (id, cycle_end with missing dates last), keep the last row per id
    ordered = sorted(data, key=lambda x: (x[0], x[2] is None, x[2] or dt.datetime.min))
    want = {}
    for emp, rating, _, _ in ordered:
        want[emp] = rating
    assert got == want


@SETTINGS
@given(st.lists(spell, min_size=1, max_size=25), st.dates(min_value=dt.date(1999, 1, 1), max_value=dt.date(2002, 1, 1)))
def test_headcount_at_equals_brute(spark, rows, at):
    got = {r["department"]: r["headcount"] for r in
           headcount.headcount_at(prepared(spark, rows), "department", f"{at.isoformat()} 00:00:00").collect()}
    want = {}
    for r in rows:
        if r["department"] is not None and brute.active(r, at):
            want[r["department"]] = want.get(r["department"], 0) + 1
    assert got == want
