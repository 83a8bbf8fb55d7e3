"""Plan shape: no months × rows join, no un-partitioned window over staff rows, pruned scans."""

import os

import pytest

from staffline import catalog
from staffline.plans import checks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["attrition_history", "attrition_period_all", "attrition_period_year",
                                  "attrition_by_department", "headcount_monthly", "headcount_monthly_tenure",
                                  "headcount_at", "contract_mix", "risk_scores", "growth_summary",
                                  "attrition_compare", "attrition_forecast", "insights"])
def test_monthly_series_have_no_nested_loop_or_cartesian_join(spark, name):
    checks.assert_linear_plan(catalog.QUERIES[name](spark, SF))  # one-row values come in as scalar subqueries


def test_history_scans_staff_columns_only(spark):
    cols = checks.scanned_columns(catalog.QUERIES["attrition_history"](spark, SF))
    # each scan reads only the columns the mapping needs, not the whole table
    assert cols["lineitem.parquet"] == {"l_orderkey", "l_returnflag", "l_shipdate"}
    assert cols["orders.parquet"] == {"o_orderkey", "o_custkey", "o_orderdate"}


def test_history_windows_are_month_grain(spark):
    """The only window runs after the month-grain aggregate (HashAggregate below it)."""
    df = catalog.QUERIES["attrition_history"](spark, SF)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    w = p.index("Window")
    assert "Aggregate" in p[w:], "window must sit above the month-grain aggregate"


def test_team_size_is_aggregate_plus_join(spark):
    p = plan(catalog.QUERIES["team_size"](spark, SF))
    assert "Window" not in p


def test_partial_aggregation_before_shuffle(spark):
    p = plan(catalog.QUERIES["latest_review"](spark, SF))
    assert "partial_max_by" in p


def test_null_manager_rows_are_spread_by_the_join_key(spark):
    """The salt must be a join key (part of the hash partitioning), not a folded filter."""
    from pyspark.sql import functions as F

    from staffline.operators import risk

    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, None)], "employee_id long, manager_id long")
    got = risk.team_size(df.hint("merge"))
    assert sorted((r["employee_id"], r["team_size"]) for r in got.collect()) == [(1, 0), (2, 2), (3, 2), (4, 0)]
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    join = [ln for ln in optimized.splitlines() if "Join LeftOuter" in ln][0]
    assert "__salt" in join and "__rsalt" in join
    many = spark.range(1000).select(F.col("id").alias("employee_id"), F.lit(None).cast("long").alias("manager_id"))
    assert risk.team_size(many).where("team_size = 0").count() == 1000


def test_team_size_reads_only_what_it_needs(spark, tmp_path):
    from staffline.operators import risk

    (spark.range(10).selectExpr("id AS employee_id", "id % 3 AS manager_id", "'x' AS name", "'d' AS department", "1 AS a", "2 AS b")
     .write.parquet(str(tmp_path / "staff.parquet")))
    got = risk.team_size(spark.read.parquet(str(tmp_path / "staff.parquet"))).select("employee_id", "team_size")
    assert checks.scanned_columns(got) == {"staff.parquet": {"employee_id", "manager_id"}}
    assert checks.scanned_columns(catalog.QUERIES["team_size"](spark, SF))["orders.parquet"] == {"o_orderkey", "o_custkey"}


def test_rating_join_shuffles_once_per_side(spark):
    from staffline import fixture
    from staffline.operators import prepare

    staff = spark.range(1000).selectExpr("id AS employee_id", "'n' AS name")
    joined = prepare.attach_rating(staff.hint("merge"), fixture.reviews(spark, SF))
    assert checks.exchanges(joined) <= 2


@pytest.mark.parametrize("build", ["overview", "headcount_bundle", "attrition_bundle", "attrition_compare", "insights", "report_lines"])
def test_bundles_read_staff_once(spark, tmp_path, monkeypatch, build):
    """Staff is scanned by one plan only, once: the one that makes the cells (or the result itself)."""
    from staffline.operators import attrition, insights, spells
    from staffline.plans import bundles

    catalog.staff(spark, SF, with_rating=True).write.parquet(str(tmp_path / "staff.parquet"))
    staff = spark.read.parquet(str(tmp_path / "staff.parquet"))
    plans, materialize = [], spells.materialize
    monkeypatch.setattr(spells, "materialize", lambda df: (plans.append(df), materialize(df))[1])
    got = {
        "overview": lambda: bundles.overview(staff, 2000, 6), "headcount_bundle": lambda: bundles.headcount_bundle(staff, 2000, 6),
        "attrition_bundle": lambda: bundles.attrition_bundle(staff, None, 3),
        "attrition_compare": lambda: attrition.attrition_compare(staff, 2000, 6),
        "insights": lambda: insights.insights(staff), "report_lines": lambda: insights.report_lines(staff),
    }[build]()
    plans += list(got.values()) if isinstance(got, dict) else [got]
    assert sum(checks.scans_of(p, "staff.parquet") for p in plans) == 1
