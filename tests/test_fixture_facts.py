"""Facts of FIXTURES.md §2 measured at sf0.01 (Spark = DuckDB there), checked on our operators."""

import os

import pytest
from pyspark.sql import functions as F

from staffline import catalog, fixture
from staffline.operators import prepare

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


def test_staff_counts(spark):
    s = fixture.staff(spark, SF)
    r = s.agg(F.count(F.lit(1)).alias("n"), F.count("exit_date").alias("ex"),
              F.count_if(F.col("exit_date") < F.col("hire_date")).alias("before"),
              F.count_if(F.col("exit_date") <= F.col("hire_date")).alias("on_or_before"),
              F.countDistinct("manager_id").alias("mgr"), F.countDistinct("company").alias("co"),
              F.countDistinct("department").alias("dept")).collect()[0]
    assert (r["n"], r["ex"], r["before"], r["on_or_before"]) == (15000, 11058, 4133, 4141)
    assert (r["mgr"], r["co"], r["dept"]) == (1500, 25, 5)


def test_history_first_and_last_rows(spark):
    h = [tuple(r) for r in catalog.QUERIES["attrition_history"](spark, SF).orderBy("month")
         .select("month", "headcount", "exits", "voluntary").collect()]
    assert len(h) == 83
    assert h[:3] == [("1995-01", 2, 63, 16), ("1995-02", 188, 67, 19), ("1995-03", 374, 57, 19)]
    assert h[-2:] == [("2001-10", 4216, 260, 67), ("2001-11", 3961, 22, 6)]


def test_tenure_grid_sizes(spark):
    t = catalog.QUERIES["headcount_monthly_tenure"](spark, SF)
    assert t.count() == 415
    assert t.where(F.col("headcount") > 0).select("month", "band_no").count() == 337


def test_latest_rating_counts(spark):
    last = prepare.latest_review(fixture.reviews(spark, SF))
    got = {r["rating"]: r["n"] for r in last.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"Abaixo do esperado": 2111, "Acima do esperado": 4251, "Dentro do esperado": 4259,
                   "Excepcional": 2049, "Sem nota": 2073}
