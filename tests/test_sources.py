"""Sources and sinks: schema conforming, date coercion, dataset store, JSON records, entry."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from staffline.operators import filters, prepare
from staffline.plans import bundles
from staffline.schema import STAFF_SCHEMA, conform, resolve, schema_report
from staffline.sources import tables
from tests.helpers import staff_df


def test_resolve_and_conform(spark):
    df = spark.createDataFrame([(" 7 ", "Ana", "31/12/2020", "GENERO?")],
                               "` Matricula ` string, NOME string, `data de admissão` string, GENERO string")
    assert resolve(df, "matricula") == " Matricula "
    assert resolve(df, "employee_id") == " Matricula "
    c = conform(df, STAFF_SCHEMA)
    assert c.columns == [f.name for f in STAFF_SCHEMA.fields]
    row = c.collect()[0]
    assert row["name"] == "Ana" and row["gender"] == "GENERO?"
    assert row["hire_date"] == dt.datetime(2020, 12, 31)
    assert row["employee_id"] == "7"  # text ids stay text, trimmed
    rep = {(r["column"], r["status"]) for r in schema_report(spark, df, STAFF_SCHEMA, "staff").collect()}
    assert ("employee_id", "ok") in rep and ("exit_date", "missing") in rep


def test_coerce_dates(spark):
    df = spark.createDataFrame([("2020-12-31",), ("31/12/2020",), ("abc",), ("",), (None,), ("2020-01-02 10:00:00",)],
                               "hire_date string")
    got = [r["hire_date"] for r in prepare.coerce_dates(df, ("hire_date",)).collect()]
    assert got == [dt.datetime(2020, 12, 31), dt.datetime(2020, 12, 31), None, None, None, dt.datetime(2020, 1, 2, 10)]


def test_latest_review_null_date_wins_and_ties(spark):
    r = spark.createDataFrame(
        [(1, "a", dt.datetime(2000, 1, 1), 1), (1, "b", None, 2), (1, "c", dt.datetime(2001, 1, 1), 3),
         (2, "x", dt.datetime(2000, 1, 1), 1), (2, "y", dt.datetime(2000, 1, 1), 2), (None, "z", None, 9)],
        "employee_id long, rating string, cycle_end timestamp_ntz, seq long")
    got = {row["employee_id"]: row["rating"] for row in prepare.latest_review(r).collect()}
    assert got == {1: "b", 2: "y"}


def test_filters(spark):
    df = staff_df(spark, [
        {"name": "Ána Souza", "department": "A", "role": "Gerente", "contract_type": "CLT", "company": "X"},
        {"name": "Bruno", "department": "B", "role": None, "contract_type": "PJ", "company": "X"},
        {"name": None, "department": " ", "role": "Analista", "contract_type": "CLT", "company": "Y"},
    ])
    assert [r["value"] for r in filters.facet_values(df, "department").collect()] == ["A", "B"]
    assert filters.filter_staff(df, company="X", role=filters.ALL).count() == 1
    assert filters.filter_staff(df, department=[]).count() == 3
    assert [r["name"] for r in filters.name_search(df, "ÁNA").collect()] == ["Ána Souza"]
    prof = {r["column"]: r["nulls"] for r in filters.table_profile(df, "staff").collect()}
    assert prof["name"] == 1 and prof["role"] == 1


def test_missing_table_is_empty(spark):
    df = tables.read_table(spark, "/nonexistent/staffline/table", STAFF_SCHEMA)
    assert df.count() == 0 and df.columns == [f.name for f in STAFF_SCHEMA.fields]


def test_null_clean_and_records(spark):
    df = spark.createDataFrame([(1, float("nan"), [(float("nan"),)], {"k": (float("nan"), 1)})],
                               "id long, x double, arr array<struct<v:double>>, m map<string,struct<v:double,n:int>>")
    row = tables.null_clean(df).collect()[0]
    assert row["m"]["k"]["v"] is None and row["m"]["k"]["n"] == 1
    assert row["x"] is None and row["arr"][0]["v"] is None
    js = [r["json"] for r in tables.to_records(spark.createDataFrame([(1, "a")], "k long, v string")).collect()]
    assert js == ['{"k":1,"v":"a"}']


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables not present")
def test_entry_and_registry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"month", "headcount", "exits", "attrition_total"}
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    from staffline.catalog import QUERIES

    assert set(QUERIES) <= set(o)  # those of the optional subpackage have their own tests


def test_report_file_and_bundles(spark):
    import glob

    from staffline.operators import insights
    from staffline.session import shared_dir
    from tests.helpers import prepared

    rows = [{"hire_date": dt.date(2000, 1, 1), "exit_date": dt.date(2000, 2, 15), "exit_reason": "Pedido",
             "department": "A", "gender": "M"},
            {"hire_date": dt.date(2000, 1, 1), "exit_date": None, "department": "A", "gender": "Feminino"}]
    df = prepared(spark, rows)
    out = shared_dir(spark, "report-test", os.urandom(4).hex())
    tables.write_report(insights.report_lines(df), out)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*")))
    assert text.startswith("# ") and "Resumo Executivo" in text

    hb = bundles.headcount_bundle(df, 2000, 1)
    assert set(hb) == {"headcount_by_department", "headcount_temporal", "headcount_growth", "headcount_gender",
                       "headcount_tenure", "headcount_performance"}
    assert [tuple(r) for r in hb["headcount_by_department"].collect()] == [("A", 2, 100.0)]
    tb = bundles.attrition_bundle(df, None, None)
    assert tb["attrition_history"].count() == 2  # 2000-01 .. 2000-02 (last exit)
    ov = {(r["section"], r["metric"]): r["value"] for r in bundles.overview(df).collect()}
    assert ov[("basic_kpis", "total_active")] == 1.0 and ov[("monthly_dismissals", "total_exits")] == 1.0


def test_month_names_and_labels(spark):
    from pyspark.sql import functions as F

    from staffline.functions.dates import month_name, month_number, period_label

    r = spark.range(1).select(month_name(F.lit(3)).alias("n"), month_number(F.lit("Março")).alias("k"),
                              period_label(F.lit(2000), F.lit(6)).alias("a"), period_label(F.lit(2000), None).alias("b"),
                              period_label(None, F.lit(1)).alias("c"), period_label(None, None).alias("d")).collect()[0]
    assert (r["n"], r["k"]) == ("Março", 3)
    assert r["a"] == "Junho/2000" and r["b"] == "Ano 2000 (média mensal)"
    assert r["c"] == "Mês Janeiro (média de todos os anos)" and r["d"] == "Todo o período"


def test_records_keep_null_fields(spark):
    rec = tables.to_records(spark.createDataFrame([(1, None)], "k int, v double")).first()["json"]
    assert rec == '{"k":1,"v":null}'


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from staffline import session

    monkeypatch.setattr(session, "_configured_root", lambda s: None)
    monkeypatch.setattr(session, "is_local", lambda s: False)
    with pytest.raises(RuntimeError):
        session.shared_dir(spark, "x")


def test_date_spellings_and_ids(spark):
    from staffline.functions.dates import coerce_timestamp
    from staffline.schema import STAFF_SCHEMA, absent, conform

    spelled = {"1/3/2020": "2020-01-03 00:00:00", "03/15/2020": "2020-03-15 00:00:00", "31/12/2020": "2020-12-31 00:00:00",
               "2020-05-01 10:00": "2020-05-01 10:00:00", "2020-05-01T10:00:00.123": "2020-05-01 10:00:00.123",
               "2020-05-01T10:00:00Z": "2020-05-01 10:00:00", "2020-05-01 10:00:00.5": "2020-05-01 10:00:00.5",
               "20200501": "2020-05-01 00:00:00", "2020-5-1": "2020-05-01 00:00:00", " 2020/05/01 ": "2020-05-01 00:00:00",
               "abc": None, "": None, "2020-13-01": None, "99/99/2020": None}
    df = spark.createDataFrame([(k,) for k in spelled], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", coerce_timestamp(F.col("t")).cast("string").alias("s")).collect()}
    assert got == spelled
    first = df.select(coerce_timestamp(F.lit("1/3/2020"), day_first=True).cast("string")).first()[0]
    assert first == "2020-03-01 00:00:00"
    ids = conform(spark.createDataFrame([(" A1 ", "0012"), ("12.0", ""), (None, "7")], "matricula string, manager_id string"), STAFF_SCHEMA)
    assert [tuple(r) for r in ids.select("employee_id", "manager_id").collect()] == [("A1", "0012"), ("12", None), (None, "7")]
    assert absent(ids, "hire_date") and not absent(ids, "employee_id")
