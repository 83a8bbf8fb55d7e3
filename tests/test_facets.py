import random
import re

from pyspark.sql import functions as F

from staffline.operators import attrition, facets, filters, headcount, name_index, prepare, summaries
from staffline.plans import bundles, checks
from staffline.sources import store
from tests.helpers import prepared, staff_df
import datetime as dt


def _people(spark):
    rnd = random.Random(3)
    pick = lambda *v: rnd.choice(v)
    return [{"name": pick("Ana", None), "department": pick("A", "B", " ", None), "role": pick("x", "y", None), "company": pick("C", "D"),
             "contract_type": pick("CLT", "PJ", None), "manager_id": pick(1, 2, None)} for _ in range(120)]


def test_options_equal_chained_filters(spark):
    rows = _people(spark)
    s = staff_df(spark, rows)
    picks = {"company": "C", "department": ["A", "B"], "role": "all", "contract_type": ["PJ"]}
    names = {"manager": "manager_id"}
    for cascade in (True, False):
        got = {(r["facet"], r["value"]): (r["rows"], r["picked"]) for r in facets.facet_options(s, picks, cascade=cascade).collect()}
        want = {}
        for i, f in enumerate(facets.FACETS):
            use = facets.FACETS[:i] if cascade else [x for x in facets.FACETS if x != f]
            left = facets.filtered(s, {x: picks.get(x) for x in use})
            own = facets.filtered(left, {f: picks.get(f)})
            c = names.get(f, f)
            kept = {str(r[0]) for r in own.select(c).distinct().collect()}
            for r in left.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).groupBy(c).count().collect():
                want[f, str(r[0])] = (r["count"], str(r[0]) in kept)
        assert got == want
    assert facets.facet_options(s.limit(0), picks).count() == 0


def test_facets_read_the_table_once(spark, tmp_path):
    staff_df(spark, _people(spark)).write.parquet(str(tmp_path / "staff.parquet"))
    df = facets.facet_options(spark.read.parquet(str(tmp_path / "staff.parquet")), {"role": ["x"]})
    assert checks.scans_of(df, "staff.parquet") == 1
    assert checks.scanned_columns(df)["staff.parquet"] == {"company", "department", "role", "manager_id", "contract_type"}


def test_manager_by_name_without_ids(spark):
    raw = spark.createDataFrame([(1, "Zé"), (2, "Bia"), (3, None)], "matricula long, gestor string")
    s = prepare.prepare_staff(raw, None)
    assert facets.manager_column(s) == "manager_name"
    assert [r[0] for r in facets.filtered(s, {"manager": ["Bia"]}).select("employee_id").collect()] == [2]
    assert facets.manager_column(prepare.prepare_staff(raw.drop("gestor"), None)) is None


NAMES = ["Customer#000012", "CUSTOMER#000123", "custo mer", "Kelvin Key", "maſ sa", "İstanbul", "ıstan", "aß", None, "", "ab", "a.b+c", "CUSTOMER#0012"]
PATTERNS = ["customer#0*12", "CUST", "tom", "a\\.b", "key", "mas s", "istan", "cust|abc", "[ck]ust", "a", "", "cus.*12", "custx?omer", "kel+vin", "^cus", "12$",
            "ust{2}", "(cust)", "ß", "a\\.b\\+c", "\\d+", "ss"]


def test_indexed_search_equals_the_scan(spark):
    s = spark.createDataFrame(list(enumerate(NAMES)), "employee_id long, name string")
    index = name_index.build_index(s)
    for p in PATTERNS:
        want = sorted(r[0] for r in filters.name_search(s, p).collect())
        assert sorted(r[0] for r in name_index.search(s, index, p).collect()) == want, p


def test_index_of_ids_with_one_and_several_names(spark, monkeypatch):
    monkeypatch.setattr(name_index, "NAMES", 10)  # several parts
    rnd = random.Random(5)
    names = [*NAMES, "000000", "Ana Ana Ana"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(names)) for _ in range(60)] + [(i, f"Name {i % 7}") for i in range(40, 90)] * 2
    s = spark.createDataFrame(rows, "employee_id long, name string")
    index = name_index.build_index(s)
    folds = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in {n for _, n in rows if n}], "n string")
             .select("n", name_index.folded(F.col("n"))).collect()}
    want = {(folds[n][k:k + 3], i) for i, n in rows if i is not None and n for k in range(len(folds[n]) - 2)}
    got = [tuple(r) for r in index.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for p in PATTERNS:
        assert (sorted(r[0] for r in name_index.search(s, index, p).collect())
                == sorted(r[0] for r in filters.name_search(s.where("employee_id IS NOT NULL"), p).collect())), p
    assert name_index.build_index(s.limit(0)).count() == 0


def test_index_shuffles_names_not_grams(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(name_index, "NAMES", 10)
    spark.createDataFrame([(i, f"Name {i}") for i in range(40)], "employee_id long, name string").write.parquet(str(tmp_path / "s"))
    index = name_index.build_index(spark.read.parquet(str(tmp_path / "s")))
    moved = [ln for ln in checks.physical_plan(index).splitlines() if "Exchange" in ln and "gram" in ln]
    assert not moved, moved
    parts = index.withColumn("p", F.spark_partition_id())
    assert parts.select("p").distinct().count() > 1
    assert parts.groupBy("id").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    index.write.parquet(str(tmp_path / "i"))
    for f in (tmp_path / "i").glob("*.parquet"):
        grams = [tuple(r) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert grams == sorted(grams)


def test_required_runs_are_in_every_match():
    assert name_index.required_runs("customer#0*12") == ["customer#"] and name_index.required_runs("cust|abc") == []
    assert name_index.required_grams("Tomas") == ["mas", "oma", "tom"]
    for p in PATTERNS:
        for n in NAMES:
            if n and (m := re.search(p, n, re.I | re.A)):
                assert all(r.lower() in m[0].lower() for r in name_index.required_runs(p))


def test_learned_orders_by_data_set_and_column(spark):
    rows = [("d", "13/01/2020", "01/02/2020"), ("d", "01/02/2020", "12/31/2020"), ("m", "01/13/2020", None), ("m", "01/02/2020", "x"),
            ("n", "01/02/2020", ""), (None, "25/12/2020", "2020-05-01"), (None, "02/01/2020", None), ("c", "13/01/2020", None),
            ("c", "01/13/2020", None), ("c", "01/14/2020", None)]
    raw = spark.createDataFrame(rows, "dataset_id string, hire_date string, exit_date string")
    orders = {(r["dataset_id"], r["column"]): (r["day_first_seen"], r["month_first_seen"], r["day_first"], r["conflict"])
              for r in prepare.date_orders(raw).collect()}
    assert orders["d", "hire_date"] == (1, 0, True, False) and orders["d", "exit_date"] == (0, 1, False, False)
    assert orders["n", "hire_date"] == (0, 0, False, False) and orders[None, "hire_date"] == (1, 0, True, False)
    assert orders["c", "hire_date"] == (1, 2, False, True)
    got = sorted((str(r[0]), str(r[1])[:10], str(r[2])[:10]) for r in prepare.coerce_dates_learned(raw).collect())
    assert got == sorted([("d", "2020-01-13", "2020-02-01"[:0] + "2020-01-02"), ("d", "2020-02-01", "2020-12-31"), ("m", "2020-01-13", "None"),
                          ("m", "2020-01-02", "None"), ("n", "2020-01-02", "None"), ("None", "2020-12-25", "2020-05-01"),
                          ("None", "2020-01-02", "None"), ("c", "2020-01-13", "None"), ("c", "2020-01-13", "None"), ("c", "2020-01-14", "None")])


def test_series_from_summaries_follow_saves_and_deletes(spark):
    rnd, day = random.Random(4), dt.date(2000, 1, 1)
    people = [{"hire_date": day + dt.timedelta(rnd.randrange(900)), "exit_date": day + dt.timedelta(rnd.randrange(1500)) if rnd.random() < 0.7 else None,
               "department": rnd.choice(["A", "B", None])} for _ in range(60)]
    s = prepared(spark, people)
    root, part = bundles.store_root(spark), lambda i: s.where(F.col("employee_id") % 3 == i)
    save = lambda d, rows, n: summaries.save_with_summary(spark, root, "o", d, {"staff": rows}, d, d, f"2001-01-0{n} 00:00:00")
    assert summaries.history(spark, root, "o") is None
    for i in range(3):
        save(f"d{i}", part(i), 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    same = lambda live: (rows(summaries.history(spark, root, "o")) == rows(attrition.attrition_history(live))
                         and rows(summaries.headcount_monthly(spark, root, "o")) == rows(headcount.headcount_monthly(live)))
    assert same(s)
    store.delete_dataset(spark, root, "d1", "2001-01-02 00:00:00", "o")
    assert same(part(0).unionByName(part(2)))
    save("d2", part(1), 3)
    assert same(part(0).unionByName(part(1)))


def test_hires_of_a_period_reach_the_scan(spark, tmp_path):
    staff_df(spark, [{"hire_date": dt.date(2000, m, 28)} for m in (1, 11, 12)] + [{"hire_date": dt.date(2001, 1, 1)}, {}]).write.parquet(
        str(tmp_path / "staff.parquet"))
    t = spark.read.parquet(str(tmp_path / "staff.parquet"))
    n = lambda *p: filters.hires_in_period(t, *p).count()
    assert (n(2000), n(2000, 12), n(None, 1), n(2001), n(None, None)) == (3, 1, 2, 1, 5)
    assert "GreaterThanOrEqual(hire_date" in checks.physical_plan(filters.hires_in_period(t, 2000, 12))


def test_series_end_beyond_the_last_exit(spark):
    s = prepared(spark, [{"hire_date": dt.date(2000, 1, 1), "exit_date": dt.date(2000, 3, 5), "department": "A"},
                         {"hire_date": dt.date(2000, 5, 1), "department": "A"}])
    months = lambda df: [r["month"] for r in df.orderBy("month").collect()]
    assert months(attrition.attrition_history(s)) == ["2000-01", "2000-02", "2000-03"]
    assert months(attrition.attrition_history(s, end="2000-06-15 00:00:00"))[-1] == "2000-06"
    assert months(headcount.headcount_monthly(s, end="2000-06-15 00:00:00")) == ["2000-01", "2000-02", "2000-03", "2000-05", "2000-06"]
