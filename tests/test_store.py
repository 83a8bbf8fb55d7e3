from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from staffline import catalog
from staffline.plans import bundles, checks
from staffline.sources import files, store, tables


def _staff(spark):
    rows = [(1, "BUILDING"), (2, "BUILDING"), (3, None), (4, "ELSEWHERE")]
    return spark.createDataFrame(rows, "employee_id long, department string")


def test_rows_outside_the_listed_departments_are_stored(spark, monkeypatch):
    monkeypatch.setattr(catalog.fixture, "staff", lambda s, d: _staff(s))
    got = {r["name"]: r["rows"] for r in catalog.q_dataset_catalog(spark, "").collect()}
    assert got["other"] == 2 and got["building"] == 2 and sum(got.values()) == 4


def test_resaved_datasets_are_written_again_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(catalog.fixture, "staff", lambda s, d: _staff(s))
    written, save = [], catalog.store.save_dataset
    monkeypatch.setattr(catalog.store, "save_dataset", lambda *a: (written.append(a[3]), save(*a))[1])
    got = {r["name"]: r["rows"] for r in catalog.q_dataset_resaved(spark, "").collect()}
    assert sorted(written) == sorted([f"ds-{i}" for i in range(6)] * 2)
    assert got["other"] == 2 and got["building"] == 2 and got["machinery"] == 0


AT = "2001-01-0%d 00:00:00"


def _save(spark, root, dataset, rows, day, owner="o", **more):
    df = spark.createDataFrame([(r,) for r in rows], "k long")
    return store.save_dataset(spark, root, owner, dataset, {"staff": df, **more}, "n", "f.xlsx", AT % day)


def _keys(spark, root, dataset, owner="o", **kw):
    found = store.load_dataset(spark, root, dataset, owner, **kw)
    return sorted(r["k"] for r in found["staff"].collect()) if found else None


def test_a_derived_table_reads_the_stored_ones(spark):
    root, seen = bundles.store_root(spark), []

    def doubled(stored):
        seen.append(sorted(stored))
        assert checks.scans_of(stored["staff"], "staff") == 1
        return stored["staff"].select((F.col("k") * 2).alias("k"))

    _save(spark, root, "d", [1, 2], 1, double=doubled)
    found = store.load_dataset(spark, root, "d", "o")
    assert seen == [["staff"]] and sorted(r["k"] for r in found["double"].collect()) == [2, 4]
    assert _keys(spark, root, "d") == [1, 2]


def test_save_read_delete_and_save_again(spark):
    root = bundles.store_root(spark)
    names = ["d1", "folha (1)", "relatório/á b%20c", "[x]{y}*?"]
    for i, name in enumerate(names):
        _save(spark, root, name, range(i + 1), 1)
    assert [_keys(spark, root, n) for n in names] == [list(range(i + 1)) for i in range(4)]
    _save(spark, root, "d1", [7], 1, owner="other")
    _save(spark, root, "d1", [1, 2], 2)
    assert _keys(spark, root, "d1") == [1, 2] and _keys(spark, root, "d1", "other") == [7] and _keys(spark, root, "none") is None
    listed = lambda: [(r["dataset_id"], r["rows"]) for r in store.list_datasets(spark, root, "o").collect()]
    assert listed()[0] == ("d1", 2) and len(listed()) == 4
    store.delete_dataset(spark, root, "d1", AT % 3, "o")
    assert _keys(spark, root, "d1") is None and len(listed()) == 3 and _keys(spark, root, "d1", "other") == [7]
    _save(spark, root, "d1", [], 4)
    assert _keys(spark, root, "d1") == [] and listed()[0] == ("d1", 0)
    assert store.read_dataset(spark, root, "reviews", "d1", "o", "a int").count() == 0


def test_a_failing_save_leaves_the_former_version(spark):
    root = bundles.store_root(spark)
    _save(spark, root, "d", [1, 2], 1)
    broken = spark.range(1).select(F.raise_error(F.lit("lost connection")).alias("x"))
    with pytest.raises(Exception, match="lost connection"):
        _save(spark, root, "d", [9], 2, reviews=broken)
    assert _keys(spark, root, "d") == [1, 2]
    again = store.load_dataset(spark, root, "d", "o")
    store.save_dataset(spark, root, "o", "d", {"staff": again["staff"].where("k > 1")}, "n", "f", AT % 3)  # read and saved again
    assert _keys(spark, root, "d") == [2]
    assert [r["rows"] for r in store.versions(spark, root, "o", "d").collect()] == [1, 2]


def test_vacuum_removes_rows_of_deleted_and_replaced_versions_only(spark):
    root = bundles.store_root(spark)
    first = _save(spark, root, "d", [1], 1)
    second = _save(spark, root, "d", [2], 3)
    _save(spark, root, "gone", [5], 1)
    store.delete_dataset(spark, root, "gone", AT % 2, "o")
    on_disk = lambda: sorted(r["k"] for r in spark.read.schema("k long").parquet(f"{root}/data/*/*/staff").collect())
    assert len(store.vacuum(spark, root, AT % 3)) == 1  # the first version was current until then
    assert on_disk() == [1, 2] and _keys(spark, root, "d", version=first) == [1]
    assert len(store.vacuum(spark, root, AT % 4)) == 1
    assert on_disk() == [2] and _keys(spark, root, "d") == [2] and _keys(spark, root, "d", version=second) == [2]
    assert _keys(spark, root, "d", version=first) is None and [r["dataset_id"] for r in store.list_datasets(spark, root, "o").collect()] == ["d"]
    assert store.vacuum(spark, root, "2100-01-01 00:00:00") == [] and on_disk() == [2]
    snapshot, tail = store.log_files(spark, root)
    assert not tail and files.listed(spark, f"{root}/log") == [] and len(files.listed(spark, f"{root}/snapshots")) == 1


def test_listing_reads_a_bounded_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(store, "TAIL", 10)
    root = bundles.store_root(spark)
    for i in range(45):
        entry = {"version": f"{i:020d}-x", "owner": "o", "dataset_id": f"d{i % 30}", "deleted": i == 7, "name": "n", "file_name": "f",
                 "rows": i, "created_at": "2001-01-01T00:00:00", "tables": {}}
        assert store.publish(spark, root, entry["version"], entry)
        assert not store.publish(spark, root, entry["version"], entry)  # a replay
        assert len(store.log_files(spark, root)[1]) <= 10
    want = {f"d{i % 30}": i for i in range(45)}
    assert {r["dataset_id"]: r["rows"] for r in store.list_datasets(spark, root, "o").collect()} == {
        k: v for k, v in want.items() if v != 7}
    n = len(files.listed(spark, f"{root}/manifests"))
    assert json.loads(files.text_of(spark, f"{root}/manifests/{n:012d}.json"))["number"] == n


def test_results_describe_themselves(spark):
    root = bundles.store_root(spark)
    tables.save_result(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "n long, rate double"), root, "d", "a", AT % 1)
    tables.save_result(spark.createDataFrame([("x", [1, 2])], "name string, list array<int>"), root, "d", "b", AT % 1)
    got = tables.result_fields(tables.read_results(spark, root, "d"), {
        "rate": ("$.rate", "double"), "second": ("$.list[1]", "int"), "wrong": ("$.name", "int")})
    assert sorted(tuple(r)[3:] for r in got.collect() if r["kind"] == "b") == [(None, 2, None)]
    assert sorted(str(r["rate"]) for r in got.collect() if r["kind"] == "a") == ["0.5", "None"]
    assert {r["kind"] for r in tables.result_schema(tables.read_results(spark, root, "d")).collect()} == {"a", "b"}
