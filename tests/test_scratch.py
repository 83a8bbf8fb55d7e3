import os
import time

from pyspark.sql import functions as F

from staffline import scratch
from staffline.operators import prepare, spells
from staffline.sources import files
from tests.helpers import staff_df


def _tables(spark):
    return sum(len(files.listed(spark, scratch.shared_dir(spark, scratch.FOLDER, k)))
               for k in files.listed(spark, scratch.shared_dir(spark, scratch.FOLDER)))


def test_second_preparation_writes_nothing_until_files_change_or_age(spark, tmp_path):
    path = str(tmp_path / "staff.parquet")
    staff_df(spark, [{"name": "a"}, {"name": "b"}]).write.parquet(path)
    load = lambda **kw: scratch.cached(prepare.prepare_staff(spark.read.parquet(path), None), **kw)
    before = _tables(spark)
    assert load().count() == 2 and _tables(spark) == before + 1
    assert load().count() == 2 and _tables(spark) == before + 1
    assert load(lifetime=0).count() == 2 and _tables(spark) == before + 2 - 1  # too old: written anew, the old one removed
    time.sleep(0.01)
    staff_df(spark, [{"name": "c"}]).write.mode("append").parquet(path)
    assert load().count() == 3 and _tables(spark) == before + 2
    assert scratch.expire(spark, 0) >= 2 and _tables(spark) == 0


def test_keys_tell_queries_apart(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(20).withColumn("x", F.lit("a")).write.parquet(path)
    t = lambda: spark.read.parquet(path)
    key = scratch.fingerprint
    assert key(t().where("id > 3")) == key(t().where("id > 3")) is not None
    assert len({key(t().where("id > 3")), key(t().where("id > 4")), key(t().select("id")), key(t().select(F.col("id").alias("y")))}) == 4
    assert key(t().where(F.col("id").isin(*range(40)))) != key(t().where(F.col("id").isin(*range(39), 77)))
    assert key(spark.range(3)) is None and key(t().withColumn("r", F.rand())) is None
    assert key(t().withColumn("now", F.current_timestamp())) is None
    assert key(t().mapInPandas(lambda it: it, "id long, x string")) is None


def test_scope_removes_what_was_written_inside(spark):
    with scratch.scope(spark) as noted:
        t = spells.materialize(spark.range(5))
        assert t.count() == 5 and len(noted) == 1 and os.path.exists(noted[0])
    assert not os.path.exists(noted[0])
    kept = spells.materialize(spark.range(5))
    assert kept.count() == 5
