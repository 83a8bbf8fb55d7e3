import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from staffline.llm import sharding
from tests.llm.conftest import SF, pairs


def check(docs, shards):
    got = sharding.shard_documents(docs, shards).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                   for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < shards
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(size.values()), max((r["size"] for r in got), default=0)
    assert all(abs(size[s] - total / shards) <= largest + 0.002 * total / shards for s in range(shards))
    return got, homes


def test_edges(edge_docs):
    check(edge_docs, 4)


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), 24)


def test_empty_table(no_docs):
    assert sharding.shard_documents(no_docs, 24).count() == 0


def test_copies_stay_together_but_a_hot_text_is_cut(spark):
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rest = spark.range(2000, 5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("text"))
    got, homes = check(hot.unionByName(rest), 8)
    assert len(homes[zlib.crc32(b"same text")]) >= 3
    assert sum(len(h) > 1 for h in homes.values()) <= 9
    # a small number of rows a task changes who numbers the slots, not the shards
    rows = sharding.staged(sharding.sized(hot.unionByName(rest)), "sized")
    assert pairs(sharding.histogram_sort(rows, 8, rows_per_task=50), "doc_id", "shard") == pairs(
        sharding.histogram_sort(rows, 8), "doc_id", "shard")


def test_rows_of_one_id_and_text_are_cut(spark):
    hot = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rest = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got, homes = check(hot.unionByName(rest), 8)
    assert len(homes[zlib.crc32(b"same")]) >= 3 and len({r["shard"] for r in got}) == 8


def test_native_plan_and_one_exchange_of_texts(spark):
    plan = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_are_near_equal(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    sharding.write_shards(docs, str(tmp_path / "s"), 6)
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("n")).collect()
    total = sum(r["n"] for r in back)
    assert len(back) == 6 and all(abs(r["n"] - total / 6) <= 120 + 0.01 * total for r in back)


def test_written_shards_hold_all_rows(spark, edge_docs, tmp_path):
    sharding.write_shards(edge_docs.drop("shard"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert pairs(back, "doc_id", "text") == pairs(edge_docs, "doc_id", "text")
