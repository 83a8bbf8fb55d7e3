import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from staffline.llm import mixing
from tests.llm.conftest import SF, pairs


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


def check(docs):
    got = mixing.mix_documents(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = defaultdict(int), defaultdict(int)
    want = []
    for r in docs.select("doc_id", "text", "source").collect():
        sizes[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
        want.append((r["doc_id"], r["source"], size(r["text"])))
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=key) == sorted(want, key=key)
    target, taken = fill(dict(sizes)), defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1 + 1e-4 * target[s], (s, taken[s], target[s])
    return got


def test_edges(spark, edge_docs):
    check(edge_docs)


def test_whole_table_and_rerun(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = check(docs)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    again = mixing.mix_documents(docs.repartition(7))
    assert pairs(again, *cols) == sorted([tuple(r[c] for c in cols) for r in first],
                                         key=lambda t: tuple((x is None, str(x)) for x in t))


def test_empty_table(no_docs):
    assert mixing.mix_documents(no_docs).count() == 0


def test_skewed_sources_stop_at_the_cap(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"),
                                   F.expr("case when id < 380 then 'a' when id < 395 then 'b' else 'c' end").alias("source"))
    got = check(docs)
    assert {r["copies"] for r in got if r["source"] == "c"} == {3}


def test_hot_group_is_numbered_in_parts(spark):
    sized = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"))
    sized = sized.unionByName(spark.range(3000, 3300).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit(7).cast("long").alias("size")))
    got = mixing.mix(sized, weights=(1, 1), rows_per_task=100)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect()}
    assert abs(by["s"]["t"] - by["s"]["g"]) <= 10 and abs(by["t"]["t"] - by["t"]["g"]) <= 10


def test_native_plan(spark):
    plan = mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
