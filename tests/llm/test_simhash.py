from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from staffline.llm import simhash
from staffline.llm.components import connected_components
from tests.llm.conftest import SF, pairs


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if x]
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, most=2):
    a = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= most)[0]:
            root[find(i)] = find(i + 1 + int(j))
    return {int(f): find(i) for i, f in enumerate(a)}


def check(docs, **options):
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    of = classes([f for _, f in rows])
    least = defaultdict(lambda: None)
    for d, f in rows:
        if d is not None and (least[of[f]] is None or d < least[of[f]]):
            least[of[f]] = d
    got = simhash.simhash_groups(docs, **options).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id")
    want = sorted(((d, f"{f:016x}", least[of[f]]) for d, f in rows), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert pairs(got, "doc_id", "h", "component_id") == want


def test_edges(edge_docs):
    check(edge_docs)
    check(edge_docs, bucket_cap=1)


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_empty_table(no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("cap", [64, 4, 1])
def test_links_of_planted_neighbours(spark, cap):
    """All links, in small buckets (pair by pair) and large ones (by meeting points)."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base[:12] for k in (1, 2, 2, 3, 3, 4)]
    fps = sorted({int(x) for x in [*base, *near, *(base[0] ^ np.uint64(1 << i) for i in range(64))]})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.pigeonring_links(df, bucket_cap=cap)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    of = classes(fps)
    groups = defaultdict(set)
    for f in fps:
        groups[got.get(simhash._signed(f), simhash._signed(f))].add(of[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(of.values()))


def test_keep_one_of_each_group(edge_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert [r[0] for r in pairs(kept, "doc_id")] == [1, 10, 2, 5, 7, 8, 9]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(chain + star, "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == (
        {(i, 100) for i in range(100, 161)} | {(i, 5) for i in [5, *range(200, 260)]})
