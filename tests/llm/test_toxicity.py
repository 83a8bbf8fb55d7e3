import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline.llm import toxicity
from tests.llm.conftest import pairs


def corpus(spark, n=600, bad=("vermin", "dirtbag", "lowlife", "swine")):
    rng = np.random.default_rng(0)
    words = ["sun", "moon", "river", "stone", "cloud", "field", "house", "road", "tree", "bird", "lake", "hill"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(words, 60).tolist()
        toxic = i % 6 == 0
        if toxic:
            for b in rng.choice(bad, 3):
                w[rng.integers(0, 60)] = str(b)
        rows.append((i, " ".join(w), "zz", 1.5, 3))
        if i % 3:
            labels.append((i, 1, int(toxic)))
        elif toxic and i % 2 == 0:
            labels.append((i, 0, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i in range(0, n, 6)}


def test_finds_toxic_texts_on_held_out_rows(spark):
    docs, labels, toxic = corpus(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    right = sum((r["doc_id"] in toxic) == bool(r["predicted"]) for r in held)
    assert right >= 0.97 * len(held)


def test_nothing_is_learned_from_held_out_rows(spark):
    docs, labels, _ = corpus(spark, 240)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = pairs(toxicity.score_toxicity(docs, labels), "doc_id", "score")
    b = pairs(toxicity.score_toxicity(docs, flipped), "doc_id", "score")
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for with_labels in (labels, none):
        got = toxicity.score_toxicity(edge_docs, with_labels)
        assert pairs(got, "doc_id") == pairs(edge_docs, "doc_id")
        assert got.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score_toxicity(no_docs, with_labels).count() == 0
    kept = toxicity.drop_toxic(edge_docs, none)
    assert kept.schema == edge_docs.schema


def test_label_model_recovers_accuracies(spark):
    """Latent classes with known voters, one of them a copy of another; few labels."""
    rng = np.random.default_rng(5)
    n, rates = 6000, [(0.7, 0.02), (0.5, 0.05), (0.6, 0.03), (0.1, 0.1)]
    y = rng.random(n) < 0.2
    fired = [rng.random(n) < np.where(y, t, c) for t, c in rates]
    fired.append(fired[0])
    votes = sum(f.astype(int) << j for j, f in enumerate(fired))
    rows = [(int(v), int(t) if i < 150 else None) for i, (v, t) in enumerate(zip(votes, y, strict=True))]
    patterns = (spark.createDataFrame(rows, "votes long, label int").groupBy("votes", "label")
                .agg(F.count("*").alias("n")))
    bias, w = toxicity.label_model(patterns, 5, 0.2)
    z = bias + sum(w[j] * f for j, f in enumerate(fired))
    best = np.log(0.2 / 0.8) + sum(np.where(f, np.log(t / c), np.log((1 - t) / (1 - c)))
                                   for f, (t, c) in zip(fired[:4], rates, strict=True))
    assert ((z > 0) == y).mean() > ((best > 0) == y).mean() - 0.02  # the true model's accuracy
    assert abs(w[3]) < 0.5 < w[1] and w[0] < 0.75 * w[2]  # the copies share their weight


def test_linear_classifier_and_calibration():
    rng = np.random.default_rng(3)
    rows = [np.array([0, 2]) if i % 4 == 0 else np.array([1, 2]) for i in range(400)]
    target = np.array([0.9 if i % 4 == 0 else 0.1 for i in range(400)])
    w, p, b = toxicity.fit_linear(rows, rng.random((400, len(toxicity.PATTERNS))), target, 3)
    assert w[0] > 0 > w[1]
    slope, shift = toxicity.calibrate(np.array([-1.0, -0.9, -1.1, 0.1, 0.2, 0.3] * 20), np.array([0, 0, 0, 1, 1, 1] * 20, float))
    assert slope * -1 + shift < 0 < slope * 0.1 + shift + 0.5


@pytest.mark.parametrize("text", [None, "", "a", "WORD " * 50000])
def test_patterns_are_bounded(text):
    w = toxicity._words(text)
    assert all(0 <= v <= 1 for v in toxicity.text_patterns(text, w, len(set(w))))


@pytest.mark.parametrize("text", ["Abcdefg " * 2000, "aB" * 4000, "x" * 9000 + "É" * 3000, "Word and more words, " * 1237])
def test_shouting_counts_every_character(text):
    w = toxicity._words(text)
    share = sum(c.isupper() for c in text) / sum(map(len, w))
    assert toxicity.text_patterns(text, w, len(set(w)))[0] == min(1.0, share)
