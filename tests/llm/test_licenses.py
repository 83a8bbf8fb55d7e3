import re

from staffline.llm import licenses
from tests.llm.conftest import SF, pairs

WORD = re.compile(licenses.WORD)
PHRASES = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    at = [(i, k) for k, p in PHRASES for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at})))


def check(docs):
    found = licenses.scan_licenses(docs)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.select("doc_id", "text").collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
    assert pairs(found, *cols) == want
    return found


def test_edges_match_brute_force(spark, edge_docs):
    found = check(edge_docs)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_whole_table_matches_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_empty_table(no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0


def test_passage_with_inserted_and_missing_words_is_one_span(spark):
    text = ("intro words here Permission is hereby granted, free of charge, to any very person obtaining a copy of this "
            "software and documentation files (the Software), to deal in the Software without restriction tail")
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "permission is hereby granted to nobody at all")],
                                                       "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "" and len(got[0]["spans"]) == 1
    assert got[0]["spans"][0]["first"] == 3
    assert got[1]["labels"] == ""


def test_words_replaced_evenly_cost_only_themselves(spark):
    label, passage = licenses.PASSAGES[0]
    rows = []
    for i, gone in enumerate([(), (8, 15, 22), (5, 10, 15, 20, 25)]):
        w = passage.split()
        for j in gone:
            w[j - 1] = "zzz"
        rows.append((i, " ".join(w)))
    long = " ".join(f"w{i}" for i in range(148))
    rows.append((3, " ".join("zzz" if i % 7 == 0 else f"w{i}" for i in range(148))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(docs, passages=(*licenses.PASSAGES, ("long", long))).orderBy("doc_id").collect()
    n = len(passage.split())
    for r, share in zip(got, [1, (n - 3) / n, (n - 5) / n, 126 / 148], strict=True):
        assert r["labels"] == ("long" if r["doc_id"] == 3 else label) and abs(r["score"] - share) < 1e-9


def test_common_words_do_not_make_labels(spark):
    text = "the work of the user is in the use of the terms and the license of the public " * 50
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"] == ""


def test_join_by_shuffle_gives_the_same(spark, monkeypatch, edge_docs):
    want = pairs(licenses.scan_licenses(edge_docs), "doc_id", "labels", "n_base")
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 0)
    assert pairs(licenses.scan_licenses(edge_docs), "doc_id", "labels", "n_base") == want
