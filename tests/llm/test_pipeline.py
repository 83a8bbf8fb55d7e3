import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from staffline.llm import mixing, pii, toxicity, unigram  # noqa: E402
from tests.llm.conftest import SF, pairs  # noqa: E402
from tests.llm.test_mixing import fill  # noqa: E402
from tests.llm.test_simhash import classes, slow_fingerprint  # noqa: E402

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    """Each stage's input and output over the smallest whole table."""
    from staffline.llm.store import staged

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLS).collect())


def test_all_but_the_last_return_documents(spark, outputs):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for name, (_, after) in list(outputs.items())[:-1]:
        assert after.dtypes == want.dtypes, name


def test_toxic_documents_go(spark, outputs):
    before, after = outputs["toxicity"]
    scored = toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    assert toxic and rows(after) == Counter({k: v for k, v in rows(before).items() if k[0] not in toxic})


def test_one_of_each_near_duplicate_group_stays(outputs):
    before, after = outputs["simhash_near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    of = classes([slow_fingerprint(t) for t in texts.values()])
    least = {}
    for d, t in sorted(texts.items()):
        least.setdefault(of[slow_fingerprint(t)], d)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least.values())
    assert not rows(after) - rows(before)


def test_personal_data_is_masked_and_clean_texts_stay(outputs):
    before, after = outputs["pii"]
    new = {r["doc_id"]: r for r in after.collect()}
    old = before.collect()
    for r, (_, spans) in zip(old, pii.find_spans(pii.train(), [r["text"] for r in old]), strict=True):
        assert new[r["doc_id"]]["text"] == (r["text"] if not spans else pii.masked(r["text"], spans))
        assert new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
        assert not pii.base_spans(new[r["doc_id"]]["text"]) or spans


def test_mix_takes_whole_copies_near_the_targets(outputs):
    before, after = outputs["mixing"]
    sized = before.select("doc_id", "source", mixing.token_count(F.col("text")).alias("size")).collect()
    sizes, longest = Counter(), Counter()
    for r in sized:
        sizes[r["source"]] += r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    taken = {r["source"]: r["t"] for r in after.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    for s, t in fill(dict(sizes)).items():
        assert abs(taken.get(s, 0) - t) <= longest[s] / 2 + 1 + 1e-4 * t
    assert max(rows(after).values()) <= 3 and not set(rows(after)) - set(rows(before))


def test_tokens_decode_to_the_texts(outputs):
    before, after = outputs["sentencepiece"]
    back = unigram.decode_ids(after, corpus_pipeline.PIECES)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert after.count() == before.count()
    assert all(r["decoded"] == texts[r["doc_id"]].replace("▁", " ") for r in back.collect())


def test_the_last_stage_decodes_what_it_encodes(spark, edge_docs):
    got = corpus_pipeline.to_tokens(spark, edge_docs, SF)
    assert got.count() == edge_docs.count() and got.filter("not coalesce(round_trip, false)").count() == 0


def test_stages_on_edges(spark, edge_docs, tmp_path):
    (spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
     .write.parquet(str(tmp_path / "labels.parquet")))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, edge_docs.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        docs = stage(spark, edge_docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == edge_docs.columns and docs.count() <= 3 * edge_docs.count(), name
    mixed = mixing.apply_mix(edge_docs)
    want = Counter()
    for r in mixing.mix_documents(edge_docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(x[0] for x in pairs(mixed, "doc_id")) == +want


def test_entry_works_without_the_pipeline(monkeypatch):

    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries()
    real = importlib.import_module

    def gone(prefix):
        def load(name, *a):
            if name.startswith(prefix):
                raise ModuleNotFoundError(f"No module named {prefix!r}", name=prefix)
            return real(name, *a)
        return load

    monkeypatch.setattr(entry.importlib, "import_module", gone("corpus_pipeline"))
    assert "pipeline" not in entry.queries() and "op8_simhash" in entry.queries()
    monkeypatch.setattr(entry.importlib, "import_module", gone("staffline.llm"))
    assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries())
