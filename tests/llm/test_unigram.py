import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from staffline.llm import unigram
from tests.llm.conftest import SF, pairs

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The library's own unigram encoder over the same pieces and scores."""
    import struct

    pieces, model = unigram.read_pieces(PATH)
    assert model == 2
    with open(PATH, "rb") as f:
        data = f.read()
    out = b""
    for (piece, _, kind), score in zip(pieces, unigram.zipf_scores(pieces), strict=True):
        body = b"\x0a" + _varint(len(piece.encode())) + piece.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        out += b"\x0a" + _varint(len(body)) + body
    for number, value in unigram._fields(data):
        if number == 2:  # of the trainer's settings, the last word on the model type wins
            value += b"\x18\x01"
        if number != 1 and isinstance(value, bytes):
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def same(library, text):
    m = unigram.load(PATH)
    ids = m.encode([text])[0].tolist()
    want = library.encode(text)
    if ids != want:  # equal scores may be split differently
        total = lambda x: sum(float(m.score[i]) for i in x if i not in m.byte.values())
        assert abs(total(ids) - total(want)) < 1e-3 * (1 + abs(total(want))), text
    assert m.decode(ids) == text.replace("▁", " ")


def test_matches_the_library_on_the_corpus(spark, library):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect():
        same(library, r["text"])


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁\x00"), max_size=60))
def test_matches_the_library_on_any_text(library, text):
    same(library, text)


def test_viterbi_against_all_segmentations():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("aba", -4.2, 1), ("ba", -2.2, 1), ("▁", -1.5, 1),
              ("▁a", -1.7, 1)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    m = unigram.Unigram(pieces, [s for _, s, _ in pieces])
    score = {p: s for p, s, k in pieces if k == 1}

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for n in range(1, 4):
            if w[:n] in score or n == 1:
                s, rest = best(w[n:])
                options.append((s + score.get(w[:n], min(score.values()) - 10), [w[:n], *rest]))
        return max(options, key=lambda x: x[0])

    for text in ["a", "ab", "aba", "abab", "ba ab", "  a", "abaabab bab", "xaby", "é"]:
        ids = m.encode([text])[0].tolist()
        got = sum(m.score[i] if pieces[i][2] == 1 else 0 for i in ids)
        lost = sum(c not in "ab " for c in text)
        assert np.isclose(got + lost * (min(score.values()) - 10), best(m.marked(text))[0], atol=1e-4)
        assert m.decode(ids) == text


def test_edges(spark, edge_docs):
    out = unigram.decode_ids(unigram.encode_texts(edge_docs, PATH), PATH)
    for r in out.collect():
        assert (r["ids"] is None) == (r["text"] is None) and r["n_tokens"] == len(r["ids"] or [])
        assert r["decoded"] == (r["text"] and r["text"].replace("▁", " "))
    assert pairs(out, "doc_id", "shard", "fp") == pairs(edge_docs, "doc_id", "shard", "fp")
    digest = unigram.encode_and_check(edge_docs, PATH)
    assert digest.filter("not round_trip").count() == 0
    assert pairs(digest, "doc_id", "n_tokens") == pairs(out, "doc_id", "n_tokens")


def test_empty_table_and_clashing_names(spark, no_docs):
    assert unigram.encode_texts(no_docs, PATH).count() == 0 and unigram.encode_and_check(no_docs, PATH).count() == 0
    got = unigram.encode_texts(spark.createDataFrame([("x", "a b")], "ids string, text string"), PATH).first()
    assert got["n_tokens"] == len(got["ids"])


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    digest = unigram.encode_and_check(docs, PATH)
    assert digest.filter("round_trip").count() == docs.count()


def test_long_text_without_spaces():
    m = unigram.load(PATH)
    text = "x" * 5000 + "中" * 3000
    assert m.decode(m.encode([text])[0].tolist()) == text
