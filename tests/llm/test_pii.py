import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staffline.llm import pii
from tests.llm.conftest import SF, pairs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def crf():
    return pii.train()


def checksum(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    t = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and checksum(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789.@+-() aB_%é4", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "999.1.1.1.5", "+1 (017) 555-7713", "4111 1111 1111 1111", "4111111111111112",
                                 "x", "@", ".", "+", " ", "5.6", "\n"]), max_size=12))
def test_base_spans_of_joined_pieces(parts):
    assert pii.base_spans("".join(parts)) == brute("".join(parts))


def check(docs, crf):
    got = {}
    for r in pii.scan_pii(docs, crf=crf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in docs.select("doc_id", "text").collect():
        base = brute(r["text"])
        for g in got[r["doc_id"]]:
            assert [g[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert g["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            every = [s for s in g["spans"].split(",") if s]
            assert set(filter(None, joined.split(","))) <= set(every)
            order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
            assert order == sorted(order)
    assert sum(map(len, got.values())) == docs.count()


def test_whole_table(spark, crf):
    check(spark.read.parquet(f"{SF}/documents.parquet"), crf)


def test_edges(spark, edge_docs, no_docs, crf):
    for r in pii.scan_pii(edge_docs, crf=crf).filter("doc_id = 2 or doc_id = 3").collect():
        assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    same = pii.mask_pii(edge_docs, crf=crf)
    assert same.schema == edge_docs.schema
    assert pairs(same.filter("doc_id != 8"), *same.columns) == pairs(edge_docs.filter("doc_id != 8"), *same.columns)
    assert same.filter("doc_id = 8").first()["text"].endswith("license <EMAIL>")
    assert pii.scan_pii(no_docs, crf=crf).count() == 0 and pii.mask_pii(no_docs, crf=crf).count() == 0


def test_long_runs_stay_linear(crf):
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "@" * 50_000, "(at)" * 30_000):
        pii.find_spans(crf, [text])


def test_model_finds_what_the_patterns_miss(crf):
    cases = {"please tel (415) 555-0199 or": "phone", "my ssn is 321-54-9876 ok": "id", "mail kate [at] example [dot] net now": "email",
             "iban DE44 5001 0517 5407 3249 31 please": "iban"}
    for text, kind in cases.items():
        (base, every), = pii.find_spans(crf, [text])
        assert base == [] and [s[0] for s in every] == [kind], (text, every)


def test_clean_texts_have_no_spans(crf):
    for text in ("version 4.5.6 of 2023-04-05, pages 3-7", "score 10 at 11:30, room 212", "order 7536784127813051", "no digits at all"):
        assert pii.find_spans(crf, [text]) == [([], [])]


def test_training_table_is_learned(crf):
    wrong = 0
    for row in pii.LABELLED:
        text, spans = pii._marked(row)
        wrong += sorted(pii.model_spans(crf, [text])[0]) != sorted(spans)
    assert wrong <= 0.06 * len(pii.LABELLED)


def whole_text_spans(crf, text):
    ts = [m.span() for m in pii.TOKEN.finditer(text)]
    return [(k, ts[a][0], ts[b - 1][1]) for _, spans in pii._decoded(crf, [(None, crf.codes(text, ts))]) for k, a, b in spans]


def test_stretches_cut_no_span(crf):
    around = ("we all went there for a long walk by the sea and then she said so ", " and all of them went home by the old road")
    for row in pii.LABELLED:
        text, spans = pii._marked(row)
        if spans:
            assert pii.model_spans(crf, [text])[0] == whole_text_spans(crf, text), text
            assert set(spans) <= set(pii.find_spans(crf, [text])[0][1]), text
    for text in ("mary.smith [at] mail.example.com", "jane [at] secure.mail.example.com", "jane [AT] example [DOT] com"):
        for long in (text, around[0] + "mail " + text + around[1]):
            assert pii.model_spans(crf, [long])[0] == whole_text_spans(crf, long), long
    long = around[0] + "contact mary.smith [at] mail.example.com soon"
    assert pii.masked(long, pii.find_spans(crf, [long])[0][1]) == around[0] + "contact <EMAIL> soon"


def test_every_at_and_dot_is_decoded():
    for text in ("jane [AT] example [DOT] com", "jane at example dot com"):
        t = pii.Tokens(text)
        assert pii.stretches(text, t).tolist() == [[0, t.n]]


def test_viterbi_against_all_paths(crf):
    codes = np.array(crf.codes("(415) 55", [m.span() for m in pii.TOKEN.finditer("(415) 55")]))[None]
    labels = crf.viterbi(codes, np.array([codes.shape[1]]))[0]
    e, trans = crf.emissions(codes)[0], crf.allowed

    def value(path):
        return sum(e[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)) + (
            0 if pii.START_OK[path[0]] else -1e9)

    assert np.isclose(value(labels), max(value(p) for p in itertools.product(range(pii.K), repeat=codes.shape[1])))
