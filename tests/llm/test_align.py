import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from staffline.llm import align
from staffline.llm.queries import BYTE_LEVEL, PIECES
from .conftest import SF, pairs


def brute(rows):
    """The contract read plainly: decoded bytes of every token, ends added up, all pairs of ends."""
    tok = Tokenizer.from_file(BYTE_LEVEL)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = align.byte_letters()
    found = []
    for doc, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False) if text else None
        ia = a.ids if a else []
        ib = sp.encode(text) if text else []
        ba = [bytes(letters[c] for c in t) for t in (a.tokens if a else [])]
        bb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
              for i, p in ((i, sp.id_to_piece(i)) for i in ib)]
        want = (" " + (text or "")).encode()
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            ia, ib, ba, bb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(x, y) for x, p in zip(ia, ea, strict=True) for y, q in zip(ib, eb, strict=True) if p == q] if len(ia) < 900 else [
            (ia[ea.index(p)], ib[eb.index(p)]) for p in sorted(set(ea) & set(eb))]
        cuts, ga, gb = sorted(set(ea) & set(eb)), [], []
        lo = 0
        for c in cuts:
            ga.append(",".join(str(i) for i, e in zip(ia, ea, strict=True) if lo < e <= c) if len(ia) < 900 else None)
            gb.append(",".join(str(i) for i, e in zip(ib, eb, strict=True) if lo < e <= c) if len(ia) < 900 else None)
            lo = c
        sha = hashlib.sha256(";".join(f"{x}|{y}" for x, y in zip(ga, gb, strict=True)).encode()).hexdigest() if cuts and ga[0] is not None else ""
        found.append((doc, len(ia), len(ib), len(cuts), links, sha))
    count = Counter(x for f in found for x in f[4])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(d, na, nb, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha)
            for d, na, nb, g, ls, sha in found]


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = ["a é 😀中 \x00  b<s><|endoftext|>", "丂x\U0001F9FF y", "a▁b", "  　 x", "ﬁ Å", "\n\n\ta  b  ", "0" * 50, "<0x41> <unk>", "é" * 20]


def check(df, rows):
    got, want = pairs(df, *COLS), sorted(brute(rows), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if w[1] < 900)


def test_equals_plain_alignment(spark, edge_docs):
    check(align.align_tokenizers(edge_docs, BYTE_LEVEL, PIECES), [(r.doc_id, r.text) for r in edge_docs.collect()])


def test_hard_characters(spark):
    rows = list(enumerate(HARD)) + [(3, HARD[0])]
    check(align.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_LEVEL, PIECES), rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(align.align_tokenizers(docs, BYTE_LEVEL, PIECES), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, no_docs):
    out = align.align_tokenizers(no_docs, BYTE_LEVEL, PIECES)
    assert out.columns == list(COLS) and out.count() == 0


def test_chunks_are_encoded_as_in_the_whole_text(monkeypatch):
    """Cut at blanks and joined again, with hardly any cache, every text has the tokens of its one whole encoding."""
    pair = align.load(BYTE_LEVEL, PIECES).pair
    rnd = random.Random(6)
    signs = ["a", "Z", "é", "中", "😀", "1", "²", "'s", ".", "-", "_", " ", " ", " ", "  ", "\n", "\u00a0", "\u3000", "\x1c", "\u0301", "ß", "<s>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    texts += [" Ab cd  12 ef\n gé h. I j's k" * 40, "a \u2581 b", "x \u0301y z"]
    monkeypatch.setattr(align, "JOINT", re.compile("(?!)"))
    whole = align.encode_aligned(align.Chunks(pair), texts)
    monkeypatch.undo()
    monkeypatch.setattr(align, "PART", 30)
    monkeypatch.setattr(align, "CACHE_BYTES", 9000)
    cut = align.encode_aligned(align.Chunks(pair), texts)
    assert sum(w is not None for w in whole) > 350
    for t, w, c in zip(texts, whole, cut, strict=True):
        assert (w is None) == (c is None), t
        assert w is None or (w[:2] == c[:2] and w[3] == c[3] and (w[2] == c[2]).all()), t


@pytest.mark.parametrize("sure", [[1, 1, 1, 1], [1, 0, 0, 1], [0, 0, 0, 0]])
def test_refine_follows_decoded_bytes(sure):
    decoded = np.array([2, 1, 3, 2])
    end = np.cumsum(decoded)
    begin = end - decoded
    coarse = np.where(np.array(sure, bool), end, 6)
    assert (align.refine(np.where(np.array(sure, bool), begin, 0), coarse, decoded, 8) == end).all()


def test_bound_holds(spark):
    pair = align.load(BYTE_LEVEL, PIECES).pair
    suffix_pairs = 0
    of = Counter(pair.b.raw)
    for raw in pair.a.raw:
        suffix_pairs += sum(of[raw[i:]] for i in range(len(raw)))
    of = Counter(pair.a.raw)
    for raw in pair.b.raw:
        suffix_pairs += sum(of[raw[i:]] for i in range(1, len(raw)))
    assert suffix_pairs <= align.pair_bound(pair) < 2_000_000
