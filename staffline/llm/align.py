"""Alignment of two tokenizers over the same texts: byte ranges, common cuts, linked tokens.

A is a byte-level vocabulary read by the tokenizers library, which gives character offsets; B a
SentencePiece model, whose immutable proto gives a span for each piece. Both kinds of spans are
coarse cuts only: a byte-level token may end inside a character (its offsets then cover the whole
character, as its neighbours' do), and byte-fallback pieces share one span. Such tokens are placed
by the length of their decoded bytes, from the last sure cut before them.

Where a token of A and one of B end at the same byte the text is cut; the tokens between two cuts
are one group, and the two that end together are linked. Links are counted over all documents by
pair of ids. Two linked tokens end in the same bytes, so one's bytes are a suffix of the other's:
the number of pairs is bounded by the two vocabularies, whatever the corpus
(``pair_bound``), and only that table reaches the driver and the tasks.

Defined results: a text that is null or empty, or whose decoded tokens of A or of B are not the
bytes of space + text, has no tokens, zero counts and '' as its hash; strings of special tokens are plain
text; repeated rows are rows of their own (each counts); an empty table gives an empty one; other
columns are left out.

Texts are cut at single blanks between words, where a byte-level token always begins with the blank and
no piece reaches over its marker (checked when the model is loaded); the chunks are aligned on their own,
many at once, and the ones met lately are kept, so a long text needs no more memory than its chunks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.store import staged

PART = 1 << 17           # characters of the chunks encoded at once
BLOCK = 1 << 20          # characters of the texts handled at once
SLICE = 64               # rows made Python strings at once
CACHE_BYTES = 192 << 20  # of the aligned chunks that a worker keeps
ENTRY_BYTES, CHARACTER_BYTES = 420, 10  # of a kept chunk: at rest, and for each of its characters
#: A blank between two characters that are neither blanks nor marks: neither tokenizer joins over it.
JOINT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_letters() -> dict[str, int]:
    """Byte of each letter of byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """Decoded bytes, their lengths and the decimal ids of one vocabulary."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.length = np.array([len(b) for b in raw], np.int64)

    def join(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])


def refine(begin: np.ndarray, end: np.ndarray, decoded: np.ndarray, total: int) -> np.ndarray:
    """Byte ends of consecutive tokens from their coarse byte spans: a span as long as the token's
    decoded bytes is a sure cut, the other tokens follow the last sure cut by their decoded lengths.
    ``total``: bytes of the text; spans that don't add up to it give way to the decoded lengths."""
    run = np.cumsum(decoded)
    sure = (end - begin) == decoded
    last = np.maximum.accumulate(np.where(sure, np.arange(len(run)), -1))
    ends = np.where(last >= 0, end[last] + run - run[last], run)
    before = np.concatenate([[0], ends[:-1]])
    if len(ends) and (ends[-1] != total or ((ends - before) != decoded).any()):
        return run
    return ends


class Pair:
    """Both encoders. ``path_a``: a tokenizers file (byte level); ``path_b``: a SentencePiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path_a)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        size = self.tok.get_vocab_size()
        entries = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.a = Side([bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries])
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.b = Side([bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode()
                       for p in pieces])
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece holds a marker behind other characters")
        self.shift = len(self.b.raw)
        # decimal ids followed by the separators they can have: A inside, A last, B inside, B last
        self.words = [f"{i}{s}" for n, seps in ((size, ",|"), (self.shift, ",;")) for i in range(n) for s in seps]
        self.letters = np.array([len(w) for w in self.words])
        self.from_b = 2 * size

    def spans_a(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) by character of space + text."""
        out = []
        for e in self.tok.encode_batch([" " + t for t in texts], add_special_tokens=False):
            at = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e.ids)).reshape(-1, 2)
            out.append((np.array(e.ids, np.int64), at[:, 0], at[:, 1]))
        return out

    def spans_b(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) by byte of the text, from the proto."""
        out = []
        for p in self.sp.encode(texts, return_type="proto", num_threads=1):
            got = np.array([v for x in p.pieces for v in (x.id, x.end)], np.int64).reshape(-1, 2)
            end = got[:, 1]
            out.append((got[:, 0], np.concatenate([[0], end[:-1]]), end))
        return out

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """(ids of A, their byte ends in space + text, ids of B, theirs) of each text, None if the decoded
        bytes of either are not space + text."""
        if not texts:
            return []
        out: list = []
        for t, (ia, fa, ea), (ib, fb, eb) in zip(texts, self.spans_a(texts), self.spans_b(texts), strict=True):
            data = (" " + t).encode()
            if self.a.join(ia) != data or self.b.join(ib) != data:
                out.append(None)
                continue
            if len(data) != len(t) + 1:  # characters to bytes
                lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                at = np.append(lead, len(data))
                fa, ea = at[fa], at[ea]
            # the model puts the blank in front: its first piece begins with it
            out.append((ia, refine(fa, ea, self.a.length[ia], len(data)),
                        ib, refine(np.where(fb > 0, fb + 1, 0), eb + 1, self.b.length[ib], len(data))))
        return out

    def groups(self, ia, ea, ib, eb) -> tuple[np.ndarray, np.ndarray, str, np.ndarray]:
        """Places in A and in B of the tokens that end together, the groups as text (each with its separator), and
        the characters of that text up to every token in it."""
        cuts = np.intersect1d(ea, eb, assume_unique=True)
        la, lb = np.searchsorted(ea, cuts), np.searchsorted(eb, cuts)
        ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)  # group of each token
        last_a, last_b = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
        last_a[la], last_b[lb] = True, True
        order = np.empty(len(ia) + len(ib), np.int64)
        order[np.arange(len(ia)) + np.append(0, lb + 1)[ga]] = 2 * ia + last_a
        order[np.arange(len(ib)) + (la + 1)[gb]] = self.from_b + 2 * ib + last_b
        words = self.words
        return la, lb, "".join([words[k] for k in order.tolist()]), np.cumsum(self.letters[order])


def joins(chunk: str) -> bool:
    """Whether a chunk begins and ends with characters that ``JOINT`` takes, so that it may stand beside others."""
    a, b = chunk[0], chunk[-1]
    return ("!" <= a <= "~" or a.isalnum()) and ("!" <= b <= "~" or b.isalnum())


Entry = tuple[int, int, str, bytes]  # tokens of A, of B, the groups as text, the linked pairs as 64-bit integers


class Chunks:
    """Aligned chunks, the last ones used of at most ``CACHE_BYTES``: two generations, of which the older goes. A worker
    keeps them for its next task."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.new: dict[str, Entry | None] = {}
        self.old: dict[str, Entry | None] = {}
        self.size = 0

    def add(self, chunks: set[str]) -> dict[str, Entry | None]:
        """The kept entries, after those of ``chunks`` that aren't among them were added: each chunk's own, None where its
        decoded tokens are not its bytes."""
        if self.size > CACHE_BYTES // 2:
            self.old, self.new, self.size = self.new, {}, 0
        new, missing = self.new, []
        added = [c for c in chunks if c not in new]
        for c in added:
            if c in self.old:
                new[c] = self.old[c]
            else:
                missing.append(c)
        self.size += ENTRY_BYTES * len(added) + CHARACTER_BYTES * sum(map(len, added))
        plain, rest = [], []
        for c in missing:
            (plain if joins(c) else rest).append(c)
        lo = 0
        while lo < len(plain):  # as many as make a text of about PART characters
            hi, size = lo, 0
            while hi < len(plain) and size < PART:
                size += len(plain[hi]) + 1
                hi += 1
            made = self._together(plain[lo:hi])
            if made is None:  # one of them has other bytes
                rest += plain[lo:hi]
            else:
                new.update(zip(plain[lo:hi], made, strict=True))
            lo = hi
        for c in rest:
            made = self._together([c])
            new[c] = None if made is None else made[0]
        return new

    def _together(self, chunks: list[str]) -> list[Entry] | None:
        """The chunks aligned as one text, joined by the blanks that both encoders put in front of each."""
        got = self.pair.align([" ".join(chunks)])[0]
        if got is None:
            return None
        ia, ea, ib, eb = got
        la, lb, groups, upto = self.pair.groups(ia, ea, ib, eb)
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        a, b = np.searchsorted(ea, ends), np.searchsorted(eb, ends)  # last token of each chunk: both end there
        g = np.searchsorted(ea[la], ends)  # its last group
        pairs = (ia[la] * self.pair.shift + ib[lb]).tobytes()
        out, a0, b0, g0, s0 = [], 0, 0, 0, 0
        for x, y, z, s in zip((a + 1).tolist(), (b + 1).tolist(), (8 * g + 8).tolist(), upto[a + b + 1].tolist(), strict=True):
            out.append((x - a0, y - b0, groups[s0:s - 1], pairs[g0:z]))
            a0, b0, g0, s0 = x, y, z, s
        return out


@functools.lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Chunks:
    return Chunks(Pair(path_a, path_b))


def encode_aligned(chunks: Chunks, texts: list[str | None]) -> list[tuple | None]:
    """(n_a, n_b, linked pairs, hash of the groups) of each text, None without tokens."""
    cut = [JOINT.split(t) if t else [] for t in texts]
    known = chunks.add({c for cs in cut for c in cs})
    out: list = []
    for cs in cut:
        found = [known[c] for c in cs]
        if not found or None in found:
            out.append(None)
            continue
        n_a, n_b, told, links = zip(*found, strict=True)
        out.append((sum(n_a), sum(n_b), np.frombuffer(b"".join(links), np.int64), hashlib.sha256(";".join(told).encode()).hexdigest()))
    return out


def _blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    block, size = [], 0
    for lo in range(0, len(texts), SLICE):
        for t in texts.slice(lo, SLICE).to_pylist():
            block.append(t)
            size += len(t or "")
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and the text's linked pairs: ``pair`` (id of A times
    the size of B plus id of B, each once) and ``times``. Groups and links are as many: each cut ends
    one token of A and one of B, as no token is empty."""
    counts = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pair", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = load(path_a, path_b)
        none = np.zeros(0, np.int64)
        for batch in batches:
            start = 0
            for block in _blocks(batch.column(text_col)):
                rows = encode_aligned(chunks, block)
                kinds = [(none, none) if r is None else np.unique(r[2], return_counts=True) for r in rows]
                ends = pa.array(np.cumsum([0, *[len(c) for c, _ in kinds]]), pa.int32())
                n = [(0, 0, 0) if r is None else (r[0], r[1], len(r[2])) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(id_col).slice(start, len(block)), *[pa.array([x[i] for x in n], pa.int64()) for i in (0, 1, 2, 2)],
                    pa.array(["" if r is None else r[3] for r in rows], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c for c, _ in kinds]), pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t for _, t in kinds]).astype(np.int32), pa.int32()))],
                    names=schema.names)
                start += len(block)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_bound(pair: Pair) -> int:
    """Most pairs of ids that can be linked: one's bytes are a suffix of the other's, so each token has at
    most as many partners among shorter ones as it has suffixes, times the ids that share the same bytes."""
    def most_alike(side: Side) -> int:
        return int(np.unique(np.array(side.raw, object), return_counts=True)[1].max())

    return int(pair.a.length.sum() * most_alike(pair.b) + pair.b.length.sum() * most_alike(pair.a))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links) over all documents: summed inside each task before the shuffle."""
    return (rows.select(F.explode(F.arrays_zip("pair", "times")).alias("x"))
            .groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.times").alias("links")))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``n_best``: links whose pair is the most frequent of its B id in the corpus, ties included;
    ``count_sum``: the corpus counts of the pairs, summed over the document's links."""
    rows = staged(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    pair = load(path_a, path_b).pair
    table = pair_counts(rows).toArrow()
    if table.num_rows > (bound := pair_bound(pair)):
        raise RuntimeError(f"{table.num_rows} linked pairs, {bound} at most in these vocabularies")
    codes, links = table["pair"].to_numpy(), table["links"].to_numpy()
    order = np.argsort(codes)
    codes, links = codes[order], links[order]
    top = np.zeros(pair.shift, np.int64)
    np.maximum.at(top, codes % pair.shift, links)
    shared = docs.sparkSession.sparkContext.broadcast((codes, links, links == top[codes % pair.shift]))  # pair_bound rows at most
    schema = T.StructType([*rows.schema.fields[:5], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           rows.schema["groups_sha256"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, links, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pair"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(codes, pairs.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(np.diff(pairs.offsets.to_numpy()))])

            def total(v: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                upto = np.concatenate([[0], np.cumsum(v)])
                return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

            yield pa.RecordBatch.from_arrays([*batch.columns[:5], total(times * best[at]), total(times * links[at]),
                                              batch.column("groups_sha256")], names=schema.names)

    return rows.mapInArrow(run, schema)
