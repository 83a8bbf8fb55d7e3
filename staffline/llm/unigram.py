"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece model file (path is a parameter). Text is not normalised; white
space is marked with U+2581, with one marker put in front. The best segmentation maximises the sum
of the pieces' log scores; characters no piece covers become byte pieces. If the file's scores are
merge ranks (a BPE vocabulary), the log scores are those of Zipf's law over the ranks.

No piece reaches over the start of a marked word (pieces with inner markers are only runs of them),
so the text falls into words that are segmented on their own, with the same result. The distinct
words of a batch are segmented together: numpy walks the trie from one position of all words at
once, and the Viterbi tables of words of like length are filled side by side.

Defined results: a null text has no ids (null ids) and decodes to null; an empty text has no ids;
a text that holds U+2581 decodes with a space in its place; repeated rows are rows of their own;
an empty table gives an empty one; other columns are carried along, and an ``ids`` or ``n_tokens``
column of the input is replaced.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNK_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_BYTES = 24 << 20  # of distinct words kept per task, with their ids
ENTRY_BYTES = 220       # of a kept word besides its characters and ids
BLOCK = 1 << 19         # cells of one Viterbi table
TEXT_BLOCK = 1 << 20    # characters of the texts handled at once
SLICE = 64              # rows made Python strings at once


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[i:i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, buf[i:i + n]
            i += n


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) in id order, and the trainer's model type (1 unigram, 2 BPE)."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, model = [], 1
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            model = dict(_fields(value)).get(3, 1)
    return pieces, model


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log probabilities by Zipf's law over the normal pieces, best file score first."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    ranks = np.arange(1, len(order) + 1)
    logs = -np.log(ranks + 1.0) - np.log((1 / (ranks + 1.0)).sum())
    out = [0.0] * len(pieces)
    for i, v in zip(order, logs.astype(np.float32).tolist(), strict=True):
        out[i] = v
    return out


class DoubleArray:
    """A trie in two arrays over dense symbol codes: child t of state s by symbol c is base[s] + c,
    valid if check[t] is s. ``value[s]`` is the piece that ends in s, or -1."""

    def __init__(self, keys: list[tuple[tuple[int, ...], int]], symbols: int):
        self.symbols = symbols
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = -2
        free = 1  # no free cell below
        todo = [(0, 0, 0, len(keys))]  # state, depth, range of the sorted keys
        keys = sorted(keys)
        while todo:
            s, depth, lo, hi = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                self.value[s] = keys[lo][1]
                lo += 1
            kids = []
            while lo < hi:
                c, end = keys[lo][0][depth], lo
                while end < hi and keys[end][0][depth] == c:
                    end += 1
                kids.append((c, lo, end))
                lo = end
            if not kids:
                continue
            cs = np.array([c for c, *_ in kids])
            while self.check[free] != -1:
                free += 1
                self._grow(free + symbols)
            at = max(free, int(cs[0]) + 1)
            while True:  # the next free cell where all children fit
                self._grow(at + symbols)
                if self.check[at] == -1 and (self.check[at - cs[0] + cs] == -1).all():
                    break
                at += 1
            b = at - int(cs[0])
            self.base[s] = b
            self.check[b + cs] = s
            todo += [(b + c, depth + 1, a, z) for c, a, z in kids]

    def _grow(self, need: int) -> None:
        if need >= len(self.check):
            more = max(need + 1 - len(self.check), len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Children by symbol, -1 where there is none (or state is -1 or symbol is negative)."""
        t = np.where((state >= 0) & (symbol >= 0), self.base[state] + symbol, 0)
        ok = (state >= 0) & (symbol >= 0) & (t < len(self.check))
        t = np.where(ok, t, 0)
        return np.where(ok & (self.check[t] == state), t, -1)


class Cache:
    """Words and their ids (as bytes) of at most ``CACHE_BYTES``; emptied when full."""

    def __init__(self) -> None:
        self.words: dict[str, bytes] = {}
        self.size = 0

    def keep(self, word: str, ids: bytes) -> bytes:
        need = ENTRY_BYTES + 4 * len(word) + len(ids)
        if self.size + need > CACHE_BYTES:
            self.words.clear()
            self.size = 0
        if need <= CACHE_BYTES:
            self.words[word] = ids
            self.size += need
        return ids


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float]):
        self.pieces = pieces
        normal = [(i, p) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        chars = sorted({c for _, p in normal for c in p})
        self.symbol = {c: k for k, c in enumerate(chars)}
        self.codes = np.full(0x110000, -1, np.int32)
        for c, k in self.symbol.items():
            self.codes[ord(c)] = k
        self.trie = DoubleArray([(tuple(self.symbol[c] for c in p), i) for i, p in normal], len(chars))
        self.score = np.array(scores, np.float32)
        self.longest = max((len(p) for _, p in normal), default=1)
        if any(MARK in p.lstrip(MARK) for _, p in normal):
            raise ValueError("a piece holds a marker behind other characters")
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.unk_score = np.float32(min((float(self.score[i]) for i, _ in normal), default=0.0) - UNK_PENALTY)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN)
                    else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.byte_ids = np.full(256, self.unk, np.int64)
        for b, i in self.byte.items():
            self.byte_ids[b] = i

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Best pieces of each word."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * (len(words[order[hi]]) + 1) <= BLOCK:
                hi += 1
            at = order[lo:hi]
            for i, ids in zip(at, self._viterbi([words[i] for i in at]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _viterbi(self, words: list[str]) -> list[np.ndarray]:
        n, width = len(words), len(words[-1])
        length = np.array([len(w) for w in words])
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        text = np.full((n, width + 1), -1, np.int32)
        text[np.arange(width + 1)[None, :] < length[:, None]] = self.codes[cp]
        best = np.full((n, width + 1), -np.inf, np.float32)
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        first = 0  # words are sorted by length: those before ``first`` have ended
        for i in range(width):
            while first < n and length[first] <= i:
                first += 1
            rows = np.arange(first, n)
            state, here = np.zeros(len(rows), np.int64), best[rows, i]
            single = np.zeros(len(rows), bool)
            for j in range(i, min(width, i + self.longest)):
                state = self.trie.step(state, text[rows, j])
                go = state >= 0
                if not go.any():
                    break
                if not go.all():
                    state = state[go]
                    if j == i:
                        keep = np.nonzero(go)[0]
                        live = keep
                    else:
                        live = live[go]
                    rows, here = rows[go], here[go]
                elif j == i:
                    live = np.arange(len(rows))
                v = self.trie.value[state]
                total = here + self.score[v]
                better = (v >= 0) & (total > best[rows, j + 1])
                r = rows[better]
                best[r, j + 1], back[r, j + 1], piece[r, j + 1] = total[better], i, v[better]
                if j == i:
                    single[live[v >= 0]] = True
            lone = np.arange(first, n)[~single]
            total = best[lone, i] + self.unk_score
            better = total > best[lone, i + 1]
            r = lone[better]
            best[r, i + 1], back[r, i + 1], piece[r, i + 1] = total[better], i, -1
        return [self._path(words[k], back[k], piece[k]) for k in range(n)]

    def _path(self, word: str, back: np.ndarray, piece: np.ndarray) -> np.ndarray:
        ids: list[int] = []
        back_, piece_ = back[:len(word) + 1].tolist(), piece[:len(word) + 1].tolist()
        i = len(word)
        while i > 0:
            j = back_[i]
            if piece_[i] >= 0:
                ids.append(piece_[i])
            elif self.byte:
                ids += self.byte_ids[list(word[j:i].encode("utf-8", "surrogatepass"))][::-1].tolist()
            else:
                ids.append(self.unk)
            i = j
        return np.array(ids[::-1], np.int32)

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, texts: list[str | None], cache: Cache | None = None) -> list[np.ndarray | None]:
        """Ids of each text; None for None."""
        cache = Cache() if cache is None else cache
        split = [None if t is None else WORDS.findall(self.marked(t)) for t in texts]
        here = {w: cache.words.get(w) for ws in split if ws for w in ws}
        new = [w for w, ids in here.items() if ids is None]
        for w, ids in zip(new, self.segment(new), strict=True):
            here[w] = cache.keep(w, ids.tobytes())
        return [None if ws is None else np.frombuffer(b"".join([here[w] for w in ws]), np.int32) for ws in split]

    def decode(self, ids) -> str:
        """The text of ids: markers become spaces, and the one in front goes."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    pieces, model = read_pieces(path)
    return Unigram(pieces, zipf_scores(pieces) if model == 2 else [s for _, s, _ in pieces])


def _blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The column's texts, about ``TEXT_BLOCK`` characters at once."""
    block, size = [], 0
    for lo in range(0, len(texts), SLICE):
        for t in texts.slice(lo, SLICE).to_pylist():
            block.append(t)
            size += len(t or "")
            if size >= TEXT_BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """``docs`` plus ``ids`` (array of int) and ``n_tokens`` (long, 0 for null). ``path``: a model file
    that every worker can read. With ``check`` also round_trip, as encode_and_check has it."""
    docs = docs.drop("ids", "n_tokens", *["round_trip"] * check)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * check])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(path), Cache()
        for batch in batches:
            start = 0
            for block in _blocks(batch.column(text_col)):
                ids = model.encode(block, cache)
                sizes = [0 if x is None else len(x) for x in ids]
                ends = pa.array([None if x is None else o for x, o in zip(ids, np.cumsum([0, *sizes[:-1]]), strict=True)]
                                + [sum(sizes)], pa.int32())
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                part = batch.slice(start, len(block))
                same = [pa.array([model.decode([] if x is None else x.tolist()) == (t or "").replace(MARK, " ")
                                  for t, x in zip(block, ids, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.array(sizes, pa.int64()), *same],
                    names=schema.names)
                start += len(block)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus the text of the ids in column ``out``."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_bytes (tokens that are byte pieces), ids_crc32 (of the ids as little-endian 32-bit
    integers) and round_trip: whether decoding gives the text back, spaces standing for U+2581."""
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_bytes", "ids_crc32")],
                           T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        model, cache = load(path), Cache()
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte.values())] = True
        for batch in batches:
            n, b, crc, ok = [], [], [], []
            for block in _blocks(batch.column(text_col)):
                for text, ids in zip(block, model.encode(block, cache), strict=True):
                    ids = np.zeros(0, np.int32) if ids is None else ids
                    n.append(len(ids))
                    b.append(int(is_byte[ids].sum()))
                    crc.append(zlib.crc32(ids.astype("<i4").tobytes()))
                    ok.append(model.decode(ids.tolist()) == (text or "").replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())],
                names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
