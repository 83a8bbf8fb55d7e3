"""Personal data: fixed patterns plus a linear-chain CRF over word shapes.

Base spans are the leftmost non-overlapping matches of four patterns that pass their check (parts of
an IP address, Luhn digits, number of digits). The CRF adds spans the patterns miss (numbers without a
country code, spelled-out addresses, national ids, IBANs); where it overlaps a base span, the base
span stays.

The CRF is trained on the driver from a small labelled table (a parameter). Its tokens are words, digit
runs and single signs; features are the shapes of a token and its neighbours, spacing, and a few cue
words. Decoding starts from the tokens within ``REACH`` of a trigger (a digit, ``@`` or the word at or
dot, in any case), on to the next blanks; each such stretch is one sequence, and one whose span comes
near its edge is decoded again with a wider stretch, until the span ends inside. The sequences of a batch are decoded together by Viterbi in
numpy, side by side in blocks of bounded size.

Defined results: a null text counts as empty (no spans; masking keeps it null); positions are code
points, ends exclusive; repeated rows are rows of their own; an empty table gives an empty one; other
columns are carried along by masking and not looked at by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: the kinds in their listed order, then those only the model finds
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "iban")

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
TRIGGER = re.compile(r"\d+|@|(?<![^\W\d_])(?:at|dot)(?![^\W\d_])", re.IGNORECASE)
REACH = 6
EDGE = 2  # tokens that the features look ahead and back
CUES = ("at", "dot", "tel", "phone", "call", "fax", "mobile", "ssn", "security", "iban", "account", "mail", "email", "contact", "id")
CELLS = 1 << 20  # cells of one block of sequences

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[Span]:
    """Each four numbers in a row of a dotted chain are one match of the pattern."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    back = [ord(d) - 48 for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Checked matches of the fixed patterns, by kind and start."""
    t = text or ""
    out = [*_emails(t), *_addresses(t)]
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 16:
            d = NOT_DIGIT.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# -- the CRF --

# the small labelled table: {kind:value} marks a span
LABELLED = (
    "call me on {phone:555-123-4567} after six", "tel {phone:(212) 555-0187} or fax {phone:(212) 555-0188}",
    "phone: {phone:415-555-2671}.", "mobile {phone:(617) 555-9012}, ask for the desk", "Call {phone:(305) 555-4410} today",
    "contact {phone:+1 (017) 555-7713} now", "reach us at {phone:+49 30 1234567} or {phone:+33 1 23 45 67 89}",
    "tel. {phone:030-555-7788} ext 4", "our phone is {phone:(044) 668-1800} on weekdays", "Fax {phone:604-555-3322}, please",
    "mail {email:jane.doe@mail7.example.com} for it", "write to {email:bob@example.org}, thanks",
    "{email:x.y-z@a-b.example.net} said", "her mail: {email:user.34@mail3.example.com}",
    "mail {email:jane (at) example (dot) com} for it", "write to {email:bob [at] example [dot] org}, thanks",
    "contact {email:mary.smith [at] mail.example.com} soon", "email {email:info (at) example.net} now",
    "from {ip:97.51.17.173} at night", "host {ip:10.0.0.12} and {ip:192.168.1.254}.", "the {ip:161.17.88.162} address",
    "card {card:4845168114407329} was used", "paid with {card:4111 1111 1111 1111} on time", "no {card:5500-0000-0000-0004},",
    "ssn {id:078-05-1120} on file", "social security {id:219-09-9999}.", "his id {id:123-45-6789} is known",
    "SSN: {id:457-55-5462}", "the ssn is {id:987-65-4321}, he said", "iban {iban:DE89 3704 0044 0532 0130 00} please",
    "pay to {iban:GB29 NWBK 6016 1331 9268 19} now", "account {iban:FR14 2004 1010 0505 0001 3}", "IBAN {iban:ES91 2100 0418 4502 0005}",
    # nothing personal
    "version 2.0 and 3.1.4 came out", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "in 2024 there were 12 of 30", "on 2024-01-02 at 10:30 we met", "pages 10-20, 30-45 and 7", "costs 1,299.00 or 1.299,00 each",
    "the GNU General Public License, version 3.", "a score of 3-2 and then 100-98", "chapter 12, section 4.2.1, line 7",
    "order 9807915762804490 was sent", "number 23904095 and 427004852 too", "isbn 978-3-16-148410-0 in print",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" here", "key 7f3a-99bc-12de of the list", "see [1] and (2), also [3]",
    "look (at) it", "the score is 10 at half time", "x = 3 * 4 + 5 - 1", "12 | 45 | 88 | 901", "page=2&ref=x 45", "follow @user now",
    "$12 and 50% of 1000000", "on 12.05.2020 and 1/3/2021", "2020-05-01T10:00:00.123", "100 200 300 400 500", "item #12-345 in box 6",
    "a room 212-214 for 4", "from 1990-1995 to 2001-2003", "ratio 16:9, 4:3", "id 4711 of 9000", "account 12345 was closed",
    "call 911 now", "phone model 3310", "tel 12", "the id of row 77", "7536784127813050 of these",
)

O = 0  # noqa: E741 - the outside label
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(LABELS)
START_OK = np.array([x == "O" or x[0] == "B" for x in LABELS])
FOLLOWS = np.array([[b[0] != "I" or (a != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])


def shape(token: str) -> str:
    if token.isdigit():
        n = len(token)
        return f"d{n}" if n <= 5 else "d6-9" if n < 10 else "d10-15" if n < 16 else "d16+"
    if token[0].isalpha():
        low = token.lower()
        if low in CUES:
            return "w:" + low
        if token.isupper():
            return "X" if len(token) > 2 else "XX"
        return "Xx" if token[0].isupper() else "x"
    return token if ord(token) < 128 else "?"


class Tokens:
    """Token extents of a text, and where its blank-separated chunks begin."""

    def __init__(self, text: str):
        at = np.fromiter((x for m in TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
        self.starts, self.ends = at[:, 0], at[:, 1]
        self.n = len(at)
        new = np.nonzero(self.starts[1:] > self.ends[:-1])[0] + 1
        self.chunks = np.concatenate([[0], new, [self.n]])

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Token ranges widened to whole chunks, and those that meet merged: rows (lo, hi)."""
        lo, hi = np.clip(lo, 0, self.n - 1), np.clip(hi, 1, self.n)
        lo = self.chunks[np.searchsorted(self.chunks, lo, "right") - 1]
        hi = self.chunks[np.searchsorted(self.chunks, hi, "left")]
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        first = np.concatenate([[True], lo[1:] > hi[:-1]])
        last = np.concatenate([first[1:], [True]])
        return np.stack([lo[first], hi[last]], 1)

    def extents(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return list(zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True))


def stretches(text: str, tokens: Tokens) -> np.ndarray:
    """Token ranges (lo, hi) of every stretch of tokens within REACH of a trigger, in order."""
    at = np.fromiter((x for m in TRIGGER.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    return tokens.whole(np.searchsorted(tokens.starts, at[:, 0]) - REACH, np.searchsorted(tokens.starts, at[:, 1]) + REACH)


class Crf:
    """Weights by feature id, label transitions, and the shape ids they were learned over."""

    OFFSETS = ((0,), (-1,), (1,), (-2,), (2,), (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (-2, -1, 0, 1, 2))

    def __init__(self, shapes: dict[str, int]):
        self.shapes = shapes
        self.size = len(shapes) * 2 + 2  # each with and without a space before; 0 is outside, 1 unknown
        self.keys = [np.zeros(0, np.int64) for _ in self.OFFSETS]
        self.weights = [np.zeros((1, K)) for _ in self.OFFSETS]
        self.trans = np.zeros((K, K))

    def codes(self, text: str, tokens: list[tuple[int, int]]) -> list[int]:
        out = []
        for a, b in tokens:
            i = self.shapes.get(shape(text[a:b]))
            out.append(1 if i is None else 2 + 2 * i + (a > 0 and text[a - 1].isspace()))
        return out

    def feature_keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """codes: (sequences, length), 0 beyond the end. One key array for each entry of OFFSETS."""
        n, width = codes.shape
        pad = np.zeros((n, width + 4), np.int64)
        pad[:, 2:-2] = codes
        out = []
        for offsets in self.OFFSETS:
            key = np.zeros((n, width), np.int64)
            for o in offsets:
                key = key * self.size + pad[:, 2 + o:2 + o + width]
            out.append(key)
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        e = np.zeros((*codes.shape, K))
        for key, known, w in zip(self.feature_keys(codes), self.keys, self.weights, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                e += np.where((known[at] == key)[..., None], w[at], 0)
        return e

    @property
    def allowed(self) -> np.ndarray:
        return np.where(FOLLOWS, self.trans, -1e9)

    def viterbi(self, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels, side by side; beyond a sequence's end O."""
        n, width = codes.shape
        e, trans = self.emissions(codes), self.allowed
        score = np.where(START_OK, e[:, 0], -1e9)
        back = np.zeros((n, width, K), np.int8)
        for t in range(1, width):
            step = score[:, :, None] + trans[None]
            back[:, t] = step.argmax(1)
            new = step.max(1) + e[:, t]
            live = (t < length)[:, None]
            score = np.where(live, new, score)
            back[:, t] = np.where(live, back[:, t], np.arange(K))
        labels = np.zeros((n, width), np.int64)
        labels[:, -1] = score.argmax(1)
        for t in range(width - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
        labels[np.arange(width)[None, :] >= length[:, None]] = O
        return labels


def _marked(row: str) -> tuple[str, list[Span]]:
    text, spans = "", []
    for part in re.split(r"(\{[a-z]+:[^}]*\})", row):
        m = re.fullmatch(r"\{([a-z]+):([^}]*)\}", part)
        if m:
            spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2] if m else part
    return text, spans


def train(rows: tuple[str, ...] = LABELLED, steps: int = 120, l2: float = 0.02) -> Crf:
    """Maximum likelihood by Adam; gradients by forward-backward over all rows side by side."""
    parsed = [_marked(r) for r in rows]
    tokens = [[m.span() for m in TOKEN.finditer(t)] for t, _ in parsed]
    shapes = {s: i for i, s in enumerate(sorted({shape(t[a:b]) for (t, _), ts in zip(parsed, tokens, strict=True) for a, b in ts}))}
    crf = Crf(shapes)
    n, width = len(rows), max(map(len, tokens))
    codes, gold, length = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.array(list(map(len, tokens)))
    for i, ((text, spans), ts) in enumerate(zip(parsed, tokens, strict=True)):
        codes[i, :len(ts)] = crf.codes(text, ts)
        for kind, a, b in spans:
            inside = [j for j, (s, e) in enumerate(ts) if a <= s and e <= b]
            for j in inside:
                gold[i, j] = LABELS.index(("B-" if j == inside[0] else "I-") + kind)
    mask = np.arange(width)[None, :] < length[:, None]
    index = []
    for f, key in enumerate(crf.feature_keys(codes)):
        known, at = np.unique(key[mask], return_inverse=True)
        crf.keys[f], crf.weights[f] = known, np.zeros((len(known), K))
        full = np.zeros((n, width), np.int64)
        full[mask] = at.ravel()
        index.append(full)
    params = [*crf.weights, crf.trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    onehot = np.eye(K)[gold] * mask[..., None]
    pair_gold = np.zeros((K, K))
    for t in range(1, width):
        np.add.at(pair_gold, (gold[mask[:, t], t - 1], gold[mask[:, t], t]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

    for s in range(1, steps + 1):
        e = sum(w[at] for w, at in zip(params[:-1], index, strict=True))
        trans = np.where(FOLLOWS, params[-1], -1e9)
        alpha = np.zeros((n, width, K))
        beta = np.zeros((n, width, K))
        alpha[:, 0] = np.where(START_OK, e[:, 0], -1e9)
        for t in range(1, width):
            new = lse(alpha[:, t - 1, :, None] + trans[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        pair = np.zeros((K, K))
        for t in range(width - 2, -1, -1):
            ahead = trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], lse(ahead, 2), 0)
            both = np.exp(np.minimum(alpha[:, t, :, None] + ahead - z[:, None, None], 0))
            pair += (both * mask[:, t + 1, None, None]).sum(0)
        marginal = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
        wrong = (marginal - onehot)[mask]
        grads = []
        for w, at in zip(params[:-1], index, strict=True):
            g = np.zeros_like(w)
            np.add.at(g, at[mask], wrong)
            grads.append(g + l2 * w)
        grads.append((pair - pair_gold) * FOLLOWS + l2 * params[-1])
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9 ** s)) / (np.sqrt(v / (1 - 0.99 ** s)) + 1e-8)
    return crf


def _decoded(crf: Crf, runs: list[tuple]) -> Iterator[tuple[tuple, list[tuple[str, int, int]]]]:
    """Each of ``runs`` (anything, codes) and its spans in tokens, in order of length, in bounded blocks."""
    runs = sorted(runs, key=lambda x: len(x[1]))
    lo = 0
    while lo < len(runs):
        hi = lo + 1
        while hi < len(runs) and (hi - lo + 1) * len(runs[hi][1]) * K <= CELLS:
            hi += 1
        block = runs[lo:hi]
        length = np.array([len(c) for _, c in block])
        codes = np.zeros((len(block), length.max()), np.int64)
        for row, (_, c) in enumerate(block):
            codes[row, :len(c)] = c
        labels = crf.viterbi(codes, length)
        for row in np.nonzero((labels != O).any(1))[0]:
            spans, start, kind = [], None, None
            for j in range(length[row] + 1):
                name = LABELS[labels[row, j]] if j < length[row] else "O"
                if name[0] != "I" and start is not None:
                    spans.append((kind, start, j))
                    start = None
                if name[0] == "B":
                    start, kind = j, name[2:]
            yield block[row][0], spans
        lo = hi


def model_spans(crf: Crf, texts: list[str]) -> list[list[Span]]:
    """The CRF's spans of each text. Stretches with a span near an edge that is not the text's are decoded
    again with the stretch as long again on that side."""
    tokens, open_runs, spans_of = {}, [], {}
    for i, t in enumerate(texts):
        if TRIGGER.search(t):
            tokens[i] = Tokens(t)
            found = stretches(t, tokens[i])
            open_runs += [(i, lo, hi) for lo, hi in found.tolist()]
            spans_of[i] = {(lo, hi): [] for lo, hi in found.tolist()}
    while open_runs:
        wider: dict[int, list[tuple[int, int]]] = {}
        coded = [((i, lo, hi), crf.codes(texts[i], tokens[i].extents(lo, hi))) for i, lo, hi in open_runs]
        for (i, lo, hi), spans in _decoded(crf, coded):
            spans_of[i][lo, hi] = [(k, lo + a, lo + b) for k, a, b in spans]
            left = lo > 0 and spans[0][1] < EDGE
            right = hi < tokens[i].n and spans[-1][2] > hi - lo - EDGE
            if left or right:
                more = max(REACH, hi - lo)
                wider.setdefault(i, []).append((lo - more * left, hi + more * right))
        open_runs = []
        for i, grown in wider.items():
            every = np.array([*spans_of[i], *grown], np.int64)
            merged = [(lo, hi) for lo, hi in tokens[i].whole(every[:, 0], every[:, 1]).tolist()]
            open_runs += [(i, *r) for r in merged if r not in spans_of[i]]
            spans_of[i] = {r: spans_of[i].get(r, []) for r in merged}
    out: list[list[Span]] = [[] for _ in texts]
    for i, by_range in spans_of.items():
        t = tokens[i]
        out[i] = [(k, int(t.starts[a]), int(t.ends[b - 1])) for r in sorted(by_range) for k, a, b in by_range[r]]
    return out


def find_spans(crf: Crf, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by kind and start."""
    out = []
    clean = [t or "" for t in texts]
    for text, more in zip(clean, model_spans(crf, clean), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else starts

        def free(a: int, b: int) -> bool:  # no base span begins before b and ends behind a
            k = int(np.searchsorted(starts, b))
            return k == 0 or ends[k - 1] <= a

        every = base + [s for s in more if free(s[1], s[2])]
        out.append((base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``: texts, spans and new texts of a whole batch are never held at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    crf = crf or train()
    schema = T.StructType([docs.schema[id_col], *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = find_spans(crf, batch.column(text_col).to_pylist())
            counts = [pa.array([sum(k == s[0] for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([_joined(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *counts, digest, spans], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the earlier, then longer one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>``."""
    crf = crf or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            i = batch.schema.get_field_index(text_col)
            texts = batch.column(i).to_pylist()
            new = [None if t is None else masked(t, every) for t, (_, every) in zip(texts, find_spans(crf, texts), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
