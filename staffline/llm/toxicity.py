"""Toxicity by weak supervision.

1. Lexicons are induced from a bounded sample of labelled training rows: words and word beginnings
   that stand in toxic texts far more often than in others. Entries that begin alike form one voter;
   a few text patterns (shouting, exclamation runs, address, repetition, links, length) vote too.
2. Every document's votes are taken in one pass over all texts. A generative label model, fitted by
   EM to the vote patterns of all training documents, estimates how often each voter fires on toxic
   and on clean texts; labelled training rows are held at their label. Voters that go together more
   than their class explains are discounted by their conditional correlations.
3. A linear classifier over entries and patterns is trained on the model's posterior labels of a
   bounded sample of training documents, and scores every document. Its logit is then calibrated (two
   numbers) on the labelled training rows.

Training rows are those whose crc32 of the id as text is not divisible by 5; nothing is learned from
the others. Bounds (parameters): ``max_labelled`` labelled rows for the lexicons, ``max_train``
documents for the classifier and its calibration, ``max_entries`` entries; counts of votes cover all training documents.

Defined results: a null text counts as empty; an empty one is scored by its patterns alone; a null id
is held out; repeated rows are scored alike; documents without labels are fine, and without any
usable label the score is the smoothed share of toxic labels; an empty table gives an empty one;
further columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.store import bounded_sample, staged

FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
MIN_SUPPORT = 3
VOTER_ODDS = 2.5      # log-odds from which an entry may vote
MAX_LEXICONS = 24
EM_STEPS = 25
CACHE = 100_000       # words whose entries a task keeps
ADDRESS = re.compile(r"\b(?:you|your|tu|vous|du|ihr|ustedes|vosotros)\b")
BANGS = re.compile(r"!!+|\?!+")
UPPER = np.array([chr(i).isupper() for i in range(0x110000)])
PATTERNS = ("shouting", "bangs", "address", "repetition", "links", "short")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def entries_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def text_patterns(text: str | None, words: list[str], distinct: int) -> list[float]:
    """Values from 0 to 1, one for each of PATTERNS."""
    t = text or ""
    letters = sum(map(len, words)) or 1
    upper = int(UPPER[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
    return [min(1.0, upper / letters), min(1.0, len(BANGS.findall(t)) / (len(words) + 1)),
            min(1.0, 10 * len(ADDRESS.findall(t.lower())) / (len(words) + 1)),
            1 - distinct / (len(words) or 1), min(1.0, t.count("://") / 5), 1 / (1 + len(words) / 20)]


def _counted(n: Counter) -> pd.DataFrame:
    return pd.DataFrame({"entry": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})


def _entry_counts(texts: DataFrame, min_support: int, limit: int) -> dict[str, int]:
    """Entries of at least ``min_support`` texts and in how many they stand; the most frequent."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 32):
                n = Counter(e for t in batch["text"][i:i + 32] for e in {e for w in set(_words(t)) for e in entries_of(w)})
                yield _counted(n)

    rows = (texts.select("text").mapInPandas(emit, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_support).orderBy(F.desc("n"), "entry").limit(limit).collect())
    return {r["entry"]: r["n"] for r in rows}


def _known_counts(texts: DataFrame, known: set[str]) -> dict[str, int]:
    """In how many texts each known entry stands."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                n.update({e for w in set(_words(t)) for e in entries_of(w) if e in known})
        yield _counted(n)

    rows = texts.select("text").mapInPandas(emit, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r["entry"]: r["n"] for r in rows.collect()}


class Lexicon:
    """Entries (features of the classifier) and the voters made of some of them."""

    def __init__(self, entries: list[str], voters: list[list[int]]):
        self.ids = {e: i for i, e in enumerate(entries)}
        self.voter_of: dict[int, int] = {e: v for v, es in enumerate(voters) for e in es}
        self.n_voters = len(voters) + len(PATTERNS)
        self.lexicons = len(voters)

    @classmethod
    def induce(cls, toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, max_entries: int) -> Lexicon:
        scored = []
        for e, a in toxic.items():
            b = clean.get(e, 0)
            odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
            if odds > 1:
                scored.append((odds * math.sqrt(a), odds, a, e))
        scored.sort(key=lambda x: (-x[0], x[3]))
        chosen = scored[:max_entries]
        alike = defaultdict(list)
        for i, (_, odds, a, e) in enumerate(chosen):
            if odds >= VOTER_ODDS and a >= max(MIN_SUPPORT, 0.005 * n_toxic):
                alike[e.strip("=*")[:4]].append((a, i))
        order = sorted(alike.values(), key=lambda v: (-max(v)[0], v[0][1]))[:MAX_LEXICONS]
        return cls([e for *_, e in chosen], [[i for _, i in v] for v in order])

    def read(self, text: str | None, cache: dict) -> tuple[list[int], list[float], int]:
        """Entry ids, pattern values, and the votes as bits."""
        words = _words(text)
        seen = set(words)
        found: set[int] = set()
        for w in seen:
            ids = cache.get(w)
            if ids is None:
                ids = tuple(self.ids[e] for e in entries_of(w) if e in self.ids)
                if len(cache) < CACHE:
                    cache[w] = ids
            found.update(ids)
        values = text_patterns(text, words, len(seen))
        votes = 0
        for i in found:
            if i in self.voter_of:
                votes |= 1 << self.voter_of[i]
        for j, v in enumerate(values):
            votes |= (v > 0.3) << (self.lexicons + j)
        return sorted(found), values, votes


def _vote_sums(patterns: DataFrame, voters: int, bias: float, w: np.ndarray, labelled_only: bool = False) -> tuple:
    """Over all patterns (votes, label, n), with p the label or else the model's posterior: the sums of
    n, of n * p, and voters x voters matrices of the same over pairs that fire together. Each
    partition gives one row of sums."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + 2 * voters * voters)
        for b in batches:
            bits = (b["votes"].to_numpy(np.int64)[:, None] >> np.arange(voters) & 1).astype(float)
            n, label = b["n"].to_numpy(float), b["label"].to_numpy(float)
            p = np.where(np.isnan(label), 1 / (1 + np.exp(-np.clip(bias + bits @ w, -40, 40))), label)
            both, both_t = (bits * n[:, None]).T @ bits, (bits * (n * p)[:, None]).T @ bits
            total += np.concatenate([[n.sum(), (n * p).sum()], both.ravel(), both_t.ravel()])
        yield pd.DataFrame({"s": [total]})

    rows = patterns.filter("label is not null") if labelled_only else patterns
    s = np.sum([r["s"] for r in rows.mapInPandas(part, "s array<double>").collect()], axis=0)
    if not np.ndim(s):
        s = np.zeros(2 + 2 * voters * voters)
    square = s[2:].reshape(2, voters, voters)
    return s[0], s[1], square[0], square[1]


def label_model(patterns: DataFrame, voters: int, prior: float) -> tuple[float, np.ndarray]:
    """patterns: (votes, label or null, n). Bias and weight of each voter's firing against not firing,
    so that the posterior is the sigmoid of bias + sum of weights of the voters that fire."""

    def weights(t: np.ndarray, c: np.ndarray, share: float, d: np.ndarray) -> tuple[float, np.ndarray]:
        t, c, share = np.clip(t, 1e-5, 1 - 1e-5), np.clip(c, 1e-5, 1 - 1e-5), min(max(share, 1e-4), 1 - 1e-4)
        off = np.log((1 - t) / (1 - c))
        return math.log(share / (1 - share)) + float((d * off).sum()), d * (np.log(t / c) - off)

    def discount(n: float, yes: float, both: np.ndarray, both_t: np.ndarray, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What two voters share beyond their class counts once: 1 / (1 + correlations inside a class),
        of those that chance alone would not give in a class of that size."""
        corr = np.zeros((voters, voters))
        for size, pairs, r in ((yes, both_t, t), (n - yes, both - both_t, c)):
            sd = np.sqrt(np.maximum(r * (1 - r), 1e-6))
            one = (pairs / max(size, 1.0) - np.outer(r, r)) / np.outer(sd, sd)
            corr = np.maximum(corr, np.where(one < max(0.1, 3 / math.sqrt(max(size, 1.0))), 0, np.minimum(one, 1)))
        np.fill_diagonal(corr, 0)
        return 1 / (1 + corr.sum(1))

    bias, w = 0.0, np.zeros(voters)
    for step in range(EM_STEPS + 1):  # the first from the labelled rows alone
        n, yes, both, both_t = _vote_sums(patterns, voters, bias, w, labelled_only=step == 0)
        few = 0.1 if step else 0.5
        t, c = (both_t.diagonal() + few) / (yes + 1), ((both - both_t).diagonal() + few) / (n - yes + 1)
        if not step:  # correlations as the labels show them: the model's own classes would hide them
            apart = discount(n, yes, both, both_t, t, c)
        now = weights(t, c, yes / max(n, 1.0) if step else prior, apart)
        moved = max(abs(now[0] - bias), float(np.abs(now[1] - w).max(initial=0)))
        bias, w = now
        if step and moved < 0.01:
            break
    return bias, w


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, target: np.ndarray, n_entries: int,
               l2: float = 0.3, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets by Adam: weights of entries, of patterns, and the bias."""
    if not len(target):
        return np.zeros(n_entries), np.zeros(len(PATTERNS)), 0.0
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ent = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    k = dense.shape[1]
    w = np.zeros(n_entries + k + 1)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w[-1] = math.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for s in range(1, steps + 1):
        z = np.bincount(doc, w[ent], len(rows)) + dense @ w[n_entries:-1] + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.concatenate([np.bincount(ent, e[doc], n_entries), dense.T @ e, [e.sum()]])
        g[:-1] += l2 * w[:-1]
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** s)) / (np.sqrt(v / (1 - 0.999 ** s)) + 1e-9)
    return w[:n_entries], w[n_entries:-1], float(w[-1])


def calibrate(z: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logit (Platt scaling, by Newton steps) that fit the known labels."""
    if not (0 < label.sum() < len(label)):
        return 1.0, 0.0
    x, ab = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    # targets kept off 0 and 1 by the number of labels seen
    y = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y))
        ab -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_labelled: int = 10_000, max_train: int = 20_000,
                   max_entries: int = 2048, gold: float = 0.0, whole_rows: bool = False) -> DataFrame:
    """id, held_out, score and predicted (1 from a score of 0.5) of every document; with ``whole_rows``
    the documents themselves with their ``__score``. ``gold``: the share of its label in a labelled
    training row's target, the rest being its posterior (0: posteriors alone)."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter((F.col("id").isNotNull()) & F.col("label").isin(0, 1))
             .groupBy("id").agg(F.max("label").alias("label")).filter(~held_out("id")))
    known = staged(known, "toxic-labels")
    sample = bounded_sample(known, max_labelled, "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = staged(texts.join(F.broadcast(sample), "id"), "toxic-sample")  # max_labelled ids at most
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic = _entry_counts(labelled.filter("label = 1"), MIN_SUPPORT, 20 * max_entries)
    clean = _known_counts(labelled.filter("label = 0"), set(toxic))
    lex = Lexicon.induce(toxic, clean, sizes.get(1, 0), sizes.get(0, 0), max_entries)
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            rows = [lex.read(t, cache) for t in batch]
            yield pd.DataFrame({"entries": [r[0] for r in rows], "patterns": [r[1] for r in rows], "votes": [r[2] for r in rows]})

    features = F.pandas_udf(read, "entries array<int>, patterns array<double>, votes long")
    seen = staged(docs.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("f"))
                  .select("id", "f.*", held_out("id").alias("held_out")), "toxic-features")
    train = seen.filter(~F.col("held_out")).select("id", "votes", "entries", "patterns").join(known, "id", "left")
    patterns = staged(train.groupBy("votes", "label").agg(F.count("*").alias("n")), "toxic-votes")
    bias, w = label_model(patterns, lex.n_voters, prior)

    rows = bounded_sample(train, max_train, "id", "votes", "entries").collect()  # max_train rows at most
    target = np.empty(len(rows))
    for i, r in enumerate(rows):
        z = bias + sum(w[j] for j in range(lex.n_voters) if r["votes"] >> j & 1)
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        target[i] = p if r["label"] is None else gold * r["label"] + (1 - gold) * p
    dense = np.array([r["patterns"] for r in rows], float).reshape(len(rows), len(PATTERNS))
    by_entry, by_pattern, base = fit_linear([np.array(r["entries"], np.int64) for r in rows], dense, target, len(lex.ids))
    if not rows:
        base = math.log(prior / (1 - prior))
    gold_rows = [i for i, r in enumerate(rows) if r["label"] is not None]
    z = np.array([base + by_entry[np.asarray(rows[i]["entries"], np.int64)].sum() + dense[i] @ by_pattern for i in gold_rows])
    slope, shift = calibrate(z, np.array([rows[i]["label"] for i in gold_rows], float))
    by_entry, by_pattern, base = slope * by_entry, slope * by_pattern, slope * base + shift

    def logits(entries, values) -> float:
        return base + by_entry[np.asarray(entries, np.int64)].sum() + float(np.dot(values, by_pattern))

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for entries, values in batches:
            z = [logits(e, v) for e, v in zip(entries, values, strict=True)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))), dtype="float64")

    def reread(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for batch in batches:
            z = [logits(*lex.read(t, cache)[:2]) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))), dtype="float64")

    if whole_rows:  # a second reading of the texts costs less than writing them beside their features
        return docs.withColumn("__score", F.pandas_udf(reread, "double")(F.col(text_col)))
    score = F.pandas_udf(scored, "double")
    return (seen.withColumn("score", score("entries", "patterns"))
            .select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    scored = score_toxicity(docs, labels, id_col, text_col, whole_rows=True)
    return scored.filter("__score < 0.5").select(*docs.columns)
