"""Nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts (halved again and again along its
main direction, then refined by moving vertices to the part most of their neighbours are in, within a
capacity). A small two-layer classifier learns to predict the parts of a vector and its neighbours.
Every row is stored in its most probable part; a query looks into its most probable parts, as many as
held-out queries of the sample need for ``recall`` of their true neighbours; all rows of those parts
are scored exactly, in blocks of bounded size, and the best of each block compete.

Nearness is the inner product in double precision, ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite components, those not of the
commonest dimension, and rows with a null id take no part. Repeated rows are candidates of their own;
a query repeated with the same vector is one query. With no more rows than wanted, all are returned.
An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffline.llm.store import bounded_sample, staged
from staffline.llm.vectors import main_dimension, matrix, unit, usable


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows (by inner product) of every row, in blocks."""
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i:i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 8) -> np.ndarray:
    """Parts (a power of two) of near-equal size that keep neighbours together."""
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(11)
    for _ in range(int(math.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            rows = np.nonzero(part == p)[0]
            c = x[rows] - x[rows].mean(0)
            v = rng.standard_normal(x.shape[1])
            for _ in range(12):
                v = c.T @ (c @ v)
                v /= np.sqrt(v @ v) or 1.0
            order = rows[np.argsort(c @ v, kind="stable")]
            new[order[len(order) // 2:]] += 1
        part = new
    most = math.ceil(slack * len(x) / parts)
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts))
        for col in graph.T:
            np.add.at(votes, (np.arange(len(x)), part[col]), 1)
            np.add.at(votes, (col, part), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Two layers: x -> relu -> softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, hidden)) * math.sqrt(2 / d), np.zeros(hidden),
                  rng.standard_normal((hidden, p)) * math.sqrt(1 / hidden), np.zeros(p)]
        m, v, s = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                at = order[i:i + 256]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                e = (self._soft(h @ self.w[2] + self.w[3]) - target[at]) / len(at)
                back = (e @ self.w[2].T) * (h > 0)
                grads = [x[at].T @ back, back.sum(0), h.T @ e, e.sum(0)]
                s += 1
                for w, g, a, b in zip(self.w, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= 0.002 * (a / (1 - 0.9 ** s)) / (np.sqrt(b / (1 - 0.999 ** s)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


class LearnedPartitions:
    def __init__(self, sample: np.ndarray, parts: int, neighbours: int, wanted: int, recall: float):
        self.parts, self.probes, self.router = parts, parts, None
        if parts < 2:
            return
        x = unit(sample)
        graph = neighbour_graph(x, min(neighbours, len(x) - 1))
        part = balanced_parts(x, graph, parts)
        target = np.zeros((len(x), parts))
        target[np.arange(len(x)), part] = 0.5
        for col in graph.T:
            np.add.at(target, (np.arange(len(x)), part[col]), 0.5 / graph.shape[1])
        # every tenth row is held out of training, to learn how many parts a query needs
        held = np.arange(len(x)) % 10 == 0
        self.router = Router(x[~held], target[~held])
        home = self.router.order(x)[:, 0]
        true = np.zeros((held.sum(), min(wanted, len(x) - 1)), np.int64)
        rows = np.nonzero(held)[0]
        for i in range(0, len(rows), 512):
            s = sample[rows[i:i + 512]] @ sample.T
            s[np.arange(len(s)), rows[i:i + 512]] = -np.inf
            true[i:i + 512] = np.argpartition(-s, true.shape[1] - 1, axis=1)[:, :true.shape[1]]
        rank = np.argsort(self.router.order(x[rows]), axis=1)
        needed = rank[np.arange(len(rows))[:, None], home[true]]
        reached = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
        self.probes = int(np.searchsorted(reached, recall) + 1)

    def order(self, v: np.ndarray) -> np.ndarray:
        if self.router is None:
            return np.zeros((len(v), 1), np.int64)
        return self.router.order(unit(v))


def _best(group: pa.Table, dim: int, wanted: int) -> pa.Table:
    """The best members of one block for each of its queries."""
    role = group["role"].to_numpy()
    member, query = group.filter(pa.array(role == 0)), group.filter(pa.array(role == 1))
    empty = np.zeros(0, np.int64)
    if not len(member) or not len(query):
        return pa.table({"q": empty, "query_id": empty, "vec_id": empty, "score": np.zeros(0)})
    m, q = matrix(member["v"], dim), matrix(query["v"], dim)
    m_id, q_id, number = member["id"].to_numpy(), query["id"].to_numpy(), query["q"].to_numpy()
    out: tuple = ([], [], [], [])
    for i in range(0, len(q), 256):
        s = q[i:i + 256] @ m.T
        s[q_id[i:i + 256, None] == m_id[None, :]] = -np.inf
        k = min(wanted, len(m)) - 1
        least = np.partition(-s, k, axis=1)[:, k]
        room = 1e-9 * (1 + np.abs(s, where=np.isfinite(s), out=np.zeros_like(s)).max(1))
        qi, mi = np.nonzero((-s <= (least + room)[:, None]) & np.isfinite(s))
        # row by row, so that equal vectors get equal scores wherever they stand
        score = np.concatenate([np.einsum("ij,ij->i", q[i + qi[j:j + 65536]], m[mi[j:j + 65536]])
                                for j in range(0, len(qi), 65536)] or [np.zeros(0)])
        order = np.lexsort((m_id[mi], -score, qi))
        qi, mi, score = qi[order], mi[order], score[order]
        first = np.searchsorted(qi, qi)  # where the row's query begins
        top = np.arange(len(qi)) - first < wanted
        for o, x in zip(out, (number[i + qi[top]], q_id[i + qi[top]], m_id[mi[top]], score[top]), strict=True):
            o.append(x)
    return pa.table(dict(zip(("q", "query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))


def nearest(vectors: DataFrame, is_query: Column, wanted: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            recall: float = 0.97, max_parts: int = 64, per_part: int = 256, neighbours: int = 10,
            sample_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``wanted`` nearest rows found.
    ``is_query``: condition over the columns id and v."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(
        F.col("id").isNotNull() & usable(F.col("v")))
    dim = main_dimension(rows, "v")
    rows = staged(rows.filter(F.size("v") == dim), "vectors")
    count = rows.count()
    if not count:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    sample = bounded_sample(rows, sample_rows, "id").select("v").toArrow()  # sample_rows at most
    parts = 1 << max(0, int(math.log2(max(1, min(max_parts, count // per_part, len(sample) // 64)))))
    index = LearnedPartitions(matrix(sample["v"], dim), parts, neighbours, wanted, recall)
    kind = dict(rows.dtypes)["v"]

    def route(probes: int):
        def run(batches):
            for batch in batches:
                order = index.order(matrix(batch.column("v"), dim)) if len(batch) else np.zeros((0, 1), np.int64)
                to = pa.array(list(order[:, :probes].astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, to], names=[*batch.schema.names, "parts"])
        return run

    stored = staged(rows.mapInArrow(route(1), f"id long, v {kind}, parts array<int>")
                    .select("id", "v", F.col("parts")[0].alias("part")), "routed")
    asked = staged(rows.filter(is_query).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    looks = staged(asked.mapInArrow(route(index.probes), f"id long, v {kind}, q long, parts array<int>")
                   .select("id", "v", "q", F.explode("parts").alias("part")), "looks")
    sizes = lambda df: {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
    members, queries = sizes(stored), sizes(looks)  # max_parts numbers each
    blocks = lambda of: F.create_map(*[x for p in range(parts) for x in (
        F.lit(p), F.lit(max(1, math.ceil(of.get(p, 0) / block_rows))))])
    m_blocks, q_blocks = F.element_at(blocks(members), F.col("part")), F.element_at(blocks(queries), F.col("part"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    # equal ids may be many: deal rows by vector and id
    as_member = stored.select("part", F.lit(0).alias("role"), "id", "v", F.lit(0).cast("long").alias("q"),
                              F.pmod(F.xxhash64("id", "v"), m_blocks).cast("int").alias("mb"), F.explode(span(q_blocks)).alias("qb"))
    as_query = looks.select("part", F.lit(1).alias("role"), "id", "v", "q",
                            F.pmod(F.xxhash64("q"), q_blocks).cast("int").alias("qb"), F.explode(span(m_blocks)).alias("mb"))
    best = as_member.unionByName(as_query).groupBy("part", "mb", "qb").applyInArrow(
        lambda group: _best(group, dim, wanted), "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
