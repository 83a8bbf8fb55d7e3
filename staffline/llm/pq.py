"""Embedding near-duplicates by product quantisation.

Equal vectors are joined into classes. A coarse quantiser (k-means on a bounded sample) deals
the classes into inverted lists; each class's residual is coded by sub-space. A class looks into every
list whose border with its own is near enough. A link of length r across a border has one end within
r / 2 of it, and one look, from either end, finds the link; so borders within r / 2 are enough for all
links, in any dimension.

Lists that lie near each other share a shelf of bounded size, and the classes of a shelf are packed into
blocks: one row each, written once. Two blocks meet if a class of one looks into a list of the other; they
are read where they meet (a Cartesian product of the written rows), so that no copy of a class is sent or
written however many lists it looks into. There, queries meet members list by list. The inner
product with a member's quantised form (codes and centre) is taken first; as the angle between the member
and that form is known, every pair that could reach the threshold is kept (none is lost here), and its
cosine is taken in double precision from the original vectors. A task reports how many links each class has in
its blocks and a spanning forest of them, so its output is linear in its classes however dense the group.
Components join the forests.

Rows and classes are told by two 64-bit hashes of the vector. The vectors pass one exchange; the input is
read several times instead of being copied.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors not
of the commonest dimension, link with nothing; so do rows with a null id. Equal vectors under one id
are links of each other like any two rows. An empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.llm.components import connected_components
from staffline.llm.store import staged
from staffline.llm.vectors import forest, kmeans, matrix, unit, usable

#: Bytes of vectors in a block, of blocks that a task sends to Python at once, and of blocks it keeps there.
BLOCK_BYTES, SENT_BYTES, KEPT_BYTES = 1 << 20, 1 << 22, 3 << 24
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


class Quantiser:
    """Coarse centres (unit vectors) and one codebook for each sub-space of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int):
        x = unit(sample)
        k = max(1, min(lists, len(x) // 8))
        self.coarse = kmeans(x, k)
        size = np.sqrt((self.coarse ** 2).sum(1, keepdims=True))
        self.coarse = self.coarse / np.where(size > 0, size, 1)
        residual = x - self.coarse[self.home(x)]
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.books = [kmeans(residual[:, a:b], min(codes, len(x)), steps=6) for a, b in self.spans]

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i:i + 4096] @ self.coarse.T).argmax(1) for i in range(0, len(x), 4096)]
                              or [np.zeros(0, np.int64)])

    def encode(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Codes of the residuals."""
        residual = x - self.coarse[home]
        codes = np.zeros((len(x), len(self.spans)), np.uint8)
        for j, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            codes[:, j] = (residual[:, a:b] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
        return codes

    def looks(self, x: np.ndarray, home: np.ndarray, margin: float, lists: np.ndarray) -> np.ndarray:
        """Which of ``lists`` have a border with each row's home list within ``margin``, the home list included."""
        to, (own, at) = self.coarse[lists].astype(x.dtype), np.unique(home, return_inverse=True)
        gaps = np.sqrt(np.maximum(2 - 2 * self.coarse[own] @ self.coarse[lists].T, 0)).astype(x.dtype)
        mine = np.einsum("ij,ij->i", x, self.coarse[home].astype(x.dtype))
        return (mine[:, None] - x @ to.T <= margin * gaps[at] + 1e-5) | (home[:, None] == lists)

    def quantised(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The members as their codes give them."""
        out = self.coarse[home].astype(np.float32)
        for j, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            out[:, a:b] += book[codes[:, j]].astype(np.float32)
        return out

    def shelves(self, members: dict[int, int], most: int) -> np.ndarray:
        """Shelf of each list: lists that are near each other share one of at most ``most`` members (a
        larger list has its own); -1 for empty lists."""
        out, left = np.full(len(self.coarse), -1), np.ones(len(self.coarse), bool)
        at, shelf, held = 0, 0, 0
        for _ in range(len(self.coarse)):
            left[at] = False
            if n := members.get(at, 0):
                if held and held + n > most:
                    shelf, held = shelf + 1, 0
                out[at], held = shelf, held + n
            at = int(np.where(left, self.coarse @ self.coarse[at], -np.inf).argmax())
        return out


def _bytes(column: pa.ChunkedArray, kind: type, width: int = 1) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _places(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the set flags; quick where few are."""
    flat = flags.ravel()
    most = len(flat) // 64 * 64
    near = np.flatnonzero(flat[:most].view(np.uint64).reshape(-1, 8).any(1))
    at, j = np.nonzero(flat[:most].reshape(-1, 64)[near])
    return np.divmod(np.concatenate([near[at] * 64 + j, most + np.flatnonzero(flat[most:])]), flags.shape[1])


class _Block:
    """The classes of a written block, in order of their lists."""

    def __init__(self, quantiser: Quantiser, dim: int, kind: type, threshold: float, row: dict):
        self.home = np.frombuffer(row["home"].as_py(), np.int32)
        self.node = row["at"].as_py() + np.arange(len(self.home))
        self.n = row["n"].values.to_numpy()
        self.v = np.frombuffer(row["v"].as_py(), kind).reshape(-1, dim)
        self.near = quantiser.quantised(self.home, np.frombuffer(row["codes"].as_py(), np.uint8).reshape(-1, len(quantiser.spans)))
        x, near = unit(self.v.astype(np.float64)), self.near.astype(np.float64)
        self.single = x.astype(np.float32)
        # the least inner product with the quantised form that a vector within the threshold's angle of the original can have
        size = np.sqrt((near * near).sum(1))
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, near) / np.maximum(size, 1e-12), -1, 1))
        self.least = (size * np.cos(np.minimum(angle + math.acos(threshold), math.pi)) - 1e-4).astype(np.float32)
        self.lists, start = np.unique(self.home, return_index=True)
        self.cuts = np.append(start, len(self.home))

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return unit(self.v[rows].astype(np.float64))


def _meet(query: _Block, member: _Block, looks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row of query, row of member) to members in lists that a query looks into; looks: by query and list of member."""
    found = []
    for j, (lo, hi) in enumerate(zip(member.cuts[:-1], member.cuts[1:], strict=True)):
        asks = np.nonzero(looks[:, j])[0]
        may = query.single[asks] @ member.near[lo:hi].T >= member.least[lo:hi]
        some = np.count_nonzero(may)
        if some > 0.02 * may.size:
            qi, mi = np.nonzero(may & (query.exact(asks) @ member.exact(np.arange(lo, hi)).T >= threshold))
            qi, mi = asks[qi], lo + mi
        elif some:
            qi, mi = _places(may)
            qi, mi = asks[qi], lo + mi
            kept = np.zeros(len(qi), bool)
            for i in range(0, len(qi), 65536):
                k = i + np.nonzero(np.einsum("ij,ij->i", query.single[qi[i:i + 65536]], member.single[mi[i:i + 65536]]) >= threshold - 1e-4)[0]
                kept[k] = np.einsum("ij,ij->i", query.exact(qi[k]), member.exact(mi[k])) >= threshold
            qi, mi = qi[kept], mi[kept]
        else:
            continue
        other = query.node[qi] != member.node[mi]
        found.append((qi[other], mi[other]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none), *found, strict=True))


class _Tally:
    """Links counted by class, and a spanning forest of them: never much more than a row for each class seen."""

    def __init__(self):
        self.counts, self.edges, self.size, self.least = [], [], 0, 1 << 20

    def add(self, node: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.counts.append((node[links > 0], links[links > 0]))
        self.edges.append(self._forest(a, b))
        self.size += len(self.counts[-1][0]) + len(self.edges[-1][0])
        if self.size > self.least:
            (node, links), edges = self._summed(), self._forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True)))
            self.counts, self.edges, self.size = [(node, links)], [edges], len(node) + len(edges[0])
            self.least = max(self.least, 2 * self.size)

    @staticmethod
    def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(ids), at[:len(a)], at[len(a):])
        tree = np.nonzero(root != np.arange(len(ids)))[0]
        return ids[tree], ids[root[tree]]

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        node, links = (np.concatenate(x) for x in zip(*self.counts, strict=True))
        ids, at = np.unique(node, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, links)
        return ids, total

    def batches(self):
        if not self.counts:
            return
        node, links = self._summed()
        a, b = self._forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True)))
        out = pa.table({"node": np.concatenate([node, a]), "other": np.concatenate([node, b]),
                        "links": np.concatenate([links, np.zeros(len(a), np.int64)])})
        yield from out.to_batches(max_chunksize=65536)


def _links(quantiser: Quantiser, dim: int, kind: type, threshold: float, margin: float):
    """Pairs of blocks (columns a_ and b_) to rows (node, other, links) of all links between them."""
    def meetings(batches):
        kept, tally = {}, _Tally()

        def block(batch, i: int, side: str) -> _Block:
            at = batch.column(f"{side}_at")[i].as_py()
            if at not in kept:
                if sum(x.v.nbytes + 2 * x.single.nbytes for x in kept.values()) > KEPT_BYTES:
                    kept.clear()
                names = ("at", "home", "n", "v", "codes")
                kept[at] = _Block(quantiser, dim, kind, threshold, {c: batch.column(f"{side}_{c}")[i] for c in names})
            return kept[at]

        for batch in batches:
            for i in range(batch.num_rows):
                a, b = block(batch, i, "a"), block(batch, i, "b")
                ways = [(a, b), (b, a)] if a is not b else [(a, a)]
                looks = [quantiser.looks(q.single, q.home, margin, m.lists) for q, m in ways]
                for (q, m), mine, others in zip(ways, looks, reversed(looks), strict=True):
                    qi, mi = _meet(q, m, mine, threshold)
                    if not len(qi):
                        continue
                    # a member that looks into the query's list counts this link as a query
                    back = ~others[mi, np.searchsorted(q.lists, q.home[qi])]
                    tally.add(q.node, np.bincount(qi, m.n[mi], len(q.node)).astype(np.int64), q.node[qi], m.node[mi])
                    tally.add(m.node, np.bincount(mi[back], q.n[qi[back]], len(m.node)).astype(np.int64), *np.zeros((2, 0), np.int64))
        yield from tally.batches()

    return meetings


def blocks_of(fine: DataFrame, quantiser: Quantiser, dim: int, margin: float, block_rows: int) -> DataFrame:
    """fine: id, v, k1, k2. Classes of equal vectors, packed by shelf, a block a row: ``at`` is the node of its first class,
    the others follow; ``holds`` and ``looks`` are the lists that its classes lie in and look into."""
    types = dict(fine.dtypes)
    number = np.float32 if types["v"] == "array<float>" else np.float64
    rows_of = max(16, min(block_rows, BLOCK_BYTES // (dim * number().itemsize)))

    def homes(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(quantiser.home(unit(matrix(batch.column("v"), dim))).astype(np.int32)),
                                                  batch.column("k1")], names=["home", "k1"])

    # one number for each list: max_lists rows at most
    members = {r["home"]: r["k"] for r in fine.select("v", "k1").mapInArrow(homes, "home int, k1 long")
               .groupBy("home").agg(F.approx_count_distinct("k1").alias("k")).collect()}
    shelf_of = quantiser.shelves(members, rows_of)
    held = np.bincount(shelf_of[shelf_of >= 0], [members.get(c, 0) for c in np.nonzero(shelf_of >= 0)[0]])
    deal = np.maximum(1, np.ceil(held / rows_of)).astype(np.int64)
    first = np.cumsum(deal) - deal

    def dealt(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]).append_column("row", pa.array(np.arange(len(batch))))
            try:  # equal vectors that stand near each other are sent once
                one = rows.group_by(["k1", "k2"], use_threads=False).aggregate([("row", "min"), ("id", "min"), ("id", "count")])
                batch, n, least = batch.take(one["row_min"].combine_chunks()), one["id_count"], one["id_min"].cast(batch.schema.field("id").type)
            except pa.ArrowNotImplementedError:  # an id that Arrow can't compare
                n, least = pa.chunked_array([np.ones(len(batch), np.int64)]), rows["id"]
            x = matrix(batch.column("v"), dim) + 0.0  # -0.0 equals 0.0
            home, spread = quantiser.home(unit(x)), batch.column("k2").to_numpy()
            shelf = np.maximum(shelf_of[home], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first[shelf] + np.mod(spread, deal[shelf])).astype(np.int32)), pa.array(home.astype(np.int32)), batch.column("k1"),
                 batch.column("k2"), pa.array([r.tobytes() for r in x.astype(number)], pa.binary()), n.combine_chunks(), least.combine_chunks()],
                names=["block", "home", "k1", "k2", "v", "n", "least"])

    def packed(group: pa.Table) -> pa.Table:
        group, out, total = group.sort_by([("home", "ascending"), ("k1", "ascending")]), [], len(group)
        cuts = np.linspace(0, total, max(1, round(total / rows_of)) + 1).astype(int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = group.slice(lo, hi - lo)
            home, v = part["home"].to_numpy(), _bytes(part["v"], number, dim)
            x = unit(v.astype(np.float64))
            looks = np.zeros(len(quantiser.coarse), bool)
            for i in range(0, len(x), 4096):
                looks |= quantiser.looks(x[i:i + 4096], home[i:i + 4096], margin, np.arange(len(looks))).any(0)
            out.append({"at": (part["block"][0].as_py() << 32) + int(lo), "home": home.astype(np.int32).tobytes(), "codes": quantiser.encode(x, home).tobytes(),
                        "v": v.tobytes(), "holds": np.unique(home).tolist(), "looks": np.nonzero(looks)[0].tolist()}
                       | {c: part[c].to_pylist() for c in ("k1", "k2", "n", "least")})
        return pa.Table.from_pylist(out, pa.schema([
            ("at", pa.int64()), ("home", pa.binary()), ("codes", pa.binary()), ("v", pa.binary()),
            ("holds", pa.list_(pa.int32())), ("looks", pa.list_(pa.int32())),
            *((c, pa.list_(group.schema.field(c).type)) for c in ("k1", "k2", "n", "least"))]))

    classes = (fine.mapInArrow(dealt, f"block int, home int, k1 long, k2 long, v binary, n long, least {types['id']}")
               .repartition("block").groupBy("block", "home", "k1", "k2", "v").agg(F.sum("n").alias("n"), F.min("least").alias("least")))
    return staged(classes.groupBy("block").applyInArrow(
        packed, "at long, home binary, codes binary, v binary, holds array<int>, looks array<int>, "
        f"k1 array<long>, k2 array<long>, n array<long>, least array<{types['id']}>"), "blocks"), number


def block_links(blocks: DataFrame, quantiser: Quantiser, dim: int, kind: type, threshold: float, margin: float) -> DataFrame:
    """Rows (node, other, links): links of a class to other classes' rows, to be summed (other = node), and forest edges (links = 0)."""
    spark, columns = blocks.sparkSession, ("at", "home", "codes", "v", "n", "holds", "looks")
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "ab")
    near = F.arrays_overlap("a_looks", "b_holds") | F.arrays_overlap("b_looks", "a_holds")
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_at") <= F.col("b_at")) & near).drop("a_holds", "a_looks", "b_holds", "b_looks")
    old = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(SENT_BYTES))  # a row holds two blocks
    try:
        return staged(pairs.mapInArrow(_links(quantiser, dim, kind, threshold, margin), "node long, other long, links long"), "links")
    finally:
        spark.conf.set(BATCH_KEY, old)


def _sample(fine: DataFrame, count: int, most: int) -> pa.Table:
    """``most`` distinct vectors at most: those that come first by their hash."""
    if count > most:
        fine = fine.filter(F.col("k1") <= F.lit(min((1 << 63) - 1, int((min(1.0, (1.2 * most + 1000) / count) - 0.5) * (1 << 64)))))
    return fine.select("k1", "k2", "v").dropDuplicates(["k1", "k2"]).orderBy("k1", "k2").limit(most).select("v").toArrow()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    max_lists: int = 1024, per_list: int = 200, parts: int = 8, codes: int = 256,
                    sample_rows: int = 32768, block_rows: int = 2048) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    good = F.col("id").isNotNull() & usable(F.col("v"))
    keys = {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.col("v"))}
    # the commonest dimension (the larger of equally common ones), and about how many vectors it has
    common = (rows.filter(good).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct(keys["k1"]).alias("k"))
              .orderBy(F.desc("n"), F.desc("d")).first())
    if common is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           (F.col("id") == F.col("id")).alias("kept"))
    dim, count = common["d"], common["k"]
    good &= F.size("v") == dim
    fine = rows.filter(good).withColumns(keys)
    sample = matrix(_sample(fine, count, sample_rows)["v"], dim)  # sample_rows at most
    quantiser = Quantiser(sample, max(1, min(max_lists, round(count / per_list))), parts, codes)
    margin = math.sqrt(2 - 2 * threshold) / 2
    blocks, kind = blocks_of(fine, quantiser, dim, margin, block_rows)
    out = block_links(blocks, quantiser, dim, kind, threshold, margin)
    links = out.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(out.filter("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = (blocks.select("at", F.posexplode(F.arrays_zip("k1", "k2", "n", "least")).alias("i", "c"))
               .select((F.col("at") + F.col("i")).alias("node"), "c.*"))
    rooted = classes.select("node", "least").join(roots, "node")
    named = rooted.join(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    linked = (classes.join(links, "node", "left").filter("n > 1 or links > 0").join(named, "node", "left")
              .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    # a vector just between two lists may be a class in both: then each links to the other
    linked = staged(linked.groupBy("k1", "k2").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    # most classes are one row without links; they need no look-up
    got = rows.withColumns({k: F.when(good, x) for k, x in keys.items()}).drop("v").join(linked, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return got.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
