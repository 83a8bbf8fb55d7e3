import contextlib
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffline import session
from staffline.llm import pq, routed
from staffline.llm.vectors import forest
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, n long, h string"


def table(spark, rows):
    floats = lambda v: None if v is None else [None if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, floats(v), 0, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200 + i, (3 * x[i] + 0.05 * rng.standard_normal(6)).tolist()) for i in range(30)]
    rows += [(300 + i, x[5].tolist()) for i in range(20)]      # copies
    rows += [(300, x[5].tolist()), (301, x[7].tolist())]       # a repeated row, a repeated id
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0, 0, 0, 0]), (403, [float("nan")] * 6),
             (404, [float("inf"), 0, 0, 0, 0, 0]), (405, []), (406, [1.0, 2.0]), (None, x[5].tolist()), (407, (1e200 * x[5]).tolist())]
    return rows


def good(rows):
    return [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v
            and np.isfinite(v).all() and np.any(v)]


def cosines(vs):
    u = np.array([v / np.abs(v).max() for v in vs])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def links_by_brute_force(rows):
    fine = good(rows)
    ids = np.array([i for i, _ in fine])
    near = cosines([v for _, v in fine]) >= 0.9
    # equal vectors link though their cosine may round below 1
    np.fill_diagonal(near, False)
    label = forest(len(ids), *np.nonzero(near))
    least = np.full(len(ids), 1 << 60)
    np.minimum.at(least, label, ids)
    want = [(int(i), int(n), int(c)) for i, n, c in zip(ids, near.sum(1), least[label], strict=True)]
    used = len(want)
    bad = [i for i, _ in rows]
    for i in want:
        bad.remove(i[0])
    return sorted(want, key=str), [(i, 0, i) for i in bad], used


def check_links(spark, rows, **options):
    got = [tuple(r) for r in pq.near_duplicates(table(spark, rows), **options).collect()]
    want, rest, _ = links_by_brute_force(rows)
    key = lambda t: str(t)
    assert sorted((t[:3] for t in got), key=key) == sorted(want + rest, key=key)
    assert all(t[3] == (t[0] == t[2]) if t[0] is not None else t[3] is None for t in got)


def test_links_with_odd_rows(spark):
    check_links(spark, odd_rows())


def test_links_in_small_blocks_and_many_lists(spark):
    check_links(spark, odd_rows(), per_list=10, block_rows=8, codes=16)


def test_no_vectors(spark):
    assert pq.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in pq.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    assert routed.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0


def test_dense_group_and_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 48))
    near = base[:200] + 0.3 * rng.standard_normal((200, 48)) * 0.9
    crowd = base[399] + 0.15 * rng.standard_normal((150, 48))
    x = np.concatenate([base, near, crowd])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    c = cosines(list(x)) >= 0.9
    np.fill_diagonal(c, False)
    got = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(table(spark, rows), per_list=20, block_rows=64).collect()}
    counts = np.array([got[i] for i in range(len(x))])
    assert (counts <= c.sum(1)).all() and counts.sum() >= 0.97 * c.sum()


def test_links_along_the_line_between_centres(spark):
    """A dense arc in 64 dimensions: lists cut it across, and links run straight over the borders."""
    t = np.linspace(0, np.pi, 400)
    x = np.zeros((400, 64))
    x[:, 0], x[:, 1] = np.cos(t), np.sin(t)
    x += 0.002 * np.random.default_rng(6).standard_normal(x.shape)
    check_many(spark, x, per_list=20)


def check_many(spark, x, **options):
    c = cosines(list(x)) >= 0.9
    np.fill_diagonal(c, False)
    got = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(table(spark, list(enumerate(x.tolist()))), **options).collect()}
    assert [got[i] for i in range(len(x))] == c.sum(1).tolist()


def test_all_links_of_a_crowd_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 48))
    check_many(spark, np.concatenate([base, base[:100] + 0.3 * rng.standard_normal((100, 48)),
                                      base[299] + 0.28 * rng.standard_normal((250, 48))]), per_list=20, block_rows=64)


def brute_nearest(rows, wanted):
    fine = good(rows)
    out = {}
    for q, v in {(i, tuple(x)) for i, x in fine if i % 20 == 0}:
        scored = sorted(((-(np.array(v) @ x), i) for i, x in fine if i != q))[:wanted]
        out.setdefault(q, []).append([(i, -s) for s, i in scored])
    return out


def test_nearest_with_odd_rows_is_exact_with_one_part(spark):
    rows = [(i, v) for i, v in odd_rows() if i != 407]
    got = {}
    for r in routed.nearest(table(spark, rows), F.col("id") % 20 == 0, wanted=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 7)
    assert got.keys() == want.keys()
    for q, (found,) in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 8))
        assert [i for _, i, _ in mine] == [i for i, _ in found]
        assert np.allclose([s for *_, s in mine], [s for _, s in found], rtol=1e-12)


def test_fewer_rows_than_wanted(spark):
    rows = [(0, [1.0, 0]), (1, [0.5, 1]), (2, [0.5, 2]), (20, [1.0, 0])]
    got = sorted(tuple(r) for r in routed.nearest(table(spark, rows), F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.7 * rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = routed.nearest(table(spark, rows), F.col("id") % 20 == 0, wanted=10, per_part=100, block_rows=128).collect()
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit / 1500 >= 0.93 and len(found) == 1500


def test_balanced_parts_keep_neighbours_together():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.2 * rng.standard_normal((64, 8)) for c in 3 * rng.standard_normal((8, 8))])
    graph = routed.neighbour_graph(x, 6)
    part = routed.balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.1 * 64 + 1
    assert (part[graph] == part[:, None]).mean() > 0.7


@pytest.mark.parametrize("name", ["op3", "op7"])
def test_whole_table(spark, name):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in v.collect()]
    x = np.array([r for _, r in rows])
    ids = np.array([i for i, _ in rows])
    if name == "op3":
        c = cosines(list(x)) >= 0.9
        np.fill_diagonal(c, False)
        got = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(v).collect()}
        assert [got[i] for i in ids] == c.sum(1).tolist()
    else:
        found = routed.nearest(v, F.col("id") % 20 == 0).collect()
        hit = total = 0
        for q in ids[ids % 20 == 0]:
            s = x @ x[ids == q][0]
            s[ids == q] = -np.inf
            hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & {r["vec_id"] for r in found if r["query_id"] == q})
            total += 20
        assert hit / total >= 0.9


class Disk(threading.Thread):
    """Bytes of the shuffle files of a session, and of files in a folder, that are seen while it runs."""

    def __init__(self, spark, folder):
        super().__init__(daemon=True)
        tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        self.globs = [(Path(top), "*/shuffle_*.data") for top in tops] + [(Path(folder), "**/part-*.parquet")]
        self.seen, self.ended = {}, threading.Event()
        self.old = set(self.files())

    def files(self):
        return {f for top, glob in self.globs for f in top.glob(glob)}

    def run(self):
        while not self.ended.wait(0.02):
            for f in self.files() - self.old:
                with contextlib.suppress(OSError):  # gone meanwhile
                    self.seen[f] = f.stat().st_size

    def total(self):
        self.ended.set()
        self.join()
        return sum(self.seen.values())


def test_vectors_are_sent_once_however_many_lists_they_look_into(spark, tmp_path):
    """Vectors without structure look into many lists; all that is shuffled and written stays a few times their size."""
    x = np.random.default_rng(8).standard_normal((2000, 32))
    table(spark, list(enumerate(x.tolist()))).write.parquet(f"{tmp_path}/v")
    disk = Disk(spark, session.shared_dir(spark))
    disk.start()
    got = {r["vec_id"]: r["n_links"] for r in pq.near_duplicates(spark.read.parquet(f"{tmp_path}/v"), per_list=20, block_rows=64).collect()}
    assert disk.total() < 8 * x.nbytes
    c = cosines(list(x)) >= 0.9
    np.fill_diagonal(c, False)
    assert [got[i] for i in range(len(x))] == c.sum(1).tolist()


def test_copies_far_apart_are_one_class(spark):
    """Copies in all partitions, with 0.0 and -0.0, and ids that are text."""
    x = np.random.default_rng(9).standard_normal((60, 8))
    x[:, 0] = 0.0
    rows = [(f"{k:02d}-{i:02d}", (v * (-1 if k % 2 and j == 0 else 1) for j, v in enumerate(x[i]))) for k in range(30) for i in range(60)]
    df = spark.createDataFrame([(i, [float(v) for v in vs]) for i, vs in rows], "vec_id string, embedding array<double>").repartition(6)
    near = cosines(list(x)) >= 0.9
    np.fill_diagonal(near, True)
    least = forest(60, *np.nonzero(near))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df, per_list=10, block_rows=16).collect()}
    assert len(got) == 1800
    for i, _ in rows:
        k = int(i[3:])
        assert got[i] == (30 * near[k].sum() - 1, f"00-{least[k]:02d}", i == f"00-{least[k]:02d}")
