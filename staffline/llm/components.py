"""Connected components of a link table by alternating star contractions.

Each round rewrites every edge towards the smallest neighbour (large star, then small star), so
the number of rounds grows with the logarithm of a component's size, and no round keeps more
edges than the one before. All rounds are joins and map-side combined minima; a node with very
many links is one row on the minima's side, and AQE splits its rows on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.llm.store import staged

MAX_ROUNDS = 60


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): replaces u's links by links to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("lv")).select("u", F.least("u", "lv").alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _distinct(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, each once."""
    return (edges.filter("a != b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids, in any direction and with repeats; (node, component) for
    every node that has an edge to another, component the smallest id reachable.

    Rows with a null end or equal ends are no edges. An empty table gives an empty table."""
    current = staged(_distinct(edges.select("a", "b").dropna()), "edges")
    seen = _digest(current)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _distinct(_star(both, larger_only=True))
        current = staged(_distinct(_star(large, larger_only=False)), "edges")
        last, seen = seen, _digest(current)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
