"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints link when at most ``max_bits`` bits differ.

The 64 bits are cut into a ring of ``segments`` segments. By the pigeonring principle, if at most
t bits differ over m segments then some segment starts a chain whose first l segments together
differ in at most floor(l*t/m) bits, for every l from 1 to m. The longest l with a budget of 0
gives an exact join key (with t = 2 and m = 5: two neighbouring segments, about 26 bits); the
longer chains prune the joined candidates before the full Hamming check.

Buckets of one key may be of any size. Up to ``bucket_cap`` distinct fingerprints are compared
pair by pair. In larger ones every fingerprint is sent to all points within max_bits/2 flips
outside the key, and those that meet in a point are linked with the smallest there: two
fingerprints within max_bits always meet half-way, and two that meet are within max_bits. Both
ways are exact, and the second one's work is linear in the bucket's size.

Defined results: a null text counts as empty; an empty one has fingerprint 0 and links like any
other; repeated rows are kept and get equal results; rows with a null id get the component of
their fingerprint (null when no row of the component has an id); an empty table gives an empty
one; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.llm.components import connected_components
from staffline.llm.store import sent_if_small, staged

SEED = 42
CHUNK = 65536
U64 = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text, shingles counted as often as they occur."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts, total = np.zeros(64, np.int64), 0
    for chunk in itertools.batched(shingles, CHUNK):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in chunk), np.uint64, len(chunk))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long in column ``out``."""

    @F.pandas_udf("long")
    def fps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fps(F.col(text_col)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(segments: int) -> list[int]:
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]


def _flips(bits: int, radius: int) -> list[int]:
    """All XOR patterns of up to ``radius`` set bits within ``bits``."""
    ones = [1 << i for i in range(64) if bits >> i & 1]
    return [_signed(sum(c)) for r in range(radius + 1) for c in itertools.combinations(ones, r)]


def pigeonring_links(fps: DataFrame, max_bits: int = 2, segments: int = 5, bucket_cap: int = 64) -> DataFrame:
    """fps: distinct fingerprints in column ``fp`` (signed long). Links (a, b) whose connected
    components are those of "at most max_bits bits differ"; every link has that distance or less."""
    if max_bits % 2 or segments <= max_bits:
        raise ValueError("max_bits must be even, and segments more than max_bits")
    masks = _masks(segments)
    budget = [length * max_bits // segments for length in range(segments + 1)]
    exact = max(length for length in range(1, segments + 1) if budget[length] == 0)
    chain = [[masks[(i + j) % segments] for j in range(segments)] for i in range(segments)]
    key_mask = [sum(c[:exact]) for c in chain]

    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(key_mask)])).alias("k")).select("fp", "k.i", "k.key")
    sizes = staged(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    few = keyed.join(sizes.filter(F.col("n") <= bucket_cap).select("i", "key"), ["i", "key"], "left_semi")
    pairs = (few.select("i", "key", F.col("fp").alias("a"))
             .join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"]).filter("a < b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    passes = F.bit_count(diff) <= max_bits
    for length in range(segments - 1, exact, -1):
        within = F.lit(False)
        for i in range(segments):
            ring = _signed(sum(chain[i][:length]))
            within = within | ((F.col("i") == i) & (F.bit_count(diff.bitwiseAND(F.lit(ring))) <= budget[length]))
        passes = within & passes
    close = pairs.filter(passes).select("a", "b")

    many = keyed.join(sizes.filter(F.col("n") > bucket_cap).select("i", "key"), ["i", "key"], "left_semi")
    flips = [_flips(U64 ^ m, max_bits // 2) for m in key_mask]
    points = F.lit(None).cast("array<bigint>")
    for i, xs in enumerate(flips):
        points = F.when(F.col("i") == i, F.array(*[F.lit(x) for x in xs])).otherwise(points)
    meet = many.select("fp", "i", "key", F.explode(points).alias("flip")).select(
        "fp", "i", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = meet.groupBy("i", "key", "point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    near = (meet.join(hubs, ["i", "key", "point"]).filter("fp != hub")
            .select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    return close.unionByName(near)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2, segments: int = 5, bucket_cap: int = 64, extra: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``component_id`` (the smallest id of the rows whose
    fingerprints are reachable through links) and ``root`` (the component's key, never null).
    ``extra``: further columns to carry along."""
    narrow = staged(with_fingerprint(docs, text_col, shingle)
                    .select(F.col(id_col).alias("id"), "fp", *(extra or [])), "fingerprints")
    distinct = staged(narrow.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(pigeonring_links(distinct.select("fp"), max_bits, segments, bucket_cap))
    rooted = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                    .select("fp", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    return narrow.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root", *(extra or []))


def hex_fingerprint(c: str = "fp"):
    """The 16 lowercase hex digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (nulls
    last), then the smallest row hash; of wholly equal rows one stays."""
    cols = docs.columns
    row_hash = F.xxhash64(*[F.col(c) for c in cols])
    groups = staged(simhash_groups(docs.withColumn("__row", row_hash), id_col, text_col, shingle, max_bits,
                                   extra=["__row"]), "groups")
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    rows = groups.groupBy("root", order.alias("o")).agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min("o").alias("b"), F.count("*").alias("rows"))
    named = lambda df: df.select(F.col("o.id").alias("__id"), F.col("o.row").alias("__hash"))
    # the few rows that go (or stand more than once) meet the texts, not the many that stay
    lost = staged(named(rows.join(best.filter("rows > 1"), "root").filter(~F.col("o").eqNullSafe(F.col("b")))), "lost")
    twins = staged(named(rows.filter("n > 1")), "twins")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    kept = docs.withColumn("__row", row_hash).join(sent_if_small(lost), same, "left_anti")
    if twins.isEmpty():  # no wholly equal rows: one pass over the texts
        return kept.select(*cols)
    twins = sent_if_small(twins)
    once = kept.join(twins, same, "left_anti").select(*cols)
    return once.unionByName(kept.join(twins, same, "left_semi").select(*cols).distinct())
