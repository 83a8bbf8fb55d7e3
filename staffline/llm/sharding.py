"""Sharding by histogram sort: shards of near-equal bytes, equal texts side by side.

Rows are ordered by a 63-bit key: the CRC-32 of the text above 20 bits of a hash of the id and 11 bits
of a hash of the row's number, so equal texts are neighbours, and even one text that fills a third of the
corpus can be cut anywhere, its rows having different ids or not (rows of equal ids and texts are
interchangeable: their numbers only spread them).
The splitters are found without sorting: each round counts the exact bytes of every candidate cell
(``2**bits`` cells under each cell that still holds an undecided splitter), keeps the cell each
target falls into, and refines it in the next round, until the cell weighs less than the tolerance
or is a single key. Only then do rows move, once, to number the slots of each shard.

What reaches the driver in a round is at most shards * 2**bits cell sums.

Defined results: a null text has no bytes and CRC 0 (as an empty one); rows with equal ids and equal
texts get different slots, and fall into several shards where they are too many for one; a null id is a value like any
other; an empty table gives an empty one; further columns of the input are carried along unless
they clash with the added names (shard, slot), which replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffline.llm.store import parallelism, staged

KEY_BITS = 63
ID_BITS, ROW_BITS = 20, 11


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32 and the 63-bit sort key. The key holds a
    row number, so the table is to be written before it is used more than once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc, key = _key(id_col, text)
    return docs.select(F.col(id_col), (F.octet_length(text).cast("long") + overhead).alias("size"), crc.alias("text_crc32"),
                       key.alias("key"))


def _key(id_col: str, text: Column) -> tuple[Column, Column]:
    crc = F.crc32(text.cast("binary"))
    low = lambda h, bits: h.bitwiseAND(F.lit((1 << bits) - 1))
    key = F.shiftleft(crc, ID_BITS + ROW_BITS).bitwiseOR(F.shiftleft(low(F.xxhash64(F.col(id_col)), ID_BITS), ROW_BITS))
    return crc, key.bitwiseOR(low(F.xxhash64(F.monotonically_increasing_id()), ROW_BITS))


def _histogram(rows: DataFrame, shift: int, parents: list[int] | None, parent_shift: int) -> dict[int, int]:
    """Exact bytes by cell (key >> shift), of the cells under ``parents`` or of all."""
    if parents is not None:
        rows = rows.filter(F.shiftright("key", parent_shift).isin(parents))
    cells = rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("bytes"))
    return {r["cell"]: r["bytes"] for r in cells.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, bits: int = 10) -> list[int]:
    """shards - 1 keys; a row's shard is the number of splitters not above its key. A splitter is
    off its target by at most half of ``tolerance`` shards, or half of one key's bytes."""
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    most = tolerance * total / shards
    open_ = {j: (0, 0) for j in range(1, shards)}  # splitter -> (parent cell, bytes below it)
    done: dict[int, int] = {}
    shift, parents, above = KEY_BITS, None, KEY_BITS
    while open_:
        shift = max(0, shift - bits)
        cells = _histogram(rows, shift, parents, above)
        under: dict[int, list[int]] = {}
        for c in sorted(cells):
            under.setdefault(c >> (above - shift), []).append(c)
        left = {}
        for j, (parent, below) in open_.items():
            target = total * j / shards
            for c in under[parent]:
                if below + cells[c] >= target:
                    break
                below += cells[c]
            if shift == 0 or cells[c] <= most:
                up = below + cells[c] - target < target - below
                done[j] = (c + up) << shift
            else:
                left[j] = (c, below)
        open_, above, parents = left, shift, sorted({c for c, _ in left.values()})
    return [done[j] for j in sorted(done)]


def _shard(bounds: list[int]) -> Column:
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("key") >= F.lit(b)).cast("int")
    return shard


def histogram_sort(rows: DataFrame, shards: int, tolerance: float = 0.001, bits: int = 10,
                   rows_per_task: int = 4096) -> DataFrame:
    """``rows`` (with columns key and size) plus shard (0 to shards - 1) and slot (gapless from 0 in
    each shard). Slots follow the key, but for cells of over ``rows_per_task`` rows, which are
    numbered in several tasks."""
    shard = _shard(splitters(rows, shards, tolerance, bits))
    n = rows.count()
    cell_shift = KEY_BITS - min(30, max(4, math.ceil(math.log2(max(1, n / rows_per_task)))))
    dealt = rows.drop("shard", "slot").withColumn("shard", shard).withColumn(
        "__cell", F.shiftright("key", cell_shift))
    hot = staged(dealt.groupBy("shard", "__cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * rows_per_task)
                 .select("shard", "__cell", F.ceil(F.col("n") / rows_per_task).alias("__fan")), "hot-cells")
    dealt = dealt.join(hot, ["shard", "__cell"], "left").withColumn(
        "__sub", F.expr("pmod(key, coalesce(__fan, 1))")).drop("__fan")
    at = ["shard", "__cell", "__sub"]
    offsets = dealt.groupBy(*at).agg(F.count("*").alias("n")).select(*at, F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("__cell", "__sub")
                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*at).orderBy(*[
        c for c in ["key", *rows.columns] if c in rows.columns])) - 1)
    return (numbered.join(offsets, at).withColumn("slot", (F.col("__from") + F.col("__n")).cast("long"))
            .drop("__cell", "__sub", "__from", "__n"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.001) -> DataFrame:
    """id, size, text_crc32, shard, slot for every document."""
    rows = staged(sized(docs, id_col, text_col), "sized")
    return histogram_sort(rows, shards, tolerance).drop("key")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = 0.001) -> None:
    """The documents themselves as one Parquet folder per shard, in the order of their keys. The splitters come from
    counts alone; then the documents are exchanged once, by range of (shard, key)."""
    rows = staged(sized(docs, id_col, text_col), "sized")
    bounds = splitters(rows, shards, tolerance)
    key = _key(id_col, F.coalesce(F.col(text_col), F.lit("")))[1]
    out = docs.drop("shard", "key").withColumn("key", key).withColumn("shard", _shard(bounds))
    out = out.repartitionByRange(max(shards, parallelism(docs.sparkSession)), "shard", "key").sortWithinPartitions("shard", "key")
    out.drop("key").write.partitionBy("shard").mode("overwrite").parquet(path)
