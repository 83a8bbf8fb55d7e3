"""Mixing sources to target weights by entropy balancing.

Among all document rates r >= 0, bounded by ``cap`` copies, the mix takes those closest to 1 in the
entropy sense, sum(r log r - r + 1), that meet each source's token constraint
sum(r * size) = target. Their form is r = min(cap, exp(lambda * size / scale)) with one dual
variable lambda per source, found by Newton steps on log(tokens / target), kept inside a bracket.
The sums of a step run over the (source, size) histogram, which holds all documents; a step is one
join and one aggregate, and only its largest error reaches the driver.

Rates become whole copies by systematic rounding: documents of a source, longest first, take the
whole numbers passed by the running sum of fixed-point rates. A source's taken tokens then miss the
rates' tokens by at most half of its longest document; copies are the rate rounded up or down, so
never above ``cap``. All sums that decide copies are integers or decimals, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
documents of size 0 take 0 words; repeated rows are rows of their own; an empty table gives an
empty one; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffline.llm.store import sent_if_small, staged

WORD = r"[^\x20\x09-\x0D]+"
ONE = 1 << 30  # fixed-point 1.0 of a rate
MAX_STEPS = 60
DONE = 1e-7


def token_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sources: one row per ``source`` (null allowed) with ``source_size``. Adds ``target``: the
    sources by code point (null last) weigh ``weights`` in turn and share the sum of all sizes by
    weight; a target above cap times its source's size stops there, and the rest goes to the others.

    With sources ordered by cap * size / weight, the stopped ones are a prefix: a source stops if its
    share of what the sources before it leave is above its bound. Running sums over one row per
    source give all that in one pass."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    filled = (weighed.withColumn("bound", F.col("source_size") * cap)
              .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
              .withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("stops", F.col("bound") * F.col("share") < F.col("rest") * F.col("weight"))
              .withColumn("nth", F.row_number().over(order)))
    level = F.min(F.when(~F.col("stops"), F.struct("nth", (F.col("rest") / F.col("share")).alias("level")))).over(every)
    target = F.when(F.col("stops"), F.col("bound").cast("double")).otherwise(F.col("weight") * level["level"])
    return filled.select("source", "source_size", target.alias("target"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _rate(cap: int) -> Column:
    """min(cap, exp(lambda * size / scale)), without overflow."""
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(10.0)))))


def tilts(histogram: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """The dual solution: targets plus ``lam``, ``scale`` and ``full`` (everything at the cap) for
    every source. histogram: (source, size, n) of all documents."""
    positive = histogram.filter("size > 0").groupBy(F.col("source").alias("s")).agg(
        F.min("size").alias("least"), F.max("size").alias("scale"))
    logcap = F.log(F.lit(float(cap)))
    t, s = F.col("target"), F.col("source_size")
    state = targets.join(positive, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", F.coalesce("scale", F.lit(1)).cast("double").alias("scale"),
        (t >= s * cap * (1 - 1e-12)).alias("full"),
        # with one size the answer is log(t / s); the shortest document bounds all others
        F.when(t < s, F.log(t / s) * F.col("scale") / F.col("least")).otherwise(F.lit(0.0)).alias("lo"),
        F.when(t > s, logcap * F.col("scale") / F.col("least")).otherwise(F.lit(0.0)).alias("hi"),
        F.lit(0.0).alias("lam"))
    state = staged(state.withColumn("err", F.lit(1.0)), "tilt")
    for _ in range(MAX_STEPS):
        h = histogram.filter("size > 0").select(F.col("source").alias("hs"), "size", "n")
        open_ = state.filter("source_size > 0 and target > 0 and not full")
        rate = _rate(cap)
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, tokens * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))
        exact = "decimal(38,10)"  # sums that don't depend on the order of rows
        sums = h.join(open_, F.col("hs").eqNullSafe(F.col("source"))).groupBy(F.col("hs").alias("s")).agg(
            F.sum(tokens.cast(exact)).cast("double").alias("f"), F.sum(slope.cast(exact)).cast("double").alias("df"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        f, df, lam = F.col("f"), F.col("df"), F.col("lam")
        lo = F.when(f < t, lam).otherwise(F.col("lo"))
        hi = F.when(f > t, lam).otherwise(F.col("hi"))
        step = F.when(df > 0, lam - f * F.log(f / t) / df)
        inside = step.isNotNull() & (step > lo) & (step < hi)
        nxt = F.when(inside, step).otherwise((lo + hi) / 2)
        err = F.coalesce(F.abs(f / t - 1), F.lit(0.0))
        state = staged(now.select("source", "source_size", "target", "scale", "full", lo.alias("lo"), hi.alias("hi"),
                                  F.when(err > DONE, nxt).otherwise(lam).alias("lam"), err.alias("err")), "tilt")
        if not (state.agg(F.max("err")).first()[0] or 0) > DONE:
            break
    return state.select("source", "source_size", "target", "scale", "full", "lam")


def mix(sized: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3,
        rows_per_task: int = 4096) -> DataFrame:
    """sized: id, ``source``, ``size`` (long). Returns them plus source_size, target (the source's)
    and copies (0 to cap)."""
    sized = staged(sized.select(id_col, "source", "size"), "sized")
    hist = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilted = tilts(hist, staged(source_targets(sources, weights, cap), "targets"), cap)

    rates = hist.join(tilted, hist["source"].eqNullSafe(tilted["source"])).select(
        hist["source"], "size", "n", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), F.round(_rate(cap) * ONE)).otherwise(F.lit(0))
        .cast("long").alias("rate"))
    running = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(rates.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(running), F.lit(0)))
                     .withColumn("fan", F.ceil(F.col("n") / rows_per_task)), "rates")
    # a document's running sum: its size's start plus its number among equals. Numbers are given in
    # tasks of about rows_per_task rows; large groups of one size are dealt over several
    hot = offsets.filter("fan > 1").select(F.col("source").alias("hs"), F.col("size").alias("hz"), "fan")
    spread = sized.join(hot, F.col("source").eqNullSafe(F.col("hs")) & (F.col("size") == F.col("hz")), "left").select(
        F.col(id_col), "source", "size", F.expr(f"pmod(xxhash64(`{id_col}`), coalesce(fan, 1))").alias("part"))
    parts = spread.groupBy("source", "size", "part").agg(F.count("*").alias("k")).withColumn(
        "skip", F.coalesce(F.sum("k").over(Window.partitionBy("source", "size").orderBy("part")
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = parts.join(offsets, parts["source"].eqNullSafe(offsets["source"]) & (parts["size"] == offsets["size"])).select(
        parts["source"].alias("ps"), parts["size"].alias("pz"), F.col("part").alias("pp"), "source_size", "target",
        "rate", (F.col("start") + F.col("skip") * F.col("rate")).alias("from"))
    numbered = spread.withColumn("nth", F.row_number().over(
        Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(id_col), id_col)) - 1)
    joined = numbered.join(starts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))
                           & (F.col("part") == F.col("pp")))
    half = ONE // 2
    whole = lambda c: F.shiftright(c + half, 30)
    begin = F.col("from") + F.col("nth") * F.col("rate")
    return joined.select(id_col, "source", "size", "source_size", "target",
                         (whole(begin + F.col("rate")) - whole(begin)).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """id, source, size, source_size, target, copies and taken (copies * size) of every document."""
    sized = docs.select(F.col(id_col), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("size"))
    return mix(sized, id_col, weights, cap).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it.

    Copies are decided over (id, source, size); equal ones of these are interchangeable, so each row
    takes the copies of the decision with its number among its equals. Only ids that stand more than
    once need numbers; the others are joined by id alone."""
    cols = docs.columns
    sized = docs.select(*cols, token_count(F.col(text_col)).alias("__size"))
    decided = staged(mix(sized.select(F.col(id_col), F.col(source_col).alias("source"), F.col("__size").alias("size")),
                         id_col, weights, cap), "copies")
    key = [F.col(id_col).alias("__id"), F.col("source").alias("__src"), F.col("size").alias("__z")]
    per_key = staged(decided.groupBy(*key).agg(F.count("*").alias("__n"), F.min("copies").alias("__least"),
                                               F.sum("copies").alias("__sum"))
                     .filter("__n > 1 OR __sum != 1"), "taken")  # whoever is not named here is taken once
    same = (F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__src"))
            & (F.col("__size") == F.col("__z")))
    joined = sized.join(sent_if_small(per_key), same, "left").fillna({"__n": 1, "__least": 1, "__sum": 1})
    # running sums round a run of equals to copies that differ by 1 at most: the first few rows get one more
    more = F.col("__sum") - F.col("__least") * F.col("__n")
    once = joined.filter("__n = 1").withColumn("__copies", F.col("__least"))
    many = joined.filter("__n > 1").withColumn("__nth", F.row_number().over(
        Window.partitionBy(id_col, source_col, "__size").orderBy(text_col)))
    many = many.withColumn("__copies", F.col("__least") + (F.col("__nth") <= more).cast("int")).drop("__nth")
    equals = not per_key.filter("__n > 1").isEmpty()  # else one pass over the texts
    every = once.unionByName(many) if equals else joined.withColumn("__copies", F.col("__least"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return every.select(*cols, copies.alias("__copy")).select(*cols)
