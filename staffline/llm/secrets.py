"""Secrets in texts, judged by how widely each value is owned across the corpus.

Base patterns (fixed by the contract): ``assign`` (a name, a separator and a value), ``access`` (access
key ids) and ``hex`` (long runs of hexadecimal digits). Beside them every long token is a candidate
(``token``: ``min_token`` or more of ``[A-Za-z0-9+/_-]`` with letters and digits).

Every candidate's value is hashed as the text is read; values themselves are never written. The
hashes are counted over the whole corpus by distinct owner and repository. A value that more than
``max_owners`` owners or ``max_repos`` repositories hold is a copied example; one that looks live
(varied characters, no placeholder word) and stays with its owner is a credential. Base spans
always stay and get that verdict; a token is added to the spans (kind ``owned``) only if it is judged
live and touches no base span.

All of it is DataFrame expressions: matches by ``regexp_extract_all``, their places from the lengths
between them (``split`` by the same pattern), summed by a window over the candidates of one text.
The hashes are pre-aggregated by (hash, owner, repository) before any shuffle counts them, and a hash
that holds a large share of all candidates meets its count in a plain join, whose skewed side
adaptive execution splits.

Defined results: a null or empty text has no spans; a null owner or repository is a value like any other;
repeated rows are rows of their own (an example copied inside one repository is still owned by one);
an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffline.llm.store import staged

VALUE = "[A-Za-z0-9+/_.=-]+"
#: Kinds in order: pattern, and the pattern that is cut off in front of the value. The first three are
#: fixed values of the contract.
NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": NAMED + VALUE,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "owned": "[A-Za-z0-9+/_-]{%d,}",
}
BASE = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words of documentation values: whatever holds one is a placeholder.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|change_me|your|xxxx|test|fake|secret|password|12345|abcdef|00000"


def _matches(text: Column, found: Column, pattern: str, kind: str, min_variety: int) -> Column:
    """array of (gap before, length, hash of the value, whether the match holds, whether it looks live)."""
    def entry(gap: Column, m: Column) -> Column:
        value = F.regexp_replace(m, "^" + NAMED, "") if kind == "assign" else m
        variety = F.size(F.array_distinct(F.split(value, "")))
        live = (variety >= min_variety) & ~F.lower(value).rlike(PLACEHOLDERS)
        if kind == "owned":
            holds = m.rlike("[0-9]") & m.rlike("[A-Za-z]") & live
        else:
            holds = F.length(value) >= LEAST[kind]
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), F.sha2(value, 256).alias("hash"),
                        holds.alias("holds"), live.alias("live"))

    both = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m")), lambda x: entry(x["gap"], x["m"]))
    none = F.array().cast("array<struct<gap:int,len:int,hash:string,holds:boolean,live:boolean>>")
    return F.when(F.size(found) > 0, F.filter(both, lambda x: x["len"].isNotNull())).otherwise(none)


def candidates(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text",
               min_token: int = 20, min_variety: int = 8) -> DataFrame:
    """One row per document: __row, id, owner, repo and the matches of each kind, without their texts."""
    patterns = {k: p % min_token if k == "owned" else p for k, p in PATTERNS.items()}
    read = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("id"), owner.alias("owner"),
                       repo.alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # the matches are columns of their own first, as more than one expression reads them
    read = read.select("*", *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    return read.select("__row", "id", "owner", "repo", *[
        _matches(F.col("__text"), F.col(k), p, k, min_variety).alias(k) for k, p in patterns.items()])


def _placed(rows: DataFrame) -> DataFrame:
    """The matches that hold, each with its place in the text: running lengths of what stands before."""
    def numbered(n: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x, i: F.struct(F.lit(n).alias("kind"), i.alias("k"), x.alias("x")))

    every = F.concat(*[numbered(n, k) for n, k in enumerate(PATTERNS)])
    flat = (rows.select("__row", "id", "owner", "repo", F.explode(every).alias("m"))
            .select("__row", "id", "owner", "repo", "m.kind", "m.k", "m.x.*")
            .repartition("__row"))
    run = Window.partitionBy("__row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len"))
    return flat.filter("holds").drop("gap", "len", "k", "holds")


def _clear_of_base(spans: DataFrame) -> DataFrame:
    """Without the tokens that touch a base span (tokens don't overlap each other, so only what stands
    next can begin inside one)."""
    order = Window.partitionBy("__row").orderBy("start", "kind", "end")
    owned = F.col("kind") == len(BASE)
    reached = F.max(F.when(~owned, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__touch", owned & (F.coalesce(reached > F.col("start"), F.lit(False))
                                                  | F.coalesce(F.lead("start").over(order) < F.col("end"), F.lit(False))))
    return marked.filter(~F.col("__touch")).drop("__touch")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repos, places): distinct owners and repositories of every candidate hash."""
    held = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("places"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text",
                 max_owners: int = 1, max_repos: int = 3, min_token: int = 20, min_variety: int = 8) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans; and n_owned, n_live, n_copied (long), live
    (the spans judged credentials, joined as spans are)."""
    rows = staged(candidates(docs, owner, repo, id_col, text_col, min_token, min_variety), "secret-candidates")
    some = sum([F.size(k) for k in PATTERNS], F.lit(0)) > 0
    spans = staged(_clear_of_base(_placed(rows.filter(some))), "secret-spans")
    known = ownership(spans)
    judged = spans.join(known, "hash")
    kept = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = judged.withColumns({"live": F.col("live") & kept, "copied": ~kept})
    judged = judged.filter(f"kind < {len(BASE)} OR live")
    span = F.struct("start", "kind", "end")
    count = lambda c: F.count_if(c)
    found = judged.groupBy("__row", "id").agg(
        *[count(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(PATTERNS)],
        count(F.col("live")).alias("n_live"), count(F.col("copied")).alias("n_copied"),
        F.collect_list(F.when(F.col("kind") < len(BASE), span)).alias("base"), F.collect_list(span).alias("all"),
        F.collect_list(F.when(F.col("live"), span)).alias("sure"))
    numbers = [f"n_{k}" for k in PATTERNS] + ["n_live", "n_copied"]
    rest = rows.select("__row", "id").join(found.select("__row", *numbers, "base", "all", "sure"), "__row", "left")
    empty = lambda c: F.coalesce(_joined(F.col(c)), F.lit(""))
    return rest.select(F.col("id").alias(id_col), *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers[:3]],
                       F.sha2(empty("base"), 256).alias("base_sha256"), empty("all").alias("spans"),
                       *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers[3:]], empty("sure").alias("live"))
