"""URL filter by a path-template tree.

Pages are counted once by (host, path segments with digit runs as ``#``). The tree grows level by
level under each host until no path has a further segment; where all paths of a node go on alike,
the rest is taken at once. A segment becomes ``*`` when it is one of very many rare siblings
(a variable segment), or when its labelled block rate does not differ from its siblings' by a
two-proportion test (similar branches merge; without enough labels on both sides nothing is known to
be similar). A leaf template's purity is its labelled block rate, smoothed towards the rate of the
templates that split off at the same place and that towards the rate of all labels. Templates of high
purity are rejected if at least ``least_labels`` of their own pages are labelled: what is known of other
folders, or of the host, alone rejects nothing.

Labels are the verdicts of the listed rules; a page under a rule gets the rule's verdict, every
other page its template's.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged like
any page of host ''; repeated rows are rows of their own; an empty table gives an empty one;
without any label nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.store import ascii_lower, staged

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def with_url_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    part = lambda i: F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i)
    return pages.withColumn("host", ascii_lower(part(1))).withColumn("path", part(2))


def matched_rule(rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments() -> Column:
    """The path's non-empty segments, digit runs as #."""
    return F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def templates(paths: DataFrame, max_kinds: int = 20, min_labels: int = 5, z: float = 1.96) -> DataFrame:
    """paths: (host, segs, n, labelled, blocked). Adds ``template``, the generalised path."""
    cur, closed, i = paths.withColumn("template", F.lit("")), [], 0
    while not closed or not cur.isEmpty():
        seg, at = "seg", ["host", "template"]
        cur = cur.withColumn(seg, F.coalesce(F.get("segs", F.lit(i)), F.lit("")))
        branch = cur.groupBy(*at, seg).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        parent = branch.groupBy(*at).agg(F.count("*").alias("kinds"), F.sum("n").alias("pn"),
                                         F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb"))
        other, other_b = F.col("pl") - F.col("labelled"), F.col("pb") - F.col("blocked")
        pooled = (F.col("pb") + 1) / (F.col("pl") + 2)
        share = lambda x, of: F.try_divide(x.cast("double"), of.cast("double"))
        spread = F.sqrt(pooled * (1 - pooled) * (share(F.lit(1), F.col("labelled")) + share(F.lit(1), other)))
        similar = ((F.col("labelled") >= min_labels) & (other >= min_labels)
                   & (F.abs(share(F.col("blocked"), F.col("labelled")) - share(other_b, other)) < z * spread))
        variable = (F.col("kinds") > max_kinds) & (F.col("n") * max_kinds <= F.col("pn"))
        keep = (F.col(seg) == "") | (F.col("kinds") == 1) | ~(variable | F.coalesce(similar, F.lit(False)))
        part = F.when(F.col(seg) == "", F.lit("")).otherwise(
            F.concat(F.lit("/"), F.when(keep, F.col(seg)).otherwise(F.lit("*"))))
        chosen = branch.join(parent, at).select(*at, seg, part.alias("part"))
        i += 1
        grown = staged(cur.join(chosen, [*at, seg]).withColumn("template", F.concat("template", "part")).drop("part", seg),
                       f"tree-{i}")
        closed.append(grown.filter(F.size("segs") <= i))
        rest = F.slice("segs", i + 1, F.greatest(F.size("segs") - i, F.lit(0)))
        going = grown.filter(F.size("segs") > i).withColumn("rest", rest)
        alike = going.groupBy(*at).agg((F.min("rest") == F.max("rest")).alias("alike"))
        cur = staged(going.join(alike, at), f"tree-open-{i}")
        # a node with one way on has no siblings at any later level
        closed.append(cur.filter("alike").withColumn("template", F.concat("template", F.lit("/"), F.array_join("rest", "/")))
                      .drop("rest", "alike"))
        cur = cur.filter("not alike").drop("rest", "alike")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return staged(out, "tree")


def purities(tree: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """(host, template, own, purity): labelled pages and their block rate, smoothed towards that of the
    templates under the same parent, and that towards all labels'."""
    total = tree.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1)
                      / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("p")).scalar()
    m = F.lit(float(smoothing))
    leaves = (tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("own"))
              .withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")))
    split = leaves.groupBy("host", "parent").agg(((F.sum("b") + m * total) / (F.sum("own") + m)).alias("prior"))
    return leaves.join(split, ["host", "parent"]).select("host", "template", "own", (
        (F.col("b") + m * F.col("prior")) / (F.col("own") + m)).alias("purity"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               threshold: float = 0.8, max_kinds: int = 20, smoothing: float = 5.0, least_labels: int = 3) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), template and purity of every page."""
    named = with_url_parts(pages.select(F.col(id_col), F.col(url_col).alias("__url")), "__url").drop("__url")
    parsed = (named.withColumn("hit", matched_rule(rules))
              .select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("given"),
                      _segments().alias("segs")))
    parsed = staged(parsed, "urls")
    paths = parsed.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("given").alias("labelled"),
        F.sum(F.when(F.col("given") == "block", 1).otherwise(0)).alias("blocked"))
    tree = templates(staged(paths, "paths"), max_kinds)
    judged = tree.join(purities(tree, smoothing), ["host", "template"]).select("host", "segs", "template", "own", "purity")
    impure = (F.col("purity") >= threshold) & (F.col("own") >= least_labels)
    verdict = F.coalesce("given", F.when(impure, "block").otherwise("allow"))
    return parsed.join(judged, ["host", "segs"]).select(id_col, "host", "path", "rule", verdict.alias("verdict"),
                                                        "template", "purity")
