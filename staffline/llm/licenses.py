"""License scans by diagonal voting.

Every text's words are cut into rolling k-grams (k = 2 for the short phrases, a longer k for the
license texts) whose hashes are joined to the positions where they stand in the templates. A match
of text word i and template word j votes for the diagonal i - j. Votes are counted by diagonal
before they are shuffled; neighbouring diagonals of one template (words put in or left out) are
merged into one span; and a span is kept if the template words it matches, compared as words and
not as hashes, are enough of the template.

The templates are a small parameter: their k-grams (a few thousand rows) are broadcast after a check
of their number; beyond MAX_BROADCAST they are joined by shuffle instead.

Defined results: a null text counts as empty (0 words, no labels, score 0); repeated rows are rows of
their own; an empty table gives an empty one; further columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffline.llm.store import ascii_lower, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST = 200_000
BITS = 62  # template words of one long of a mask

# fixed values: the phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: passages of public license texts and notices, with the label they show
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the "
               "license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, k: int = 4, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """One row per k-gram place: template, label, base, length, k, grams (places of the template),
    j (word position), the k words, and a mask of their positions. Base phrases use k = 2; a passage shorter than k uses its
    length."""
    rows = []
    cut = lambda s: re.findall(WORD, s.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    masks = lambda j, n, size: [sum(1 << (i - b) for i in range(j, j + n) if b <= i < b + BITS) for b in range(0, size, BITS)]
    for t, (label, text, base) in enumerate([(b, a, True) for a, b in phrases] + [(a, b, False) for a, b in passages]):
        w = cut(text)
        n = 2 if base else min(k, len(w))
        rows += [(t, label, base, len(w), n, len(w) - n + 1, j, w[j:j + n], masks(j, n, len(w))) for j in range(len(w) - n + 1)]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, k int, grams int, j int, gram array<string>, mask array<long>")


def _gram(pos: Column, k: int) -> list[Column]:
    return [F.get(F.col("words"), pos + i) for i in range(k)]


def diagonal_votes(docs: DataFrame, grams: DataFrame, row: str) -> DataFrame:
    """docs: ``row``, ``words``. One row per (row, template, diagonal) with its votes, extent and the
    template words matched (bits of m0, m1, ...), and one with a null template per row of docs."""
    ks = sorted(r["k"] for r in grams.select("k").distinct().collect())  # a handful by construction
    small = grams.count() <= MAX_BROADCAST
    placed = docs.select(row, F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "word"))
    here = F.slice("words", F.col("pos") + 1, max(ks))  # the words a match may compare
    for k in ks:
        hashed = F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(*_gram(F.col("pos"), k)))
        placed = placed.withColumn(f"h{k}", hashed)
    if not small:  # rows that are shuffled carry no whole text
        placed = placed.withColumn("here", here).drop("words", "word")
    hits = []
    for k in ks:
        table = grams.filter(F.col("k") == k).groupBy(F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(k)]).alias(f"h{k}")).agg(
            F.collect_list(F.struct("template", "base", "length", "grams", "j", "k", "gram", "mask")).alias(f"at{k}"))
        placed = placed.join(F.broadcast(table) if small else table, f"h{k}", "left")
        hits.append(F.col(f"at{k}"))
    found = F.concat(*[F.coalesce(h, F.array().cast(
        "array<struct<template:int,base:boolean,length:int,grams:int,j:int,k:int,gram:array<string>,mask:array<bigint>>>")) for h in hits])
    any_hit = F.coalesce(*hits).isNotNull()
    at = (placed.filter(any_hit | F.col("pos").isNull() | (F.col("pos") == 0))
          .select(row, "n_words", "pos", (here if small else F.col("here")).alias("here"), F.explode_outer(found).alias("t")))
    same = F.slice("here", 1, F.col("t.k")) == F.col("t.gram")
    t = F.col("t")
    seen = at.select(row, "n_words", "pos", F.when(same, t).alias("t"))
    longs = -(-(grams.agg(F.max("length")).first()[0] or 1) // BITS)
    # a row that has no vote stays as its text's word count
    return (seen.groupBy(row, "n_words", F.col("t.template").alias("template"), (F.col("pos") - F.col("t.j")).alias("diagonal"))
            .agg(F.first("t.base").alias("base"), F.first("t.length").alias("length"), F.first("t.grams").alias("grams"),
                 F.first("t.k").alias("k"), F.count("*").alias("votes"),
                 *[F.bit_or(F.get("t.mask", F.lit(b))).alias(f"m{b}") for b in range(longs)],
                 F.min(F.col("t.j")).alias("j0"), F.max(F.col("t.j") + F.col("t.k")).alias("j1")))


def spans(votes: DataFrame, row: str, drift: int = 3, least: float = 0.6) -> DataFrame:
    """Verified spans: row, template, base, first, last (word positions, last exclusive) and coverage.
    A base phrase needs its whole length on one diagonal. A passage's diagonals up to ``drift`` apart
    are merged if they also overlap in the text; its coverage is the share of its words that
    verified k-grams cover, each counted once."""
    base = votes.filter("base and votes = grams").select(
        row, "template", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length")).alias("last"),
        F.lit(1.0).alias("coverage"))
    masks = [c for c in votes.columns if re.fullmatch("m[0-9]+", c)]
    w = Window.partitionBy(row, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) > drift
    merged = (votes.filter("not base").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
              .withColumn("band", F.sum("new").over(w))
              .groupBy(row, "template", "band").agg(
                  F.first("length").alias("length"), F.min(F.col("diagonal") + F.col("j0")).alias("first"),
                  F.max(F.col("diagonal") + F.col("j1")).alias("last"),
                  *[F.bit_or(m).alias(m) for m in masks]))
    matched = sum((F.coalesce(F.bit_count(m), F.lit(0)) for m in masks), F.lit(0))
    coverage = matched / F.col("length")
    long = merged.withColumn("coverage", coverage).filter(F.col("coverage") >= least).select(
        row, "template", F.lit(False).alias("base"), "first", "last", "coverage")
    return base.unionByName(long)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, drift: int = 3,
                  least: float = 0.6, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (the best coverage) and ``spans`` (label, first, last, coverage), sorted."""
    spark = docs.sparkSession
    grams = template_table(spark, k, phrases, passages)
    # the row's number in the scan: ids may repeat or be null
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")).alias("row"),
                       words(F.col(text_col)).alias("words"))
    votes = staged(diagonal_votes(rows, grams, "row"), "votes")  # read three times below
    labels = F.create_map(*[x for t, label in sorted({r["template"]: r["label"] for r in grams.select(
        "template", "label").distinct().collect()}.items()) for x in (F.lit(t), F.lit(label))])
    found = spans(votes.filter("template is not null"), "row", drift, least)
    every = (votes.select("row", F.col("n_words"), F.lit(None).cast("struct<first:int,last:int,label:string,base:boolean,coverage:double>").alias("s"))
             .unionByName(found.select("row", F.lit(None).cast("int").alias("n_words"), F.struct(
                 F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"),
                 F.element_at(labels, F.col("template")).alias("label"), "base", "coverage").alias("s"))))
    base = F.col("s.base")
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = every.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("s.first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("s.first"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("s.label"))).alias("base_labels"), names(F.col("s.label")).alias("labels"),
        F.coalesce(F.max("s.coverage"), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list("s")).alias("spans"))
    return out.select(F.col("row.id").alias(id_col), *[c for c in out.columns if c != "row"])
