"""License scans by diagonal voting.

Rolling hashes of a text's words are joined with the positions that equal runs of
words have in templates. A hit votes for the diagonal on which it lies: the word
at which the template would begin in the text. A phrase stands where all of its
runs vote for one diagonal. A longer template may have lost or gained words, which
moves its later votes to a neighbouring diagonal: those are merged, and the span
that they cover is verified by how much of the template it holds.

Two widths of runs are joined: pairs of words, the shortest a phrase can have, and
fours for the templates, which common words would otherwise match everywhere. All
of it is DataFrame functions; each word of a hit is compared, not its hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buswright.llm.common import table

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases with their labels, and notices as their publishers word them.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-deed", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
)

#: Words of a rolling hash of phrases and of templates.
PAIR, FOUR = 2, 4
#: Diagonals so many words apart are merged.
SLACK = 4
#: The share of a template's words that a span must hold, in percent, and how many times its length the span may have.
COVERED, STRETCHED = 70, 2


def words(text: Column) -> Column:
    """The words of a text, Latin letters lower-cased. The KELVIN SIGN, which lower() makes a k, stays what it is."""
    lowered = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    # many times as fast as regexp_extract_all; an end of the text that is no word leaves an empty piece
    return F.array_remove(F.split(lowered, GAPS), "")


def _rolled(all_words: Column) -> Column:
    """Each word with the three after it, null past the end."""
    after = [F.slice(all_words, F.lit(k + 1), F.size(all_words)).alias(f"w{k}") for k in range(1, FOUR)]
    return F.arrays_zip(all_words.alias("w0"), *after)


def positions(spark: SparkSession, entries: tuple[tuple[str, str], ...], width: int) -> DataFrame:
    """A row for each distinct run of ``width`` words: h (its hash) and where (label, length of the template, place in it and the words of the run).

    As many rows as the templates have words.
    """
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in entries])).alias("t"))
    rows = rows.select("t.label", words(F.col("t.text")).alias("all"))
    rows = rows.select("label", F.size("all").alias("length"), F.posexplode(_rolled(F.col("all"))).alias("at", "run")).where(F.col(f"run.w{width - 1}").isNotNull())
    run = [F.col(f"run.w{k}").alias(f"w{k}") for k in range(width)]
    return rows.groupBy(F.xxhash64(*run).alias("h")).agg(F.collect_list(F.struct("label", "length", "at", F.array(*run).alias("run"))).alias("where"))


def spans(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, slack: int = SLACK, covered: int = COVERED) -> DataFrame:
    """A row for each of ``docs``: doc_id, n_words, score and spans, an array of (first_word, last_word, label, exact, share).

    Words count from 0. A span is ``exact`` where a phrase stands word by word, each
    place of it a span of its own; others hold at least ``covered`` percent of a
    template's words. ``score`` is the largest share of a template or phrase that
    any place of the text holds, verified or not, in [0, 1]; 0 without a hit.

    Null texts are like empty ones: no words, no spans. Rows that repeat a doc_id, or
    have none, are rows of their own. Texts are read whole; the words of one row are
    held by its task, and what moves is one small row a document and one a hit. Other
    columns are left out, whatever their names. Phrases have two words at least and
    templates four. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    all_words = words(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("doc_id"), all_words.alias("all"))
    rows = rows.withColumn("n_words", F.size("all")).select("key", "doc_id", "n_words", F.posexplode_outer(_rolled(F.col("all"))).alias("pos", "run"))
    run = [F.col(f"run.w{k}") for k in range(FOUR)]
    hits = rows.select("key", "doc_id", "n_words", "pos", *[w.alias(f"w{k}") for k, w in enumerate(run)], F.xxhash64(*run[:PAIR]).alias("pair"), F.xxhash64(*run).alias("four"))
    # as many rows as the templates have words, which are fixed
    for name, entries, width in (("pair", phrases, PAIR), ("four", templates, FOUR)):
        found = positions(spark, entries, width).select(F.col("h").alias(name), F.col("where").alias(f"{name}_at"))
        hits = hits.join(F.broadcast(found), name, "left")
    # a document's first word stays without a hit too: each document has a row
    hits = hits.where("pair_at IS NOT NULL OR four_at IS NOT NULL OR pos IS NULL OR pos = 0")
    same = lambda width: lambda t: t["run"] == F.array(*[F.col(f"w{k}") for k in range(width)])
    vote = lambda exact: lambda t: F.struct(t["label"].alias("label"), t["length"].alias("length"), t["at"].alias("at"), F.lit(exact).alias("exact"))
    none = F.array().cast("array<struct<label:string,length:int,at:int,exact:boolean>>")
    votes = [F.coalesce(F.transform(F.filter(f"{name}_at", same(width)), vote(exact)), none) for name, width, exact in (("pair", PAIR, True), ("four", FOUR, False))]
    hits = hits.select("key", "doc_id", "n_words", "pos", F.explode_outer(F.concat(*votes)).alias("t"))
    hits = hits.select("key", "doc_id", "n_words", "t.label", "t.exact", "t.length", "t.at", (F.col("pos") - F.col("t.at")).alias("diagonal")).repartition("key")

    about = ["key", "doc_id", "n_words", "label", "exact", "length"]
    diagonals = hits.groupBy(*about, "diagonal").agg(F.collect_set("at").alias("ats"))
    neighbours = Window.partitionBy("key", "label", "exact", "length").orderBy("diagonal")
    begins = F.when(F.col("exact") | F.col("exact").isNull(), True).otherwise(F.coalesce(F.col("diagonal") - F.lag("diagonal").over(neighbours) > slack, F.lit(True)))
    merged = diagonals.withColumn("group", F.sum(begins.cast("int")).over(neighbours))
    starts = F.col("diagonal") + F.array_min("ats")
    ends = F.col("diagonal") + F.array_max("ats") + F.when(F.col("exact"), PAIR).otherwise(FOUR) - 1
    merged = merged.groupBy(*about, "group").agg(F.min(starts).alias("first_word"), F.max(ends).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    wide = F.when(F.col("exact"), F.lit(PAIR)).otherwise(F.lit(FOUR))
    held = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + wide - 1)))))
    # a phrase has each of its pairs on one diagonal
    share = F.when(F.col("exact"), (F.size("ats") == F.col("length") - (PAIR - 1)).cast("double")).otherwise(held / F.col("length"))
    fits = F.col("exact") | ((100 * held >= covered * F.col("length")) & (F.col("last_word") - F.col("first_word") < STRETCHED * F.col("length")))
    span = F.struct("first_word", "last_word", "label", "exact", "share")
    out = merged.withColumn("share", share).withColumn("span", F.when(fits & (F.col("share") > 0), span))
    return out.groupBy("key", "doc_id", "n_words").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.sort_array(F.collect_list("span")).alias("spans")).drop("key")


def op13_diagonal_licenses(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    firsts = F.transform(base, lambda s: s["first_word"])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )


def _values(entries: tuple[tuple[str, str], ...], exact: bool) -> str:
    return ", ".join(f"('{label}', '{text}', {str(exact).lower()})" for label, text in entries)


_SPLIT = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '{WORD_PATTERN}')"
OP13_SQL = rf"""
WITH t AS (
  SELECT label, exact, {_SPLIT.format("text")} AS ws
  FROM (VALUES {_values(PHRASES, True)}, {_values(TEMPLATES, False)}) AS v(label, text, exact)
), tp AS (
  SELECT label, exact, len(ws) AS length, unnest(range(len(ws))) AS place, ws FROM t
), tg AS (
  SELECT label, exact, length, place, ws[place + 1 : place + CASE WHEN exact THEN 2 ELSE 4 END] AS run,
         CASE WHEN exact THEN 2 ELSE 4 END AS width
  FROM tp WHERE place + CASE WHEN exact THEN 2 ELSE 4 END <= length
), d AS (
  SELECT row_number() OVER () AS k, doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents
), p AS (
  SELECT k, ws, unnest(range(len(ws))) AS pos FROM d
), g AS (
  SELECT k, pos, width, ws[pos + 1 : pos + width] AS run FROM p, (VALUES (2), (4)) AS w(width) WHERE pos + width <= len(ws)
), h AS (
  SELECT k, pos, label, exact, length, place, tg.width, pos - place AS diagonal
  FROM g JOIN tg ON g.run = tg.run AND g.width = tg.width
), b AS (
  SELECT k, label, exact, length, width, diagonal, list(DISTINCT place) AS places, min(place) AS low, max(place) AS high
  FROM h GROUP BY ALL
), e AS (
  SELECT *, CASE WHEN exact THEN 1
                 WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, label, exact, length ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS begins
  FROM b
), m AS (
  SELECT *, sum(begins) OVER (PARTITION BY k, label, exact, length ORDER BY diagonal) AS grp FROM e
), s AS (
  SELECT k, label, exact, length, width, grp, min(diagonal + low) AS first_word, max(diagonal + high + width - 1) AS last_word,
         list_distinct(flatten(list(places))) AS places
  FROM m GROUP BY ALL
), c AS (
  SELECT *, len(list_distinct(flatten(list_transform(places, lambda x: range(x, x + width))))) AS held FROM s
), f AS (
  SELECT k, label, exact, first_word,
         CASE WHEN exact THEN CASE WHEN len(places) = length - 1 THEN 1.0 ELSE 0.0 END ELSE held / length END::DOUBLE AS share,
         CASE WHEN exact THEN len(places) = length - 1
              ELSE 100 * held >= {COVERED} * length AND last_word - first_word < {STRETCHED} * length END AS fits
  FROM c
), r AS (
  SELECT k, count(*) FILTER (WHERE exact AND fits) AS n_base,
         min(first_word) FILTER (WHERE exact AND fits) AS first_word, max(first_word) FILTER (WHERE exact AND fits) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact AND fits) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE fits) AS labels, max(share) AS score
  FROM f GROUP BY k
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (k)
"""
