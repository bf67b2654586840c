"""License scan by diagonal voting.

All rolling word 2-grams of every text are hashed and joined to the positions of
the license templates.  A match votes for the diagonal (text position minus
template position); votes are summed by diagonal, and where the template is longer the
neighbouring diagonals are merged into the one of most votes (a missing or extra word
shifts the diagonal).  The merged span is verified: enough of the distinct template
positions must have voted.  Phrases are templates that must match whole on one diagonal.  Everything is
built-in columns.

Scale: the template table is fixed and small (broadcast); texts are read once and
never shuffled.  Only matched positions and one row a document leave the scan.

Defined cases: a null text is empty; texts without words or with one word give no
place; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.barrier import materialize
from .common import row_key, staged, text_or_empty

# Fixed values of the contract: phrase, label.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Notices and license paragraphs: text, label, least share of its 2-grams.
NOTICES = [
    ("released under the mit license", "mit-notice", 0.75),
    ("licensed under the apache license version 2 0", "apache-2.0", 0.75),
    ("licensed under the gnu general public license version 3", "gpl-3.0", 0.75),
    ("licensed under the gnu general public license version 2", "gpl-2.0", 0.95),
    ("licensed under the gnu lesser general public license", "lgpl", 0.75),
    ("licensed under cc by 4 0", "cc-by-4.0", 0.99),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 0.99),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 0.99),
    ("licensed under the bsd 3 clause license", "bsd-3-clause", 0.75),
    ("this source code form is subject to the terms of the mozilla public license v 2 0",
     "mpl-2.0", 0.6),
    ("permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge "
     "publish distribute sublicense and or sell copies of the software", "mit-text", 0.6),
    ("you may not use this file except in compliance with the license you may obtain a copy "
     "of the license at http www apache org licenses license 2 0", "apache-text", 0.6),
    ("this program is free software you can redistribute it and or modify it under the terms "
     "of the gnu general public license as published by the free software foundation",
     "gpl-text", 0.6),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd-text", 0.6),
]
#: 2-grams of two of these cast no vote: they stand in any text.
COMMON = ("a", "and", "any", "are", "as", "at", "by", "can", "for", "from", "in", "is", "it",
          "may", "not", "of", "on", "or", "that", "the", "this", "to", "under", "use", "with",
          "you")
GRAM = 2
#: Diagonals merged with one of most votes, on either side, where the template is no phrase.
SHIFT = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """Lower-cased words: runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(text_or_empty(text)), SEPARATORS), "")


def _gram(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(GRAM)])


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, label, base, tpos, least, n_grams): one row per voting
    template position."""
    rows = [(i, t, label, True, 1.0) for i, (t, label) in enumerate(phrases)]
    rows += [(len(phrases) + i, t, label, False, float(least))
             for i, (t, label, least) in enumerate(notices)]
    t = spark.createDataFrame(rows, "template int, text string, label string, base boolean, least double")
    at = t.select("template", "label", "base", "least", F.split("text", " ").alias("w"))
    every = at.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("tpos"))
    both = F.lit(True)
    for j in range(GRAM):
        both &= F.get("w", F.col("tpos") + j).isin(*COMMON)
    voting = every.where(F.col("base") | ~both)
    return voting.select(_gram("w", F.col("tpos")).alias("gram"), "template", "label", "base",
                         "tpos", "least",
                         F.count("*").over(W.partitionBy("template")).alias("n_grams"))


def votes(df: DataFrame, tmpl: DataFrame, key: str, text: str) -> DataFrame:
    """Matched positions, and one row with position -1 for every row of ``df``."""
    tokens = materialize(df.select(F.col(key).alias("id"), row_key(text).alias("th"),
                                   words_of(text).alias("w")))
    last = F.size("w") - GRAM
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _gram("w", i)))
    # the first element stands for the row itself
    lists = materialize(tokens.select(
        "id", "th", F.size("w").cast("long").alias("n_words"),
        F.concat(F.array(F.lit(None).cast("long")),
                 F.coalesce(grams, F.array().cast("array<bigint>"))).alias("grams")))
    flat = lists.select("id", "th", "n_words", F.posexplode_outer("grams").alias("p", "gram"))
    # the template table is a fixed parameter of a few hundred rows
    hit = flat.join(F.broadcast(tmpl), "gram", "left")
    return (hit.where((F.col("p") == 0) | F.col("template").isNotNull())
               .select("id", "th", "n_words", (F.col("p") - 1).alias("pos"), "template", "label",
                       "base", "tpos", "n_grams", "least"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans: (id, th, label, base, start, end, share)."""
    v = (voted.where(F.col("pos") >= 0)
              .withColumn("diag", F.col("pos") - F.col("tpos"))
              .groupBy("id", "th", "template", "diag")
              .agg(F.first("label").alias("label"), F.first("base").alias("base"),
                   F.first("n_grams").alias("n_grams"), F.first("least").alias("least"),
                   F.collect_set("tpos").alias("voters"),
                   F.min("pos").alias("first"), F.max("pos").alias("last")))
    near = (W.partitionBy("id", "th", "template").orderBy("diag").rangeBetween(-SHIFT, SHIFT))
    merged = F.size(F.array_distinct(F.flatten(F.collect_list("voters").over(near))))
    rank = F.struct(F.size("voters").alias("n"), (-F.col("diag")).alias("d"))
    one = v.select(
        "id", "th", "label", "base", "n_grams", "least",
        F.when(F.col("base"), F.size("voters")).otherwise(merged).alias("n_votes"),
        F.when(F.col("base"), F.col("first")).otherwise(F.min("first").over(near)).alias("start"),
        (F.when(F.col("base"), F.col("last")).otherwise(F.max("last").over(near)) + GRAM).alias("end"),
        (F.col("base") | (rank == F.max(rank).over(near))).alias("peak"))
    share = F.col("n_votes") / F.col("n_grams")
    return (one.where("peak").withColumn("share", share).where(F.col("share") >= F.col("least"))
               .select("id", "th", "label", "base", "start", "end", "share"))


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text",
                  phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """The spans of a table: (key, label, base, start, end, share), in words from 0."""
    tmpl = templates(df.sparkSession, phrases, notices)
    return (spans(votes(df, tmpl, key, text))
            .select(F.col("id").alias(key), "label", "base", "start", "end", "share"))


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text",
                   phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score),
    one row for every row of ``df``."""
    tmpl = templates(df.sparkSession, phrases, notices)
    voted = staged(votes(df, tmpl, key, text), "license-votes")
    found = spans(voted).select("id", "th", F.lit(None).cast("long").alias("n_words"), "label",
                                "base", "start", "share")
    itself = voted.where(F.col("pos") < 0).select(
        "id", "th", "n_words", F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("boolean").alias("base"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("double").alias("share"))
    is_base = F.col("base")

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    out = itself.unionByName(found).groupBy("id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
               .select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word",
                       "base_labels", "labels", "score"))
