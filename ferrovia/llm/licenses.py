"""Licence scans by diagonal voting.

All rolling word k-grams of the texts are joined to the places of the same k-gram in the
templates. A pair of places votes for its diagonal (place in the text minus place in the
template); neighbouring diagonals are merged, and a merged span is verified by the share of the
template's k-grams that it holds. All steps are DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .licence_texts import TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are in lower case.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 3
#: Words of all templates together, up to which their places are broadcast (about 100 bytes each); those of more are joined by
#: shuffle, a k-gram over SALTS partitions.
MOST_TEMPLATE_WORDS, SALTS = 50_000, 16
#: Diagonals so near are one span; a span this much of a template counts.
NEAR, SHARE = 3, 0.6

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Passages of public licences and notices, with labels of the method.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def template_words(base=BASE, passages=PASSAGES + TEXTS, k: int = K) -> list[tuple[list[str], str, bool]]:
    """(words, label, whether it is a base phrase) of each template. One of fewer than k words is refused."""
    out = []
    for is_base, items in ((True, base), (False, passages)):
        for phrase, label in items:
            words = re.findall(RAW_WORD, phrase)
            if len(words) < k:
                raise ValueError(f"fewer than {k} words: {phrase}")
            out.append(([re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in words], label, is_base))
    return out


def lowered(text: Column, ascii_only: bool) -> Column:
    """text with A-Z in lower case. Where only words of ASCII are looked for, all letters may go to lower case as long as no
    other one becomes a-z; the sign for kelvin is the one that would."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9"))) if ascii_only else lower_ascii(text)


def votes(docs: DataFrame, templates: list[tuple[list[str], str, bool]], k: int) -> DataFrame:
    """(text_key, t, label, is_base, grams, at, place): each place of a text whose k words are those of a template's place.
    text_key is the MD5 of the text."""
    rows = [(t, label, is_base, len(w) - k + 1, i, *w[i : i + k]) for t, (w, label, is_base) in enumerate(templates) for i in range(len(w) - k + 1)]
    grams = docs.sparkSession.createDataFrame(rows, "t int, label string, is_base boolean, grams int, at int, " + ", ".join(f"t{i} string" for i in range(k)))
    grams = grams.withColumn("key", F.xxhash64(*[f"t{i}" for i in range(k)]))
    ascii_only = all(w.isascii() for words, _, _ in templates for w in words)
    found = F.regexp_extract_all(lowered(F.col("text"), ascii_only), F.lit(WORD), F.lit(0))
    words = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), found.alias("w"))
    n = F.size("w")
    shifted = [F.col("w")] + [F.slice("w", F.lit(i + 1), F.greatest(n - i, F.lit(0))) for i in range(1, k)]
    rolled = words.where(n >= k).select("text_key", F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])).alias("place", "g"))
    rolled = rolled.select("text_key", "place", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(k)]).where(F.col(f"w{k - 1}").isNotNull())
    hit = [F.xxhash64(*[f"w{i}" for i in range(k)]) == F.col("key"), *[F.col(f"w{i}") == F.col(f"t{i}") for i in range(k)]]
    if sum(len(w) for w, _, _ in templates) <= MOST_TEMPLATE_WORDS:
        met = rolled.join(F.broadcast(grams), hit)
    else:
        salted = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rolled.join(salted, [F.pmod(F.xxhash64("text_key"), F.lit(SALTS)) == F.col("salt"), *hit])
    return met.select("text_key", "t", "label", "is_base", "grams", "at", "place")


def spans(docs: DataFrame, base=BASE, passages=PASSAGES + TEXTS, k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """(text_key, label, is_base, exact, start, last, score): verified spans of each different text.

    An exact span has all k-grams of its template on one diagonal; others have at least `share`
    of them on diagonals of which each is at most `near` from the next. Such a chain of diagonals over more
    than twice the template's words and `near` is looked at in windows of so many words, each half over the next.
    Of other spans of passages that overlap, those that hold the most k-grams stay, so a licence isn't taken for one of like wording.
    """
    template = ["text_key", "t", "label", "is_base", "grams"]
    diagonals = votes(docs, template_words(base, passages, k), k).groupBy(*template, (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("held"), F.min("place").alias("first"), F.max("place").alias("end")
    )
    diagonals = written(diagonals, "diagonals")
    exact = diagonals.where(F.size("held") == F.col("grams")).select(
        "text_key", "label", "is_base", F.lit(True).alias("exact"), F.col("first").alias("start"), (F.col("end") + k - 1).alias("last"), F.lit(1.0).alias("score"), F.col("grams").alias("n")
    )
    line = Window.partitionBy("text_key", "t").orderBy("diagonal")
    stepped = diagonals.withColumn("step", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= near, 0).otherwise(1)).withColumn("island", F.sum("step").over(line))
    chain = Window.partitionBy("text_key", "t", "island")
    most = 2 * (F.col("grams") + k - 1) + near
    wide = F.max("end").over(chain) - F.min("first").over(chain) + k > most
    half = F.floor(F.col("first") / F.floor(most / 2))
    seated = stepped.withColumn("wide", wide).withColumn("window", F.explode(F.when(F.col("wide"), F.array(half - 1, half)).otherwise(F.array(F.lit(0).cast("long")))))
    merged = seated.groupBy(*template, "island", "window").agg(
        F.min("first").alias("start"), (F.max("end") + k - 1).alias("last"),
        F.count(F.when(F.size("held") == F.col("grams"), 1)).alias("whole"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"),
    )
    part = F.col("n") / F.col("grams")
    loose = merged.where((F.col("whole") == 0) & (part >= share)).select("text_key", "label", "is_base", F.lit(False).alias("exact"), "start", "last", part.alias("score"), "n")
    both = exact.union(loose)
    others = Window.partitionBy("text_key", "is_base").orderBy("start", "last", "label")
    chained = both.withColumn("apart", F.when(F.col("start") > F.max("last").over(others.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0))
    chained = chained.withColumn("chain", F.sum("apart").over(others.rowsBetween(Window.unboundedPreceding, 0)))
    richest = F.max("n").over(Window.partitionBy("text_key", "is_base", "chain"))
    return chained.withColumn("most", richest).where(F.col("exact") | (F.col("n") == F.col("most"))).select("text_key", "label", "is_base", "exact", "start", "last", "score")


def scan(docs: DataFrame, **how) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels and score.

    n_base counts the places of base phrases, first_word and last_word are the least and
    largest of their starts (null without any). Labels are distinct, sorted and joined by commas;
    none gives an empty string and score 0. A null or empty text has no words. Rows that
    repeat are kept, and equal texts have equal results.
    """
    found = spans(docs, **how)
    at_base = F.col("is_base") & F.col("exact")
    per_text = found.groupBy("text_key").agg(
        F.count(F.when(at_base, 1)).alias("n_base"), F.min(F.when(at_base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(at_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(at_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    per_text = written(per_text, "licences")
    own = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(RAW_WORD)).cast("long").alias("n_words"))
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return own.join(per_text, "text_key", "left").fillna(none).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
