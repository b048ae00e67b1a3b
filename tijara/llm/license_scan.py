"""License texts in documents, by diagonal voting.

Texts and license templates are cut into words (A-Z lower-cased) and rolling
grams of ``K`` words.

1. Every gram of every document is joined by its 64-bit hash to the template
   positions that hold it; the gram's words are compared too, so a hash that
   two grams share counts for nothing.
2. Each hit votes for a diagonal: place in the text minus place in the template.
   Votes are counted per (document, template, diagonal).  An unbroken copy puts
   all its votes on one diagonal; words put in or left out move the rest of the
   copy to a diagonal nearby.
3. Diagonals of one template at most ``gap`` apart (an eighth of the template's
   words, ``GAP`` at most) merge into one span.
4. A span is verified: the template's grams found on its diagonals (each
   counted once) over all its grams is the coverage, and the span may not be
   longer than ``STRETCH`` times the template; where merged diagonals fail that,
   the best single diagonal speaks alone.  ``MIN_COVERAGE`` or more gives the
   template's label.

Phrases (``PHRASES``) are templates whose every place is wanted: a place is a
diagonal that holds all grams of the phrase, and it starts at the diagonal.

Shuffles: grams meet the templates by a broadcast of the template table, whose
rows are counted on the driver before (at most ``BROADCAST_GRAMS``; beyond that
the hint is left out and Spark shuffles).  What is written and shuffled is one
row a document and one a hit.  Votes are grouped by document, template and
diagonal, so a phrase that every document has is no hot key; the only window is
over one template's diagonals in one document.

Cases: a null text counts as empty; texts without a word, or shorter than a
gram, have no hits and score 0; rows that repeat an id or a text are judged one
by one; null ids take part; an empty table gives an empty result; other columns
pass by unread.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import take, write_shared

K = 3
GAP = 8
STRETCH = 1.5
MIN_COVERAGE = 0.8
BROADCAST_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: FIXED VALUES: phrases of which every place counts, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: FIXED VALUES: public license notices and the opening grants of licenses.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                 "implied. See the License for the specific language governing permissions and limitations under the "
                 "License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; "
              "either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
              "either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software "
               "Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a phrase, words); each needs ``K`` words at least."""
    out = []
    for i, (text, label, phrase) in enumerate([(t, n, True) for t, n in phrases] + [(t, n, False) for n, t in notices]):
        w = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        out.append((i, label, phrase, w))
    return out


def gap(n_words: int) -> int:
    """Greatest distance of diagonals that merge, for a template of so many words."""
    return min(GAP, n_words // 8)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(spark: SparkSession, known) -> DataFrame:
    """One row for every place of every template: its gram's hash and words."""
    rows = [(i, at, *w[at:at + K]) for i, _label, _phrase, w in known for at in range(len(w) - K + 1)]
    g = spark.createDataFrame(rows, "template int, at int, " + ", ".join(f"t{k} string" for k in range(K)))
    g = g.withColumn("hash", F.xxhash64(*[f"t{k}" for k in range(K)]))
    return F.broadcast(g) if len(rows) <= BROADCAST_GRAMS else g


def seen(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """uid, doc_id, n_words, pos, template, at: one row for every hit, and the
    first row of every document in any case (template null if it is no hit)."""
    src = take(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", words(F.col("text")).alias("w"))
    e = src.select("uid", "doc_id", "w", F.posexplode_outer("w").alias("pos", "w0"))
    gram = [F.col("w0")] + [F.get("w", F.col("pos") + k) for k in range(1, K)]
    e = e.select("uid", "doc_id", F.size("w").alias("n_words"), F.coalesce("pos", F.lit(0)).alias("pos"),
                 *[g.alias(f"w{k}") for k, g in enumerate(gram)])
    j = e.withColumn("h", F.xxhash64(*[f"w{k}" for k in range(K)]))
    t = _grams(docs.sparkSession, templates(phrases, notices))
    j = j.join(t, j.h == t.hash, "left")
    same = F.lit(True)
    for k in range(K):
        same = same & F.col(f"w{k}").eqNullSafe(F.col(f"t{k}"))
    hit = F.col("template").isNotNull() & same
    j = j.filter((F.col("pos") == 0) | hit)
    return write_shared(j.select("uid", "doc_id", "n_words", "pos", F.when(hit, F.col("template")).alias("template"),
                                 F.when(hit, F.col("at")).alias("at")), "license-hits")


def _info(column: Column, known, value, kind: str) -> Column:
    """A fixed fact of each template, by its number."""
    return F.get(F.array(*[F.lit(value(t)) for t in known]).cast(f"array<{kind}>"), column)


def diagonals(hits: DataFrame) -> DataFrame:
    """uid, template, diagonal, votes, lo, hi (first and last place in the text), ats."""
    h = hits.filter("template is not null").withColumn("diagonal", F.col("pos") - F.col("at"))
    return h.groupBy("uid", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"),
                                                        F.max("pos").alias("hi"), F.collect_set("at").alias("ats"))


def verified(diags: DataFrame, known) -> DataFrame:
    """uid, template, start_word, end_word (exclusive), coverage, n_diagonals of merged diagonals."""
    t = F.col("template")
    n = _info(t, known, lambda x: len(x[3]), "int")
    far = _info(t, known, lambda x: gap(len(x[3])), "int")
    mine = Window.partitionBy("uid", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(mine) > far).cast("int"), F.lit(1))
    s = (diags.withColumn("new", new).withColumn("island", F.sum("new").over(mine)).groupBy("uid", "template", "island")
         .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("votes", -F.col("lo"), -F.col("hi"))).alias("best"),
              F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.count("*").alias("n_diagonals")))
    fits = F.col("hi") + K - F.col("lo") <= F.greatest(n * STRETCH, n + F.lit(far))
    best = F.col("best")
    return s.select("uid", "template", F.when(fits, F.col("lo")).otherwise(-best["col2"]).alias("start_word"),
                    (F.when(fits, F.col("hi")).otherwise(-best["col3"]) + K).alias("end_word"),
                    (F.when(fits, F.col("found")).otherwise(best["votes"]) / (n - K + 1)).alias("coverage"), "n_diagonals")


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, label, template, start_word, end_word, coverage of every verified span."""
    known = templates(phrases, notices)
    hits = seen(docs, phrases, notices)
    v = verified(diagonals(hits), known).filter(F.col("coverage") >= min_coverage)
    ids = hits.select("uid", "doc_id").distinct()
    return ids.join(v, "uid").select("doc_id", _info(F.col("template"), known, lambda x: x[1], "string").alias("label"),
                                     "template", "start_word", "end_word", "coverage")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base (places of phrases), first_word, last_word (smallest and
    largest start of one), base_labels, labels (those of verified spans too), score (greatest coverage)."""
    known = templates(phrases, notices)
    hits = seen(docs, phrases, notices)
    d = write_shared(diagonals(hits), "license-diagonals")
    t = F.col("template")
    label = _info(t, known, lambda x: x[1], "string")
    whole = _info(t, known, lambda x: x[2], "boolean") & (F.col("votes") == _info(t, known, lambda x: len(x[3]) - K + 1, "int"))
    base = (d.filter(whole).groupBy("uid").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"),
                                               F.max("diagonal").alias("last_word"), F.collect_set(label).alias("base")))
    more = (verified(d, known).groupBy("uid").agg(
        F.max("coverage").alias("score"), F.collect_set(F.when(F.col("coverage") >= min_coverage, label)).alias("more")))
    rows = hits.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    j = rows.join(base, "uid", "left").join(more, "uid", "left")
    b, m = F.coalesce("base", none), F.coalesce("more", none)
    return j.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                    F.array_join(F.array_sort(b), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(b, m)), ",").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score"))
