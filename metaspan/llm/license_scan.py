"""License scans by diagonal voting, in DataFrame expressions only.

Every rolling word k-gram of every document meets the k-grams of the license templates in a join on its hash. A hit
at word p of a document and at place q of a template votes for diagonal p - q: the words of a copy vote for one diagonal,
those after an inserted or lost word for a neighbouring one. Votes are summed by diagonal, neighbouring diagonals of a template
are merged, and what a merged group covers of its template decides.

Templates are few and fixed (see TEMPLATES), so their k-grams, under 64 a template, are broadcast; documents are read once and never
shuffled, only hits and a row for each document are. One document's hits meet in one task, as its text does; nothing else does.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A null or empty text has no words and no hits: n_words and n_base
0, first_word and last_word null, labels empty, score 0. Repeated rows, and rows with equal or null ids, get a row each; texts
are scanned whole; an empty table gives none; columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames

#: Phrases that are found wherever their words stand consecutively, with the label that each gives. Their k-grams have two words.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
BASE_WORDS = 2

#: Well-known notices, with the label that each gives. A k-gram has five words; a notice has at most 63 of them, as they are marked in a bit set.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library if not see", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
]
WORDS = 5

#: Diagonals of a template at most so many words apart are one copy.
SLACK = 8
#: Part of a template's k-grams that a copy has at least.
COVERAGE = 0.7

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text. The Kelvin sign is the one character outside ASCII whose lower case is an ASCII letter."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é"))), _BREAKS), "")


def rolling(rows: DataFrame, array: str) -> DataFrame:
    """A row for each word of ``array`` (one without words for an empty one): ``at`` and the word with the next ones, w1 to w5 (null past the end)."""
    shifted = [F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0))) if k else F.col(array) for k in range(WORDS)]
    others = [c for c in rows.columns if c != array]
    found = rows.select(*others, F.posexplode_outer(F.arrays_zip(*[s.alias(f"w{k + 1}") for k, s in enumerate(shifted)])).alias("at", "gram"))
    return found.select(*others, "at", *[F.col(f"gram.w{k + 1}").alias(f"w{k + 1}") for k in range(WORDS)])


def _gram(k: int) -> Column:
    return F.concat_ws(" ", *[f"w{j + 1}" for j in range(k)])


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, n_grams, place, size, hash, words) of every k-gram of the templates."""
    listed = [F.struct(F.lit(k).alias("template"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(k < len(BASE)).alias("base")) for k, (text, label) in enumerate(BASE + TEMPLATES)]
    size = F.when(F.col("base"), BASE_WORDS).otherwise(WORDS)
    texts = spark.range(1).select(F.inline(F.array(*listed))).withColumn("words", words(F.col("text")))
    texts = texts.select("template", "label", "base", size.alias("size"), (F.size("words") - size + 1).alias("n_grams"), "words")
    grams = rolling(texts, "words").where("at < n_grams")
    whole = F.when(F.col("base"), _gram(BASE_WORDS)).otherwise(_gram(WORDS))
    return grams.select("template", "label", "base", "size", "n_grams", F.col("at").alias("place"), F.xxhash64("w1", "w2").alias("hash"), F.xxhash64("w3", "w4", "w5").alias("rest"), whole.alias("gram"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, and ``found``, an array of (label, base, first, last, coverage): places of base phrases and copies of notices."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), frames.long_id(docs, id_col).alias("doc_id"), words(docs[text_col]).alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    grams = F.broadcast(template_grams(docs.sparkSession))
    long = rolling(rows, "words").withColumn("key", F.xxhash64("w1", "w2"))
    # the hash of the first two words joins, that of the others and then the words themselves decide
    same = (F.col("key") == F.col("hash")) & F.when(F.col("base"), F.col("gram") == _gram(BASE_WORDS)).otherwise((F.col("rest") == F.xxhash64("w3", "w4", "w5")) & (F.col("gram") == _gram(WORDS)))
    hits = long.join(grams, same, "left").where("template IS NOT NULL OR at IS NULL OR at = 0")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("n_grams").alias("n_grams"), F.min("at").alias("first"), F.max(F.col("at") + F.col("size") - 1).alias("last"),
        F.expr("bit_or(shiftleft(1L, place))").alias("places"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    # a base phrase has no slack: each diagonal stands alone
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), F.lit(True))
    copies = votes.withColumn("apart", apart.cast("int")).withColumn("copy", F.sum("apart").over(order))
    copies = copies.groupBy("row", "doc_id", "n_words", "template", "copy").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.min("first").alias("first"), F.max("last").alias("last"), (F.bit_count(F.expr("bit_or(places)")) / F.first("n_grams")).alias("coverage")
    )
    verified = F.when(F.col("base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= COVERAGE)
    span = F.when(verified, F.struct("label", "base", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "coverage"))
    return copies.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("found")).drop("row")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The columns of the query, from the spans of scan()."""
    found, base = F.col("found"), F.filter("found", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(found).alias("labels"), F.coalesce(F.array_max(F.transform(found, lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """Words by extraction, phrases by comparing words, copies by joining words to template places."""
    values = lambda rows: ", ".join(f"({k}, '{text}', '{label}')" for k, (text, label) in enumerate(rows))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
    ), bases(k, text, label) AS (VALUES {values(BASE)}), notices(k, text, label) AS (VALUES {values(TEMPLATES)}),
    places AS (
      SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d
    ), base AS (
      SELECT rid, label, p - 1 AS p FROM places JOIN bases ON w[p] = string_split(text, ' ')[1] AND w[p : p + len(string_split(text, ' ')) - 1] = string_split(text, ' ')
    ), grams AS (
      SELECT k, label, q, array_to_string(v[q : q + 4], ' ') AS gram, len(v) - 4 AS n FROM (SELECT k, label, string_split(text, ' ') AS v, unnest(range(1, len(string_split(text, ' ')) - 3)) AS q FROM notices)
    ), votes AS (
      SELECT rid, k, label, n, q, p - q AS diagonal FROM (SELECT rid, p, array_to_string(w[p : p + 4], ' ') AS gram FROM places WHERE p + 4 <= len(w)) JOIN grams USING (gram)
    ), marked AS (
      SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, k ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS apart FROM votes
    ), copies AS (
      SELECT *, sum(apart) OVER (PARTITION BY rid, k ORDER BY diagonal, q ROWS UNBOUNDED PRECEDING) AS copy FROM marked
    ), spans AS (
      SELECT rid, label, count(DISTINCT q) / n AS coverage FROM copies GROUP BY rid, k, label, n, copy HAVING count(DISTINCT q) / n >= {COVERAGE}
    ), b AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
    every AS (SELECT rid, label, 1.0::DOUBLE AS coverage FROM base UNION ALL SELECT rid, label, coverage FROM spans),
    e AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM every GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)
    """
