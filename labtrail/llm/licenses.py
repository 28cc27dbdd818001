"""License scans by diagonal voting.

Every rolling word ``k``-gram of a document meets the grams of the templates in one join, by hash and then by text. A match
at word ``pos`` of the document and ``tpos`` of the template votes for the diagonal ``pos - tpos``, where that template would
start. Votes are counted for each diagonal, diagonals at most ``slack`` words apart are merged around the strongest of them
(words may be missing or added), and a merged span is verified by the share of the template's words that its grams cover.
Phrases are templates that must stand word by word: all their grams on one diagonal.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtrail.llm.common import materialise, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that always count, and the opening words of well-known notices. Fixed values.
PHRASES = [
    ("mit", "under the MIT license"),
    ("apache-2", "Apache license version 2"),
    ("cc-by-nc", "CC BY NC"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
K = 3
SLACK = 4
#: The least share of a notice's words; notices that differ in one word of many need more, so that only the nearest counts.
SHARE = 0.8
#: The most template grams that are broadcast; more are joined by shuffling.
BROADCAST_GRAMS = 100_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _grams(column: str, k: int) -> Column:
    """The k-grams of an array of words, in order."""
    return F.expr(f"transform(sequence(1, greatest(size({column}) - {k - 1}, 1)), i -> array_join(slice({column}, i, {k}), ' '))")


def _template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    rows = spark.createDataFrame([(n, *t) for n, t in enumerate(templates)], "template int, label string, text string, whole boolean")
    rows = rows.withColumn("w", words(F.col("text")))
    grams = rows.where(F.size("w") >= k).select("template", "label", "whole", F.size("w").alias("length"), F.posexplode(_grams("w", k)).alias("tpos", "tgram"))
    return grams.withColumn("thash", F.xxhash64("tgram"))


def _key() -> list[Column]:
    """128 bits that name a row of documents: its id and text, however often it is repeated."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")]


def diagonals(docs: DataFrame, templates: list[tuple[str, str, bool]], k: int = K) -> DataFrame:
    """``a, b, template, label, whole, length, diagonal, seen``: for each document and template the diagonals with a vote, and the template's positions that voted."""
    spark = docs.sparkSession
    own = docs.select(*_key(), words(F.col("text")).alias("w")).where(F.size("w") >= k)
    grams = own.select("a", "b", F.posexplode(_grams("w", k)).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = _template_grams(spark, templates, k)
    if sum(len(t.split()) for _, t, _ in templates) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    hits = grams.join(known, (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram")))
    place = ["a", "b", "template", "label", "whole", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")]
    return hits.groupBy(*place).agg(F.array_sort(F.collect_set("tpos")).alias("seen"))


def places(found: DataFrame, k: int = K) -> DataFrame:
    """``a, b, label, start``: where a phrase stands whole."""
    return found.where("whole").where(F.size("seen") == F.col("length") - (k - 1)).select("a", "b", "label", F.col("diagonal").alias("start"))


def spans(found: DataFrame, k: int = K, slack: int = SLACK) -> DataFrame:
    """``a, b, label, start, end, share``: the merged diagonals of notices; share is the part of the notice's words that is there."""
    near = W.partitionBy("a", "b", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    strength = F.struct(F.size("seen").alias("votes"), (-F.col("diagonal")).alias("least"))
    merged = found.where("not whole").select(
        "*",
        F.max(strength).over(near).alias("best"),
        F.flatten(F.collect_list("seen").over(near)).alias("near"),
        F.min(F.col("diagonal") + F.element_at("seen", 1)).over(near).alias("start"),
        F.max(F.col("diagonal") + F.element_at("seen", -1) + k).over(near).alias("end"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("near", lambda t: F.sequence(t, t + (k - 1))))))
    return merged.where("best.least = -diagonal").select("a", "b", "label", "start", "end", (covered / F.col("length")).alias("share"))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, k: int = K, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: ``n_words``; ``n_base, first_word, last_word, base_labels`` of whole phrases; ``labels`` of
    phrases and notices; ``score``, the largest share of any template; ``spans``, those of verified notices with words from 0, end exclusive.

    Null texts are empty: no words, no places, no labels, score 0. Texts of fewer words than ``k`` have no grams. Repeated rows each get
    the same result, rows without doc_id too. A text is one row however long. Templates need at least ``k`` words (else ValueError). Of equally strong
    neighbouring diagonals the first counts. Further columns are ignored; an empty table gives an empty table.
    """
    templates = [(label, text, True) for label, text in (PHRASES if phrases is None else phrases)]
    templates += [(label, text, False) for label, text in (NOTICES if notices is None else notices)]
    if short := [t for _, t, _ in templates if len(re.findall(WORD, t.lower())) < k]:
        raise ValueError(f"fewer than {k} words: {short}")
    # A few rows for each place, written so that the texts are cut into grams once and not once for each use.
    found = materialise(diagonals(docs, templates, k), "diagonals")
    base = places(found, k).select("a", "b", F.lit(True).alias("whole"), "label", "start", F.lit(None).cast("int").alias("end"), F.lit(1.0).alias("share"))
    more = spans(found, k, slack).select("a", "b", F.lit(False).alias("whole"), "label", "start", "end", "share")
    good = F.col("share") >= share
    each = base.unionByName(more).groupBy("a", "b").agg(
        F.count(F.when(F.col("whole"), 1)).alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(~F.col("whole") & good, F.struct("start", "end", "label", "share")))).alias("spans"),
    )
    own = docs.select("doc_id", *_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return own.join(each, ["a", "b"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,share:double>>")).alias("spans"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    rows = [(n, label, text, whole) for n, (label, text, whole) in enumerate([(*p, True) for p in PHRASES] + [(*p, False) for p in NOTICES])]
    values = ", ".join(f"({n}, '{label}', '{text}', {str(whole).lower()})" for n, label, text, whole in rows)
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
    grams = f"unnest(list_transform(range(1, greatest(len(w) - {K - 2}, 1)), lambda i: [CAST(i - 1 AS VARCHAR), array_to_string(w[i:i + {K - 1}], ' ')]))"
    return f"""
    WITH templates(template, label, text, whole) AS (VALUES {values}),
    tw AS (SELECT template, label, whole, {found} AS w FROM templates),
    tg AS (SELECT template, label, whole, len(w) AS length, {grams} AS g FROM tw),
    dw AS (SELECT doc_id, text, {found} AS w FROM documents),
    dg AS (SELECT doc_id, text, {grams} AS g FROM (SELECT DISTINCT doc_id, text, w FROM dw)),
    d AS (SELECT doc_id, dg.text, template, label, whole, length, CAST(dg.g[1] AS INT) - CAST(tg.g[1] AS INT) AS diagonal, list(DISTINCT CAST(tg.g[1] AS INT)) AS seen
        FROM dg JOIN tg ON dg.g[2] = tg.g[2] GROUP BY ALL),
    near AS (SELECT a.doc_id, a.text, a.template, a.label, a.length, a.diagonal,
            max({{'v': len(b.seen), 'l': -b.diagonal}}) AS best, list_distinct(flatten(list(b.seen))) AS tpos
        FROM d a JOIN d b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND a.template = b.template AND b.diagonal BETWEEN a.diagonal - {SLACK} AND a.diagonal + {SLACK}
        WHERE NOT a.whole GROUP BY ALL),
    hits AS (SELECT doc_id, text, label, true AS whole, diagonal AS start, 1.0::DOUBLE AS share FROM d WHERE whole AND len(seen) = length - {K - 1}
        UNION ALL SELECT doc_id, text, label, false, NULL, len(list_distinct(flatten(list_transform(tpos, lambda t: range(t, t + {K}))))) / length FROM near WHERE best.l = -diagonal),
    each AS (SELECT doc_id, text, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {SHARE}) AS labels, max(share) AS score FROM hits GROUP BY ALL)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM dw LEFT JOIN each ON dw.doc_id IS NOT DISTINCT FROM each.doc_id AND dw.text = each.text"""


OP13_SQL = _sql()
