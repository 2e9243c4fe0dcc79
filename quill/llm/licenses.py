"""License scans: an exact set-similarity join of text blocks with license templates, in column expressions only.

A block is a run of words: every template of up to half a block's words that
stands in a text lies whole in some block, as blocks overlap by half. A block
matches a template if it holds at least CONTAINMENT of the template's distinct
words. Tokens are ordered by their frequency in the whole corpus, rarest first,
and three filters leave few pairs to verify, losing none:

- length: the block must hold enough template words at all;
- prefix: of `need` common words, one is among the first |t| - need + 1 of the
  template and the first |b| - need + 1 of the block;
- position: from a first common word on, enough words must be left on both sides.

The template table is a parameter with a bound (MOST_TEMPLATES), so it is
broadcast; of the corpus only the places that may match are exploded, and what
is shuffled is a few numbers a document.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

CONTAINMENT = 0.85
MOST_TEMPLATES = 2000
#: Words in the smallest block; the next are each so many times as long.
BLOCK, BLOCK_STEP = 32, 8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices of common licenses, as their publishers word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Letters beyond ASCII that lower() would turn into ASCII ones, and letters that it leaves.
LOOKALIKES = (("\u0130", "\u0131"), ("\u212a", "\u0138"))


def _tokens(text: str) -> list[str]:
    for old, new in LOOKALIKES:
        text = text.replace(old, new)
    return [w for w in re.split(GAP, text.lower()) if w]


def _lowered(text):
    """A-Z in lower case. lower() also maps other letters, but none of those left here to ASCII or a separator."""
    for old, new in LOOKALIKES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.lower(text)


def _words(text):
    return F.array_remove(F.split(_lowered(text), GAP), "")


def _block(n: int) -> int:
    """Words in the blocks for a template of n words: the least size that is twice as long."""
    size = BLOCK
    while size < 2 * n:
        size *= BLOCK_STEP
    return size


def _needed(size: int, containment: float) -> int:
    return math.ceil(containment * size - 1e-9)


def templates_with_scale(templates) -> list[tuple[int, str, int, list[str]]]:
    """(number, label, words in a block, distinct tokens) of each template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; MOST_TEMPLATES is {MOST_TEMPLATES}")
    out = []
    for number, (label, text) in enumerate(templates):
        tokens = _tokens(text)
        if not tokens:
            raise ValueError(f"template {number} has no words")
        out.append((number, label, _block(len(tokens)), list(dict.fromkeys(tokens))))
    return out


def _literal(tokens: list[str]):
    # One literal of the plan, however many tokens.
    return F.split(F.lit(" ".join(tokens)), " ")


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, rarest in the whole corpus first."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    seen = docs.select(F.explode(_words(whole_text())).alias("token")).join(F.broadcast(table), "token").groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}  # no more rows than template tokens
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _starts(scale: int):
    """First words of the blocks of `scale` words, each half a block behind the one before."""
    half = scale // 2
    last = F.greatest(F.lit(0), F.floor((F.size("w") - 1 - half) / half).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.lit(scale).alias("scale"), (j * half).alias("start")))


def _stands(parts: list[str]):
    """Whether the words from i on are these."""

    def test(i):
        out = F.get("w", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get("w", i + k) == part)
        return F.coalesce(out, F.lit(False))

    return test


def matches(read: DataFrame, docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """key columns doc_id and h, block start, label, containment: every block of `read` (doc_id, h, w) that a template matches."""
    spark = docs.sparkSession
    known = templates_with_scale(templates)
    order = token_order(docs, sorted({t for *_, tokens in known for t in tokens}))
    rank = {t: i for i, t in enumerate(order)}
    prefixes, wholes = [], []
    for number, label, scale, tokens in known:
        tokens = sorted(tokens, key=rank.get)
        need = _needed(len(tokens), containment)
        wholes.append((number, label, tokens))
        prefixes += [(scale, t, number, at, len(tokens), need) for at, t in enumerate(tokens[: len(tokens) - need + 1])]
    prefix_table = spark.createDataFrame(prefixes, "scale int, token string, number int, t_at int, t_size int, need int")
    whole_table = spark.createDataFrame(wholes, "number int, label string, tokens array<string>")
    least = {scale: min(p[5] for p in prefixes if p[0] == scale) for scale in {p[0] for p in prefixes}}

    may = read.filter(F.arrays_overlap("w", _literal(sorted({p[1] for p in prefixes}))))
    starts = F.concat(*(_starts(scale) for scale in sorted(least)))
    blocks = may.withColumn("b", F.explode(starts)).select("doc_id", "h", "b.scale", "b.start", F.slice("w", F.col("b.start") + 1, F.col("b.scale")).alias("run"))
    # The block's template tokens in the global order, each once.
    blocks = blocks.withColumn("tokens", F.array_intersect(_literal(order), "run")).drop("run")
    enough = F.lit(False)
    for scale, need in least.items():
        enough = enough | ((F.col("scale") == scale) & (F.size("tokens") >= need))
    placed = blocks.filter(enough).withColumnRenamed("tokens", "b_tokens").select("*", F.posexplode("b_tokens").alias("b_at", "token"))
    met = placed.join(F.broadcast(prefix_table), ["scale", "token"]).filter(
        (F.col("b_at") <= F.size("b_tokens") - F.col("need"))
        & (1 + F.least(F.col("t_size") - F.col("t_at") - 1, F.size("b_tokens") - F.col("b_at") - 1) >= F.col("need"))
    )
    common = F.size(F.array_intersect("b_tokens", "tokens"))
    found = met.join(F.broadcast(whole_table), "number").withColumn("common", common).filter(F.col("common") >= F.col("need"))
    return found.select("doc_id", "h", "start", "number", "label", (F.col("common") / F.col("t_size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: the places of the base phrases, and the labels of all matching templates.

    A null text is empty: no words, no labels, score 0, first_word and last_word
    null. Repeated rows are scanned alike and all returned; rows that share a
    doc_id keep their own results. An empty table gives no rows. Other columns
    are not looked at. score: 1 where a base phrase stands, else the largest
    containment of a matching template, else 0.
    """
    text = whole_text()
    read = docs.select("doc_id", F.xxhash64("doc_id", text).alias("h"), _lowered(text).contains("license").alias("may"), _words(text).alias("w"))
    places = []
    for phrase, label in PHRASES:
        at = F.when(F.col("may") & (F.size("w") > 0), F.filter(F.sequence(F.lit(0), F.size("w") - 1), _stands(phrase.split()))).otherwise(F.array().cast("array<int>"))
        places.append((label, at))
    base = read.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), *(at.alias(f"at_{label}") for label, at in places))
    every = F.concat(*(F.col(f"at_{label}") for label, _ in places))
    named = F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in places)))
    base = base.withColumn("every", every).withColumn("base", F.array_sort(named)).drop(*(f"at_{label}" for label, _ in places))
    found = matches(read.select("doc_id", "h", "w"), docs, templates, containment).groupBy("doc_id", "h").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "own", "best")
    rows = base.join(found, (F.col("h") == F.col("f_h")) & F.col("doc_id").eqNullSafe(F.col("f_id")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    """Every block against every template, without any filter."""
    rows, known = [], templates_with_scale(TEMPLATES)
    for number, label, scale, tokens in known:
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows.append(f"({number}, '{label}', {scale}, [{listed}], {_needed(len(tokens), CONTAINMENT)})")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, '{phrase.split()[-1]}')) "
        f"WHERE array_to_string(w[i : i + {len(phrase.split()) - 1}], ' ') = '{phrase}'"
        for phrase, label in PHRASES
    )
    blocks = " UNION ALL ".join(
        f"SELECT doc_id, {b} AS scale, list_distinct(w[j * {b // 2} + 1 : j * {b // 2} + {b}]) AS run "
        f"FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ((len(w) - 1) // {b // 2})::INT))) AS j FROM d)"
        for b in sorted({scale for _, _, scale, _ in known})
    )
    return rf"""
WITH t(number, label, scale, tokens, need) AS (VALUES {", ".join(rows)}
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), base AS ({cases}
), b AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id
), blocks AS ({blocks}
), m AS (
  SELECT doc_id, label, len(list_intersect(run, tokens)) / len(tokens)::DOUBLE AS c FROM blocks JOIN t USING (scale)
  WHERE len(list_intersect(run, tokens)) >= need
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id
), best AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE_SQL = _oracle()
