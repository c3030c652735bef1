"""License notices by an exact set-similarity join, in DataFrame functions only.

Blocks of a text (lines, and paragraphs between blank lines) are sets of words; so are the templates. A block matches a
template when it holds at least `threshold` of the template's words. Template words are ordered by how many documents
have them, rarest first, over the whole corpus. A match must have one of the first |T| - need + 1 of the template's
words (prefix filter), enough template words in all (length filter), and enough left after the first shared word in
either order (positional filter); what passes is verified exactly. The templates' words are a fixed list, so the
frequencies on the driver and the broadcast prefix table have a size that no input changes.

Beside the templates' labels come those of phrases whose words stand consecutively, with their places.

A null text is empty: no words, no labels, score 0. Rows with equal doc_id and equal text share their result. A null
doc_id stays null. A very long text is one row with its words in an array. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neighborfield.llm.runtime import documents

#: Between words: ASCII that is neither a digit nor a small letter (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
#: (label, kind of block, text): short notices as they are commonly written, matched in a line or a paragraph.
TEMPLATES = (
    ("notice-mit", "line", "Released under the MIT License."),
    ("notice-mit", "line", "This project is licensed under the terms of the MIT License."),
    ("notice-mit", "paragraph", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("notice-apache", "line", "Licensed under the Apache License, Version 2.0."),
    ("notice-apache", "paragraph", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("notice-gpl", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("notice-gpl", "paragraph", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("notice-bsd", "paragraph", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("notice-mpl", "paragraph", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("notice-cc", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("notice-rights", "line", "All rights reserved. No part of this publication may be reproduced"),
)


def template_words(text: str) -> list[str]:
    """A template's distinct words; its text is ASCII."""
    out: dict[str, None] = {}
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        out[word] = None
    return list(out)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def need(size: int, threshold: float) -> int:
    """The fewest shared words that make a containment of threshold."""
    return next(n for n in range(1, size + 1) if n / size >= threshold)


def _places(words: Column, phrase: list[str]) -> Column:
    """Places of a phrase; texts without its last word (the rarest kind of check first) are not walked."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1))), lambda i: _all([F.coalesce(F.get(words, i + (k - 1)) == w, F.lit(False)) for k, w in enumerate(phrase)]))
    return F.when(F.array_contains(words, phrase[0]) & F.array_contains(words, phrase[-1]), F.transform(at, lambda i: (i - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks): blocks lists what matched as
    (kind, block, template, containment); score is the largest containment, 1 where a phrase stands."""
    spark = docs.sparkSession
    sets = [template_words(t) for _, _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    known = F.array(*map(F.lit, vocabulary))
    rows = documents(docs, id_col, text_col).withColumn("words", words_of(F.col("text")))
    held = rows.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    frequency = dict(held.collect())  # at most one row for each of the templates' words
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefix = []
    for t, ((label, kind, _), words) in enumerate(zip(templates, sets, strict=True)):
        ordered, least = sorted(words, key=place.__getitem__), need(len(words), threshold)
        prefix += [(kind, w, t, label, i, len(words), least, ordered) for i, w in enumerate(ordered[: len(words) - least + 1])]
    prefixes = F.broadcast(spark.createDataFrame(prefix, "kind string, word string, template int, label string, at int, size int, need int, own array<string>"))
    by_place = F.array(*map(F.lit, sorted(vocabulary, key=place.__getitem__)))
    rare = F.array(*map(F.lit, sorted({p[1] for p in prefix})))
    smallest = min(p[6] for p in prefix)

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("block"), x.alias("body")))
    paragraphs = F.transform(F.split("text", "\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("block"), x.alias("body")))
    blocks = (
        rows.filter(F.arrays_overlap("words", rare) & (F.size(F.array_intersect("words", known)) >= smallest))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.concat(lines, paragraphs)).alias("b"))
        .select("doc_id", "text_hash", "b.kind", "b.block", F.array_intersect(by_place, words_of(F.col("b.body"))).alias("own"))  # in the order of by_place
        .filter(F.size("own") >= smallest)
    )
    candidates = (
        blocks.select("*", F.posexplode("own").alias("own_at", "word"))
        .join(prefixes.withColumnRenamed("own", "theirs"), ["kind", "word"])
        .filter((F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("own") - F.col("own_at")) >= F.col("need") - F.least("at", "own_at")))
        .withColumn("common", F.size(F.array_intersect("own", "theirs")))
        .filter(F.col("common") >= F.col("need"))
    )
    matched = candidates.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("label")).alias("found"),
        F.max(F.col("common") / F.col("size")).alias("containment"),
        F.sort_array(F.collect_set(F.struct("kind", "block", "template", (F.col("common") / F.col("size")).alias("containment")))).alias("blocks"),
    )
    places = {label: _places(F.col("words"), phrase.split()) for phrase, label in phrases.items()}
    base = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size("words").cast("long").alias("n_words"), *(p.alias(f"_{label}") for label, p in places.items()))
    every = F.concat(*(F.col(f"_{label}") for label in places))
    base = base.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), F.array_compact(F.array(*(F.when(F.size(f"_{label}") > 0, F.lit(label)) for label in sorted(places)))).alias("base"))
    both = base.alias("d").join(matched.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")), "left")
    return both.select(
        "d.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"), "blocks",
    )


def scan_sql(phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, without any filter: every block against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    split = lambda x: f"list_filter(regexp_split_to_array(translate({x}, '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '')"
    values = ", ".join(f"('{label}', '{kind}', {quoted(template_words(text))})" for label, kind, text in templates)
    at = {label: f"list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k}] = ' + chr(39) + w + chr(39) for k, w in enumerate(phrase.split(), 1))})" for phrase, label in phrases.items()}
    return f"""
WITH templates(label, kind, own) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {split("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT doc_id, text, words, {", ".join(f"{v} AS at_{k}" for k, v in at.items())} FROM d),
b AS (SELECT doc_id, text, 'line' AS kind, unnest(string_split(text, chr(10))) AS body FROM d
      UNION ALL SELECT doc_id, text, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM d),
w AS (SELECT doc_id, text, kind, {split("body")} AS words FROM b),
m AS (SELECT doc_id, text, label, len(list_filter(own, lambda x: list_contains(words, x)))::DOUBLE / len(own) AS containment
      FROM w JOIN templates USING (kind)),
f AS (SELECT doc_id, text, max(containment) AS containment, list(DISTINCT label) AS found FROM m WHERE containment >= {threshold} GROUP BY doc_id, text)
SELECT p.doc_id, len(words)::BIGINT AS n_words, len({" || ".join(f"at_{k}" for k in at)})::BIGINT AS n_base,
       list_min({" || ".join(f"at_{k}" for k in at)}) AS first_word, list_max({" || ".join(f"at_{k}" for k in at)}) AS last_word,
       array_to_string(list_filter([{", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{k}' END" for k in sorted(at))}], lambda x: x IS NOT NULL), ',') AS base_labels,
       array_to_string(list_sort(list_concat(list_filter([{", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{k}' END" for k in sorted(at))}], lambda x: x IS NOT NULL), coalesce(found, []))), ',') AS labels,
       CASE WHEN len({" || ".join(f"at_{k}" for k in at)}) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN f ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.text = f.text
"""
