"""License scans by an exact set-similarity join.

Templates are short license notices. A text block matches a template if it holds at least ``threshold`` of the template's
distinct words (containment). Blocks are windows of 2 * stride words that begin every stride words, so each run of up to
stride words lies whole in one of them; notices of up to 16 words are looked for in windows of stride 16, longer ones in those
of stride 64, wherever lines break.

The join is exact. Words of templates are ordered by the number of documents that hold them, rarest first. Of a template with
n words, of which a must be met, only the n - a + 1 first are indexed (prefix filter: a block that meets a words meets one of
these). A block's template words, in the same order, fetch templates by an equi-join on the word; a pair goes on if the block
has at least a of them (length filter) and what follows the common word on both sides can still make a (positional filter, which
the first common word of a true pair always passes). Those pairs are verified on their whole sets. Documents without any
indexed word make no blocks. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns

#: Phrases, as words, and their base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses, and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("boost-1.0", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-terms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "released under the mit license"),
    ("mit-terms", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
THRESHOLD, STRIDES = 0.9, (16, 64)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one other character whose lower case is an ASCII letter, and a letter to stand for it.
_KELVIN, _KRA = "\u212a", "\u0138"


def words(text: Column) -> Column:
    """Words of a text in lower case; a null text has none. Other letters than A-Z become lower case too, which changes
    neither what is a word nor which words are ASCII; it is several times faster than ``translate``."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit(_KRA))), _GAP), "")


def least_common(size: int, threshold: float) -> int:
    return max(1, math.ceil(size * threshold - 1e-9))


def _array(strings: list[str]) -> Column:
    return F.array(*map(F.lit, strings)) if strings else F.array().cast("array<string>")


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """(key, row_hash, label, template, start, stop, containment) of every block that meets a template: the number of the
    template, and the block's words from ``start`` to before ``stop``. ``row_hash`` is of key and text; equal rows share their blocks.

    Null and empty texts have no blocks; a template without words is never met; repeated rows are reported once.
    """
    spark = docs.sparkSession
    rows = columns(docs, key, *([text] if text != key else [])).select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row_hash"), words(F.col(text)).alias("words"))
    sets = [(i, label, list(dict.fromkeys(t.lower().split()))) for i, (label, t) in enumerate(templates)]
    sets = [(i, label, t, next((s for s in strides if len(templates[i][1].split()) <= s), strides[-1])) for i, label, t in sets if t]
    vocabulary = sorted({w for _, _, t, _ in sets for w in t})
    held = rows.select(F.explode(F.array_intersect(_array(vocabulary), F.col("words"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = {r.word: r.n for r in held.collect()}  # a row a word of the templates
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    index = []
    for i, label, t, stride in sets:
        t = sorted(t, key=at.__getitem__)
        a = least_common(len(t), threshold)
        index += [(stride, w, p, len(t), a, i, label, t) for p, w in enumerate(t[: len(t) - a + 1])]
    book = spark.createDataFrame(index, "stride int, word string, p int, size int, least int, template int, label string, tokens array<string>")
    first = sorted({x[1] for x in index})
    rows = rows.filter(F.arrays_overlap("words", _array(first)))
    held = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: p.word.isin(vocabulary))
    held = rows.select("key", "row_hash", F.size("words").alias("n"), F.explode(held).alias("p")).select("key", "row_hash", "n", "p.at", "p.word")
    windows = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(s).alias("stride"), ((F.floor(F.col("at") / s) - back) * s).alias("start")) for back in (0, 1))) for s in strides)))).alias("w")
    blocks = held.select("key", "row_hash", "n", "word", windows).select("key", "row_hash", "n", "word", "w.stride", "w.start").filter("start = 0 or start > 0 and start + stride < n")
    blocks = blocks.groupBy("key", "row_hash", "stride", "start").agg(F.array_intersect(_array(order), F.collect_set("word")).alias("met"))  # at most all words of the templates
    probes = blocks.select("*", F.posexplode("met").alias("q", "word"))
    left = F.least(F.col("size") - F.col("p"), F.size("met") - F.col("q"))
    pairs = probes.join(book, ["stride", "word"]).filter((F.size("met") >= F.col("least")) & (left >= F.col("least")))
    common = F.size(F.array_intersect("tokens", "met"))
    pairs = pairs.filter(common >= F.col("least")).select("key", "row_hash", "label", "template", "start", (F.col("start") + F.col("stride") * 2).alias("stop"), (common / F.col("size")).alias("containment")).distinct()
    return pairs.withColumnRenamed("key", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row, repeated rows each.

    ``score`` is 1 where a base phrase stands, else the largest containment of a matched block, else 0.
    """
    base = columns(docs, key, *([text] if text != key else [])).select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row_hash"), words(F.col(text)).alias("words"))

    def place(ws: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            test = F.lit(True)
            for j, w in enumerate(phrase.split()):
                test = test & (F.get(ws, i + j) == w)
            out = F.when(test, label).otherwise(out)
        return out

    ws = F.col("words")
    last = sorted({p.split()[-1] for p, _ in PHRASES})
    found = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), place(ws, i).alias("label"))), lambda p: p.label.isNotNull())
    base = base.select("key", "row_hash", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", _array(last)), found).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("places"))
    met = matches(docs, key, text, **how).groupBy(F.col(key).alias("_key"), F.col("row_hash").alias("_hash")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base.join(met, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row_hash") == F.col("_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    at = F.transform("places", lambda p: p.at)
    return out.select(
        F.col("key").alias(key), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    sets = [(label, list(dict.fromkeys(t.split())), next(s for s in STRIDES if len(t.split()) <= s)) for label, t in TEMPLATES]
    rows = ", ".join(f"('{label}', {t}, {least_common(len(t), THRESHOLD)}, {stride})" for label, t, stride in sets)
    places = " UNION ALL ".join("SELECT doc_id, pos, '{}' AS label FROM places WHERE {}".format(label, " AND ".join(f"words[pos + {j + 1}] = '{w}'" for j, w in enumerate(p.split()))) for p, label in PHRASES)
    return rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM docs),
found AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, list(DISTINCT label) AS labels FROM found GROUP BY doc_id),
templates(label, tokens, least, stride) AS (VALUES {rows}),
strides AS (SELECT DISTINCT stride FROM templates),
windows AS (SELECT doc_id, stride, words, unnest(range(0, greatest(1, len(words) - stride), stride)) AS pos FROM docs, strides),
blocks AS (SELECT doc_id, stride, list_distinct(words[pos + 1 : pos + 2 * stride]) AS words FROM windows),
met AS (SELECT doc_id, label, len(list_intersect(tokens, words)) AS common, len(tokens) AS size, least FROM blocks JOIN templates USING (stride)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(common / size) AS best FROM met WHERE common >= least GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


SQL = _sql()
