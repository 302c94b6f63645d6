"""License scans by diagonal voting.

All rolling k-gram hashes of a document's words are exploded straight into a hash join with the positions of the
same k-grams in fixed templates. Each hit votes for a diagonal, its position in the document less that in the
template. Votes are summed by (document, template, diagonal); neighbouring diagonals, which insertions and
deletions make, are merged; a merged span counts if its votes cover enough of the template's k-grams and it is not
much longer than the template. Short exact phrases are templates too: they count where one diagonal has all votes.
Templates are rows of a table, at any number and length: whole licenses as well as the fixed notices of this module.

A row without any hit still passes the join once, by a mark that stands behind its last k-gram and carries its
number of words, so that one pass over the documents gives a row for each of them.

Defined results: null and empty texts have no words and no hits; rows are kept apart by a row number, so repeated
rows repeat their result; long texts are scanned whole; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 3
#: Diagonals at most this far apart are one span.
BAND = 4
#: Share of a template's k-grams that a span must have.
COVER = 0.5
#: A span's length in template lengths, at most.
STRETCH = 1.5
#: Words of lower-cased texts: runs of ASCII letters and digits and of all other characters beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand one after the other, and what they are labelled.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Sentences and paragraphs of public license texts, and what they are labelled.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction": "mit",
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so": "mit",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "apache-2",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License": "epl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose": "unlicense",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "This work is licensed under a Creative Commons Attribution International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution NonCommercial International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution ShareAlike International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution NoDerivatives International License": "cc-by-nd",
    "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means": "all-rights-reserved",
}


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. The two other characters whose lower case has an ASCII letter are kept from it."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")), F.lit("İ"), F.lit("�"))
    return F.regexp_extract_all(F.lower(kept), F.lit(LICENSE_WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """The k-grams' hashes, in order."""
    fits = F.greatest(F.lit(0), F.size(words) - (K - 1))
    return F.transform(F.slice(words, 1, fits), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]))


def default_templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(text, label, exact) of the fixed phrases and notices."""
    return spark.createDataFrame([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in notices.items())], "text string, label string, exact boolean")


def templates(known: DataFrame) -> DataFrame:
    """(template, label, exact, n_grams, gram, tpos, h): the k-grams of known(text, label, exact), such as a table of whole licenses.

    Texts of fewer than K words, and rows without a label, are none; a null `exact` is false; equal rows are one template.
    """
    whole = known.select("text", "label", F.coalesce("exact", F.lit(False)).alias("exact")).where("label is not null").distinct()
    words = whole.select(F.xxhash64("text", "label", "exact").alias("template"), "label", "exact", license_words(F.col("text")).alias("_w"))
    each = words.select("template", "label", "exact", "_w", (F.size("_w") - (K - 1)).alias("n_grams"), F.posexplode(_grams(F.col("_w"))).alias("tpos", "h"))
    return each.select("template", "label", "exact", "n_grams", F.slice("_w", F.col("tpos") + 1, K).alias("gram"), "tpos", "h")


def _in_blocks(grams: DataFrame) -> list[DataFrame]:
    """grams in parts of about BROADCAST_ROWS / 2 rows, one where all are no more than BROADCAST_ROWS; a table that is read for each part."""
    n = grams.count()
    if n <= common.BROADCAST_ROWS:
        return [grams]
    parts = -(-2 * n // common.BROADCAST_ROWS)
    part = F.pmod(F.xxhash64("template", "tpos"), F.lit(parts))
    dealt = common.table(grams.withColumn("_part", part), "templates")
    return [dealt.where(F.col("_part") == i).drop("_part") for i in range(parts)]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, n_words, template, label, exact, first, last, cover): verified spans, word positions from 0; a row without any has template null.

    known(text, label, exact) are the templates, the fixed ones by default. Their k-grams are counted and broadcast; more than
    BROADCAST_ROWS of them are broadcast in parts, each in a pass over the documents of its own, whose votes are summed
    together. More than one part needs the documents' rows in a stable order, so they are written first.
    """
    spark = docs.sparkSession
    blocks = _in_blocks(templates(default_templates(spark) if known is None else known))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    if len(blocks) > 1:
        words = common.table(words, "licensed")
    words = words.select("row", "doc_id", license_words(F.col("_text")).alias("_w"))
    grams = F.transform(_grams(F.col("_w")), lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(False).alias("mark")))
    mark = F.struct(F.size("_w").alias("pos"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("mark"))
    # grams are made by a step of their own: inside the generator they would keep it, and the join, out of generated code
    each = words.select("row", "doc_id", "_w", F.concat(grams, F.array(mark)).alias("_g")).select("row", "doc_id", "_w", F.inline_outer("_g"))
    hits = None
    for i, block in enumerate(blocks):
        side = block.withColumn("mark", F.lit(False))
        if i == 0:
            nothing = [F.lit(None).cast(t).alias(c) for c, t in side.drop("h", "mark").dtypes]
            side = side.unionByName(spark.range(1).select(*nothing, F.lit(0).cast("long").alias("h"), F.lit(True).alias("mark")))
        met = each.join(F.broadcast(side), ["h", "mark"]).where(F.col("mark") | (F.slice("_w", F.col("pos") + 1, K) == F.col("gram"))).drop("_w", "gram")
        hits = met if hits is None else hits.unionByName(met)
    keys = ["row", "doc_id", "template", "label", "exact", "n_grams"]
    votes = hits.select(*keys, "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).groupBy(*keys, "diagonal")
    votes = votes.agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    breaks = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > BAND), 1).otherwise(0)
    merged = votes.withColumn("_new", breaks).withColumn("_span", F.sum("_new").over(along)).groupBy(*keys, "_span")
    merged = merged.agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    length = F.col("last") - F.col("first") + 1
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    good = F.when(F.col("exact"), F.col("votes") == F.col("n_grams")).otherwise((cover >= COVER) & (length <= STRETCH * F.col("n_grams") + BAND))
    return merged.where(F.col("template").isNull() | good).select("row", "doc_id", F.when(F.col("template").isNull(), F.col("first").cast("long")).alias("n_words"), "template", "label", "exact", "first", "last", cover.alias("cover"))


def labelled(spans: DataFrame) -> DataFrame:
    """The op8 columns: one row for each scanned row."""
    base, found = F.coalesce("exact", F.lit(False)), F.col("template").isNotNull()
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def op8_sql(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> str:
    """DuckDB SQL for the op8 query: the same votes, over the k-grams themselves."""
    known = ", ".join(f"({i}, '{label}', {exact}, '{text.lower()}')" for i, (text, label, exact) in enumerate([*((t, x, "true") for t, x in phrases.items()), *((t, x, "false") for t, x in notices.items())]))
    upper = "".join(map(chr, range(65, 91)))
    words = f"regexp_extract_all({{}}, '{LICENSE_WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words.format(f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')")} AS w FROM documents),
t AS (SELECT template, label, exact, {words.format("txt")} AS w FROM (VALUES {known}) AS v(template, label, exact, txt)),
tk AS (SELECT template, label, exact, len(w) - {K - 1} AS n_grams, p AS tpos, array_to_string(w[p + 1:p + {K}], ' ') AS gram FROM (SELECT *, unnest(range(greatest(0, len(w) - {K - 1}))) AS p FROM t)),
dk AS (SELECT r, p AS pos, array_to_string(w[p + 1:p + {K}], ' ') AS gram FROM (SELECT *, unnest(range(greatest(0, len(w) - {K - 1}))) AS p FROM d)),
v AS (SELECT r, template, label, exact, n_grams, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) AS last FROM dk JOIN tk USING (gram) GROUP BY ALL),
b AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {BAND} THEN 1 ELSE 0 END AS breaks FROM v),
s AS (SELECT *, sum(breaks) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM b),
m AS (SELECT r, template, label, exact, n_grams, span, sum(votes) AS votes, min(first) AS first, max(last) AS last, least(1.0::DOUBLE, sum(votes) / n_grams) AS cover FROM s GROUP BY r, template, label, exact, n_grams, span),
g AS (SELECT * FROM m WHERE CASE WHEN exact THEN votes = n_grams ELSE cover >= {COVER} AND last - first + 1 <= {STRETCH} * n_grams + {BAND} END),
a AS (SELECT r, CAST(count(*) FILTER (exact) AS BIGINT) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN a USING (r)"""
