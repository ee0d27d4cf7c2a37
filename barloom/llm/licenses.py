"""License scan by diagonal voting, in DataFrame operations only.

All rolling k-grams of words of a document are joined to their places in the templates. A hit votes for
the diagonal place in the document - place in the template. Neighbouring diagonals are merged into bands, so
that a few words put in or left out do not split a match. A band is verified on its hits: a span hardly
longer than the template has to cover enough of it, in its order. Licenses that quote each other's words
match in one place; there the best covered one counts. Phrases are templates that must match whole, on one diagonal.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import texts

K = 3
# Diagonals up to this far apart are one match.
NEAR = 4
# Share of a template's k-grams that a verified span covers.
COVER = 0.7
# A verified span is at most this much longer than its template, and one word more.
STRETCH = 1.25
# Places are counted in this many parts of the longest span, as the frames of a window are equally wide for all templates.
SCALE = 1 << 20
# Share of the hits of a verified span that may stand before a hit of an earlier place of the template.
BACK = 0.1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Usual notices and short texts of common licenses, and their labels.
TEMPLATES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl-3",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation": "lgpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met": "bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution.": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.": "isc",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense",
}


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _gram(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(K)))


def template_grams(spark, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """gram, w1 ... wK, template, base, label, grams, inside: each k-gram of each template. As large as the given texts."""
    rows = [(t, i < len(PHRASES), label) for i, (t, label) in enumerate(chain(PHRASES.items(), templates.items()))]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, text string, base boolean, label string")
    cut = given.withColumn("w", words(F.col("text"))).withColumn("grams", F.size("w") - (K - 1)).where("grams > 0")
    each = cut.select("template", "base", "label", "grams", "w", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("inside"))
    return each.select(
        _gram(F.col("w"), F.col("inside")).alias("gram"), *(F.get("w", F.col("inside") + k).alias(f"w{k}") for k in range(K)),
        "template", "base", "label", "grams", "inside")


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Rows of key, n_words and a hit (template ... inside, at: its place in words), or of nulls: each document has one such row.

    All words of a document are dealt out one by one and looked up in the templates, which are sent to
    every task. Equal hashes of other words are told apart by the words.
    """
    rows = texts(docs, id_col, text_col)
    cut = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    each = cut.select("doc_id", "text_hash", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
    keyed = each.withColumn("gram", F.when(F.col("at") <= F.col("n_words") - K, _gram(F.col("w"), F.col("at"))))
    templates = F.broadcast(template_grams(docs.sparkSession, templates).withColumnRenamed("gram", "t_gram"))
    same = (F.col("gram") == F.col("t_gram"))
    found = keyed.join(templates, same, "left").where("template IS NOT NULL OR at = 0 OR at IS NULL")
    right = F.lit(True)
    for k in range(K):
        right = right & (F.get("w", F.col("at") + k) == F.col(f"w{k}"))
    seen = F.when(F.col("template").isNotNull() & right, F.struct("template", "base", "label", "grams", "inside", "at"))
    return found.select("doc_id", "text_hash", "n_words", seen.alias("hit"))


def longest(grams: Column) -> Column:
    """How far the first words of the first and the last k-gram of a verified span may lie apart."""
    return F.floor((grams + (K - 1)) * STRETCH) + 1 - K


def verified(diagonal: DataFrame, key: list[str]) -> DataFrame:
    """One row per band of neighbouring diagonals of a document and template: cover, first, last; for phrases, one per diagonal.

    cover: the largest share of the template's k-grams among the hits of the band inside one span that is short
    enough and whose hits stand in order; null if no span is in order. first, last: the words of that span, of equal
    covers the shortest and then the first. Rows without a template stay.
    """
    by = Window.partitionBy(*key, "template").orderBy("diagonal")
    # A step of more than NEAR begins a new band; phrases stay on one diagonal.
    new = F.when(F.col("base") | F.col("template").isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR), 1).otherwise(0)
    band = [*key, "n_words", "template", "base", "label", "grams", "part"]
    each = diagonal.withColumn("part", F.sum(new).over(by)).withColumn("whole", F.col("base") & (F.size("inside") == F.col("grams")))
    each = each.withColumn("place", F.explode_outer(F.when(~F.col("base"), F.col("inside"))))
    each = each.withColumn("at", F.col("diagonal") + F.col("place")).withColumn(
        "scaled", F.floor(F.col("at").cast("long") * SCALE / longest(F.col("grams"))))
    inside = Window.partitionBy(*key, "template", "part")
    back = F.col("place") < F.lag("place").over(inside.orderBy("at", "place"))
    span = inside.orderBy("scaled").rangeBetween(-SCALE, Window.currentRow)
    seen = each.withColumn("back", F.coalesce(back, F.lit(False))).withColumns({
        "cover": F.size(F.collect_set("place").over(span)) / F.col("grams"), "start": F.min("at").over(span),
        "orderly": F.count_if("back").over(span) <= F.count("place").over(span) * BACK})
    best = F.when(F.col("orderly"), F.struct("cover", (F.col("start") - F.col("at")).alias("near"), (-F.col("start")).alias("early"), "at", "start"))
    whole = F.struct(F.lit(1.0).alias("cover"), F.lit(0).alias("near"), (-F.col("diagonal")).alias("early"),
                     (F.col("diagonal") + F.col("grams") - 1).alias("at"), F.col("diagonal").alias("start"))
    return seen.groupBy(*band).agg(F.max(F.when(F.col("base"), F.when(F.col("whole"), whole)).otherwise(best)).alias("m")).select(
        *band, "m.cover", F.col("m.start").alias("first"), (F.col("m.at") + K - 1).alias("last"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each document.

    base_*: all places of the phrases. labels: those and the labels of the templates (text: label) that match; both empty
    text if there are none. score: the best covered share of a template. spans: label:first word:last word of the matches by
    templates, joined by commas, one per band of diagonals. Of matches with different labels that overlap the best covered
    stays, of equal covers that of the longer template; equal ones stay all. A template of fewer than K words matches nothing. A null or empty text has no words. Repeated rows,
    those with the same id and text, give one row; a null doc_id stays null.

    What is shuffled are hits, not words: one row per document, and those of its license texts.
    """
    key = ["doc_id", "text_hash"]
    diagonal = hits(docs, id_col, text_col, templates).groupBy(
        *key, "n_words", "hit.template", "hit.base", "hit.label", "hit.grams", (F.col("hit.at") - F.col("hit.inside")).alias("diagonal")).agg(
        F.collect_set("hit.inside").alias("inside"))  # at most the places of a template
    phrase = F.col("base") & F.col("cover").isNotNull()
    match = ~F.col("base") & (F.col("cover") >= COVER)
    # No verified span is longer than this, so that a match has few neighbours.
    reach = int(max((len(t) for t in templates), default=0) * STRETCH) + 1
    near = Window.partitionBy(*key).orderBy("first").rangeBetween(-reach, reach)
    others = F.collect_list(F.when(match, F.struct("first", "last", "label", "cover", "grams"))).over(near)

    def better(o):
        covered = (o.cover > F.col("cover")) | ((o.cover == F.col("cover")) & (o.grams > F.col("grams")))
        return (o.label != F.col("label")) & (o.first <= F.col("last")) & (o["last"] >= F.col("first")) & covered

    found = verified(diagonal, key).withColumn("others", others)
    found = found.withColumn("kept", F.coalesce(match & ~F.exists("others", better), F.lit(False)))
    named = found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(phrase, F.col("label"))).alias("b"),
        F.collect_set(F.when(phrase | F.col("kept"), F.col("label"))).alias("l"),
        F.coalesce(F.max(F.when(phrase | F.col("kept"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("first", "last", "label")))).alias("s"))
    return named.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("b"), ",").alias("base_labels"),
        F.array_join(F.sort_array("l"), ",").alias("labels"), "score",
        F.array_join(F.transform("s", lambda s: F.concat_ws(":", s.label, s.first.cast("string"), s["last"].cast("string"))), ",").alias("spans"))
