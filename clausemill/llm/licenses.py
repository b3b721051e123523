"""License scan by diagonal voting, with DataFrame operations only.

Every rolling word gram of every document is hashed and joined to the places
where the templates have that gram (the templates are a fixed list, so that side
is small by construction).  Base phrases go by word pairs, all other templates
by four words, which common word pairs do not meet.  A hit at document word ``p`` and template word
``t`` votes for the diagonal ``p - t``.  Votes are counted per document,
template and diagonal; a full vote is an exact phrase.  Neighbouring diagonals,
which an inserted or missing word splits apart, are merged, and a merged span is
verified by the share of the template's words that its grams cover.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base phrases with their labels; statements and passages of published license texts for the method's own labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "gpl",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "lgpl",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "agpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "zlib",
    ),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)
#: Words of a rolling gram: of base phrases, and of all other templates.
PHRASE_GRAM, GRAM = 2, 4
#: Diagonals this near each other are one span; share of a template's words that a span must cover.
SLACK, COVER = 2, 0.85

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_places(spark: SparkSession) -> DataFrame:
    """Every gram of every template with its place; a few hundred rows."""
    rows = []
    for i, (text, label, base) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((t, x, False) for t, x in TEMPLATES)]):
        words, k = re.findall(r"[a-z0-9]+", text.lower()), PHRASE_GRAM if base else GRAM
        rows += [(i, label, base, k, len(words), len(words) - k + 1, t, words[t : t + k]) for t in range(len(words) - k + 1)]
    places = spark.createDataFrame(rows, "template int, label string, base boolean, k int, words int, grams int, t int, of array<string>")
    return places.withColumn("key", F.xxhash64("of"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row of ``docs``.

    score is the largest share of a template's words that a span covers, or of the span's own words where it is the
    longer of the two: 1 with a base phrase, 0 without any label.

    Null text counts as empty.  Rows with equal id and text have equal results and each give their row; ids may be
    null.  An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    # Only A-Z may be lowered.  Of all others only the Kelvin sign lowers to an ASCII letter, so it is swapped for a letter that stays.
    lowered = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("ĸ")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col, F.length(text_col)).alias("same"), F.array_remove(F.split(lowered, _NOT_WORD, -1), "").alias("words"))
    rows = rows.select("doc_id", "same", F.size("words").cast("bigint").alias("n_words"), F.concat(F.array(F.lit("")), "words").alias("words"))
    # Place 0 is an empty word before the first one: no template has it, so each document keeps one row without a template.
    ends = [F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in range(1, GRAM)]
    rolling = rows.select("doc_id", "same", "n_words", F.posexplode(F.arrays_zip(F.col("words").alias("w0"), *ends)).alias("p", "w"))
    grams = [F.array(*[F.col(f"w.w{i}") for i in range(k)]) for k in (PHRASE_GRAM, GRAM)]
    rolling = rolling.select("doc_id", "same", "n_words", "p", F.explode(F.array(*grams)).alias("gram"))
    places = F.broadcast(_template_places(docs.sparkSession))
    hits = rolling.withColumn("key", F.xxhash64("gram")).join(places, "key", "left")
    first = (F.col("p") == 0) & (F.size("gram") == PHRASE_GRAM)
    hits = hits.where(first | (F.col("gram") == F.col("of"))).select("doc_id", "same", "n_words", "p", "template", "label", "base", "k", "words", "grams", "t")

    document, kind = ["doc_id", "same", "n_words"], ["template", "label", "base", "k", "words", "grams"]
    votes = hits.groupBy(*document, *kind, (F.col("p") - 1 - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("voters"), F.count("*").alias("copies"))
    by_template = Window.partitionBy(*document, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > SLACK, F.lit(True)).cast("int")
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by_template))
    exact = F.size("voters") == F.col("grams")
    spans = spans.groupBy(*document, *kind, "span").agg(
        F.count_if(exact).alias("places"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("voters"))).alias("voters"),
        (F.max(F.col("diagonal") + F.array_max("voters") + F.col("k")) - F.min(F.col("diagonal") + F.array_min("voters"))).alias("extent"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
    )
    covered = F.flatten(F.transform("voters", lambda t: F.sequence(t, t + F.col("k") - 1)))
    spans = spans.withColumn("cover", F.size(F.array_distinct(covered)) / F.greatest("words", "extent"))
    base, named = F.col("base") & (F.col("places") > 0), F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("cover") >= COVER)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = spans.groupBy(*document).agg(
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(named, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(named, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max("copies").cast("int").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
