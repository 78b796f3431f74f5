"""License scans with DataFrame functions only: a positional index of rare license words.

Words of a text are looked up in a fixed index of license templates, which holds their words of high
inverse document frequency; a template is a candidate where its mandatory key phrase stands in the
text, postings of all index words that agree on the relative position between text and candidate are
intersected, and their weight is held against that of the whole template. The three base phrases are found beside that wherever their words stand consecutively.

Templates are the paragraphs of the licenses' notices, so that words that differ between two paragraphs
(names, years) move no place. All index words of a text are looked up, none is left out, so that each of
several licenses in a file is found. Null texts count as empty: no words, no labels, score 0; texts may be
of any length; repeated rows are scanned each, whatever their id; other columns are ignored. Words of equal
frequency weigh the same, and shares that reach ``share`` all count, so that no tie needs a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License templates, paragraph by paragraph (label, or label#paragraph), with their mandatory key phrases, as lower-case words.
TEMPLATES = {
    "agpl": ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero general public license"),
    "agpl#2": ("you should have received a copy of the gnu affero general public license along with this program", "gnu affero general public license along with this program"),
    "apache": ("licensed under the apache license version 2 0", "apache license"),
    "apache#2": ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    "apache#3": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "governing permissions and limitations under the license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "bsd#2": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    "bsd#3": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    "bsd#4": ("nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    "bsd#5": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors as is"),
    "cc-by": ("this work is licensed under the creative commons attribution cc by 4 0 international license", "cc by"),
    "cc-by#2": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    "cc0": ("cc0 1 0 universal public domain dedication", "public domain dedication"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "gnu general public license"),
    "gpl#2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "under the terms of the gnu general public license"),
    "gpl#3": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    "isc#2": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the author disclaims all warranties with regard to this software"),
    "lgpl": ("you can redistribute it under the terms of the gnu lesser general public license", "lesser general public license"),
    "lgpl#2": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "under the terms of the gnu lesser general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "mit#2": ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute sublicense and or sell copies of the software"),
    "mit#3": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    "mit#4": ("released under the mit license", "mit license"),
    "mit#5": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software", "in no event shall the authors or copyright holders be liable for any claim"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "mpl#2": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file"),
    "reserved": ("copyright all rights reserved", "all rights reserved"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
    "unlicense#2": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
}
# Words of the templates that are no sign of a license and are left out of the index.
STOPS = set("a all an and any are as at be but by can either for from in into is it its may must not of one or other out see shall should that the this to under was will with without you use v 0 1 2 3 4 work code form free person files file met source provided even have if any later kind even option your hope means more list above following used names".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseConfig:
    """``share`` of what a template's index words weigh must agree."""

    share: float = 0.6


def postings() -> list[tuple[str, str, int]]:
    return [(word, name, k) for name, (text, _) in TEMPLATES.items() for k, word in enumerate(text.split()) if word not in STOPS]


def phrase_at(words: Column, i: Column, phrase: str) -> Column:
    first, *rest = phrase.split()
    found = F.get(words, i) == first
    for k, word in enumerate(rest, 1):
        found = found & F.coalesce(F.get(words, i + k) == word, F.lit(False))
    return found


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, n_words, base places, index words with their places, key phrases of each text."""
    index = sorted({w for w, _, _ in postings()})
    bases = [p.split()[0] for p in BASE]
    none = F.lit(None)
    # lower() beyond A-Z keeps every word boundary, and no phrase word holds a letter another sign lowers to
    low = docs.select(doc_id, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    split = low.select(doc_id, F.array_remove(F.split("low", SEPARATORS), "").alias("w"))
    marked = split.select(doc_id, "w", F.size("w").cast("long").alias("n_words"), F.arrays_overlap("w", F.array(*[F.lit(x) for x in sorted({*index, *bases})])).alias("some"))

    def base_place(x, i):
        place = none
        for phrase, label in BASE.items():
            place = F.when(phrase_at(F.col("w"), i, phrase), F.struct(i.cast("long").alias("p"), F.lit(label).alias("label"))).otherwise(place)
        return place

    def when_some(column: Column) -> Column:
        return F.when(F.col("some"), column)

    places = F.filter(F.transform("w", base_place), lambda x: x.isNotNull())
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(index), F.struct(i.cast("int").alias("p"), x.alias("t")))), lambda x: x.isNotNull())
    spaced = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    keys = F.filter(F.array(*[F.when(spaced.contains(f" {key} "), F.lit(name)) for name, (_, key) in TEMPLATES.items()]), lambda x: x.isNotNull())
    return marked.select(F.monotonically_increasing_id().alias("row"), doc_id, "n_words", when_some(places).alias("base"), when_some(hits).alias("hits"), when_some(keys).alias("keys"))


def find_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    spark = docs.sparkSession
    table = written(scanned(docs, doc_id, text))
    n = table.count()
    words = table.filter(F.size("hits") > 0).select("row", "keys", F.explode("hits").alias("h")).select("row", "keys", "h.p", "h.t")
    seen = words.groupBy("t", "row").agg(F.count("*").alias("k")).groupBy("t").agg(F.count("*").alias("df"))
    # as many rows as the index has words
    idf = F.broadcast(seen.select("t", F.log((F.lit(n) + 1.0) / F.col("df")).alias("idf")))
    posted = F.broadcast(spark.createDataFrame(postings(), "t string, template string, q int"))
    # what a template weighs: its index words, a word that no text holds as if one did
    full = posted.join(idf, "t", "left").groupBy("template").agg(F.sum(F.coalesce("idf", F.log(F.lit(n + 1.0)))).alias("full"))
    met = words.filter(F.size("keys") > 0).join(posted, "t").join(idf, "t").filter(F.array_contains("keys", F.col("template")))
    met = met.groupBy("row", "template", (F.col("p") - F.col("q")).alias("at")).agg(F.sum("idf").alias("weight"))
    met = met.join(F.broadcast(full), "template").select("row", "template", (F.col("weight") / F.col("full")).alias("share"))
    label = F.substring_index("template", "#", 1)
    found = met.filter(F.col("share") >= config.share).groupBy("row").agg(F.collect_set(label).alias("own"), F.max("share").alias("share"))
    base = F.coalesce(F.col("base"), F.array().cast("array<struct<p:bigint,label:string>>"))
    own = F.coalesce(F.col("own"), F.array().cast("array<string>"))
    out = table.select("row", doc_id, "n_words", base.alias("base")).join(found, "row", "left")
    return out.select(
        F.col(doc_id).alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.p").alias("first_word"), F.array_max("base.p").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", own))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
    )
