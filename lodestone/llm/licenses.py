"""Licence scans with a positional rare-token index.  DataFrame functions only."""

from __future__ import annotations

import json
import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored, text_or_empty

#: What words are made of, in a text whose A-Z may still be capitals.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice (a header, or a paragraph of the licence's text), mandatory key phrase
#: within it.  Several notices may share a label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "under the terms of the gnu general public license"),
    ("mit-notice", "Released under the MIT License", "released under the mit license"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit-text", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "sublicense and or sell copies of the software"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "all copies or substantial portions of the software"),
    ("as-is", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "contributors may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "unless required by applicable law or agreed to in writing"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl-notice", "You should have received a copy of the GNU General Public License along with this program", "received a copy of the gnu general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "subject to the terms of the mozilla public license"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "available under the terms of the eclipse public license"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "boost software license version 1 0"),
)
#: How many of a template's highest-IDF words are used, and the share that must agree.
TEMPLATE_WORDS, AGREE = 6, 0.6


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


#: Each phrase's longest word: a text without any of them holds no phrase.
_ANCHORS = sorted({max(p.split(), key=len) for p in [*BASE_PHRASES, *(t[2] for t in TEMPLATES)]})
#: The templates' words (all phrases consist of them).
_VOCABULARY = sorted({w for t in TEMPLATES for w in words_of(t[1])} | {w for p in BASE_PHRASES for w in p.split()})


def templates() -> list[tuple[int, str, str, str, int]]:
    """(number, label, notice, key phrase, word at which the phrase starts in the notice)."""
    out = []
    for t, (label, notice, key) in enumerate(TEMPLATES):
        words, parts = words_of(notice), words_of(key)
        out.append((t, label, notice, key, next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)))
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD), 0)


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, has, hits), stored: the only pass over the texts.

    ``has`` are the distinct licence words of a document; where an anchor is among them, ``hits``
    are all places of licence words, in order.  Other words never leave the array of words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _words(text_or_empty(text_col)).alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _array(_VOCABULARY)).alias("has"), "words")
    places = F.filter(F.transform("words", lambda w, i: F.named_struct(F.lit("at"), i, F.lit("word"), w)), lambda s: s["word"].isin(_VOCABULARY))
    return stored(rows.select("row", "doc_id", "n_words", "has", F.when(F.arrays_overlap("has", _array(_ANCHORS)), places).alias("hits")), "license-words")


def document_frequencies(words: DataFrame) -> tuple[int, dict[str, int]]:
    """How many documents there are and, for each licence word, how many hold it.

    Counted over all documents; the result has at most the templates' words.
    """
    found = words.select(F.explode(F.concat("has", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in found}
    return counts.pop("", 0), counts


def rare_index(n_docs: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[str, int, int, float]]]:
    """IDF of the templates' words, and postings (word, template, position, weight) of rare ones."""
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in _VOCABULARY}
    postings = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = words_of(text)
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:TEMPLATE_WORDS]
        total = sum(idf[words[i]] for i in rare)
        postings += [(words[i], t, i, idf[words[i]] / total) for i in sorted(rare)]
    return idf, postings


def _index(postings: list[tuple[str, int, int, float]]) -> Column:
    """The postings as one constant map: word -> (template, place, weight, whether of the key phrase)."""
    weight = {(w, t, place): x for w, t, place, x in postings}
    key = {(w, t, at + k) for t, _, _, phrase, at in templates() for k, w in enumerate(words_of(phrase))}
    by_word: dict[str, list] = {}
    for w, t, place in sorted(weight.keys() | key):
        by_word.setdefault(w, []).append({"template": t, "place": place, "weight": weight.get((w, t, place), 0.0), "key": int((w, t, place) in key)})
    return F.from_json(F.lit(json.dumps(by_word)), "map<string,array<struct<template:int,place:int,weight:double,key:int>>>")


def _starts(phrase: str) -> Column:
    """Where a phrase begins: its words are neighbours among the hits, one word apart."""
    parts = phrase.split()

    def here(hit: Column, j: Column) -> Column:
        same = hit["word"] == F.lit(parts[0])
        for k, w in enumerate(parts[1:], 1):
            next_one = F.get(F.col("hits"), j + k)
            same = same & F.coalesce((next_one["word"] == F.lit(w)) & (next_one["at"] == hit["at"] + k), F.lit(False))
        return same

    return F.transform(F.filter("hits", here), lambda h: h["at"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_words, base places (starts by phrase), labels and scores.

    One pass splits every text into words and keeps the places of licence words; document
    frequencies, base phrases and templates are all worked out from those.  Words that have
    postings (each template's highest-IDF words, and its key phrase's) are looked up; postings
    that agree on the relative position add their weights; the best position of each template
    must reach ``AGREE`` and hold the whole key phrase there.  Rows are keyed by document all
    along and the index is a constant, so nothing is skewed or broadcast that grows.

    Null texts count as empty; repeated rows are rows; null ids are kept; other columns are
    ignored; an empty table gives no rows.  Equal scores of one template take the first place.
    """
    words = _occurrences(docs, id_col, text_col)
    _, postings = rare_index(*document_frequencies(words))
    held = words.where("hits is not null")
    found = held.select("row", F.explode("hits").alias("h")).select("row", "h.at", F.explode(F.element_at(_index(postings), F.col("h.word"))).alias("p"))
    agreed = found.groupBy("row", "p.template", (F.col("at") - F.col("p.place")).alias("offset")).agg(F.sum("p.weight").alias("share"), F.sum("p.key").alias("keys"))
    label, length = F.lit(None).cast("string"), F.lit(None).cast("int")
    for t, name, _, phrase, _ in templates():
        label = F.when(F.col("template") == t, F.lit(name)).otherwise(label)
        length = F.when(F.col("template") == t, F.lit(len(words_of(phrase)))).otherwise(length)
    good = agreed.where((F.col("share") >= AGREE) & (F.col("keys") == length))
    best = good.groupBy("row", label.alias("label")).agg(F.max(F.struct("share", (-F.col("offset")).alias("o"))).alias("b"))
    per_row = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", F.least(F.col("b.share"), F.lit(1.0)).alias("score"), (-F.col("b.o")).alias("offset")))).alias("aligned"))
    base = F.array(*[F.struct(F.lit(label).alias("label"), _starts(p).alias("starts")) for p, label in BASE_PHRASES.items()])
    out = held.select("row", "doc_id", "n_words", base.alias("base")).join(per_row, "row", "left").drop("row")
    kinds = {f.name: f.dataType for f in out.schema.fields}
    clear = words.where("hits is null")
    return clear.select("doc_id", "n_words", F.lit(None).cast(kinds["base"]).alias("base"), F.lit(None).cast(kinds["aligned"]).alias("aligned")).unionByName(out)
