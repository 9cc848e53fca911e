"""License scans: exact phrases, and an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, let, literal_table

#: Phrases, as words, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that name a license, one block each, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under Creative Commons Attribution 4.0 International"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is licensed under the GNU General Public License, version 2"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Whole paragraphs of notices, which wrap over lines, and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]

#: What parts words: ASCII but letters and digits.
PARTING = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaced(text: Column) -> Column:
    """The words of a text, each with one space before it and one at the end; a space without words."""
    words = F.trim(F.regexp_replace(text, PARTING, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.translate(F.regexp_replace(text, PARTING, " "), *LOWER), " ")), "")


def _words(text: str) -> list[str]:
    low = text.translate(str.maketrans(*LOWER))
    return list(dict.fromkeys(w for w in re.split(PARTING, low) if w))


def _windows(text: Column, reach: int, probes: list[str]) -> Column:
    """The words around each line break that wraps words, `reach` at most on either side and further breaks among them
    not counted as words, where they hold one of the probes: an array of (block, the line before the break; words, each
    with the line it stands on)."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.array_remove(F.split(F.translate(F.regexp_replace(l, PARTING, " "), *LOWER), " "), ""))
    words = F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w: F.struct(i.alias("line"), w.alias("word")))))

    def around(ws: Column) -> Column:
        held = let(F.transform(ws, lambda w: w["word"].isin(probes)), lambda hits: F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: F.element_at(hits, i)))
        # breaks within reach of a probe: i is the place of the last word before one, from 1
        at = F.array_distinct(F.flatten(F.transform(held, lambda h: F.sequence(F.greatest(h - reach, F.lit(1)), F.least(h + reach - 1, F.size(ws) - 1)))))
        at = F.filter(at, lambda i: F.element_at(ws, i)["line"] != F.element_at(ws, i + 1)["line"])
        return F.transform(at, lambda i: F.struct(F.element_at(ws, i)["line"].alias("block"), F.slice(ws, F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach)) + reach).alias("words")))

    return let(words, lambda ws: F.when(F.size(ws) > 1, around(ws)))


def token_order(documents: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first by the number of texts that hold a token, ties by the token itself. Texts count
    their tokens of the vocabulary before the shuffle, which has a row for each token and task."""
    held = documents.select(F.explode(F.array_intersect(_tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))).alias("token"))
    n = dict(held.groupBy("token").count().collect())  # a row for each token of the templates at most
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


#: Of a block: its place, whether it wraps over lines, its tokens, and the words of one that wraps.
BLOCKS_TYPE = "array<struct<block:int,wraps:boolean,own:array<string>,words:array<struct<line:int,word:string>>>>"


class Index:
    """Groups of templates in the order of token frequencies, and what of it plans need. Windows around breaks reach as far
    as the longest template of a group has words."""

    def __init__(self, documents: DataFrame, groups: list[list[tuple[str, str]]], threshold: float):
        templates = [t for g in groups for t in g]
        longest = [max((len(re.split(PARTING, t.strip())) for _, t in g), default=1) for g in groups]
        reach = [n for n, g in zip(longest, groups, strict=True) for _ in g]
        sets = [(label, _words(t)) for label, t in templates]
        self.vocabulary = sorted({w for _, ws in sets for w in ws})
        self.rank = {w: i for i, w in enumerate(token_order(documents, self.vocabulary))} if sets else {}
        self.prefixes, self.full = [], []
        for t, (label, ws) in enumerate(sets):
            ws = sorted(ws, key=self.rank.__getitem__)
            least = max(1, math.ceil(threshold * len(ws) - 1e-9))
            self.full.append({"template": t, "label": label, "tokens": ws, "least": least, "reach": reach[t]})
            self.prefixes += [{"token": w, "template": t, "place": i, "n": len(ws), "least": least} for i, w in enumerate(ws[: len(ws) - least + 1])]
        self.probes = sorted({x["token"] for x in self.prefixes})
        self.reach = max(longest, default=1)

    def blocks(self, text: Column) -> Column:
        """The blocks of a text that hold a probe, without leaving the row."""
        held = "(?i)(?<![0-9a-z\\x{80}-\\x{10FFFF}])(" + "|".join(map(re.escape, self.probes)) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])"
        lines = F.filter(F.transform(F.split(text, "\n"), lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].rlike(held))
        none = F.lit(None).cast("array<struct<line:int,word:string>>")
        lines = F.transform(lines, lambda x: F.struct(x["i"].alias("block"), F.lit(False).alias("wraps"), _tokens(x["l"]).alias("own"), none.alias("words")))
        windows = F.when(text.contains("\n"), _windows(text, self.reach, self.probes))
        windows = F.transform(windows, lambda w: F.struct(w["block"].alias("block"), F.lit(True).alias("wraps"), F.array_distinct(F.transform(w["words"], lambda x: x["word"])).alias("own"), w["words"].alias("words")))
        empty = F.array().cast(BLOCKS_TYPE)
        if not self.probes:
            return empty
        return F.when(text.rlike(held), F.concat(lines, F.coalesce(windows, empty))).otherwise(empty)

    def match(self, blocks: DataFrame, key: list[str]) -> DataFrame:
        """Key columns, block, label, template and containment of blocks (key, block, wraps, own, words)."""
        spark = blocks.sparkSession
        order = F.from_json(F.lit(_json(self.rank)), "map<string,int>")
        known = F.array_sort(F.transform(F.array_intersect("own", F.array(*map(F.lit, self.vocabulary)) if self.vocabulary else F.array().cast("array<string>")), lambda w: F.struct(F.element_at(order, w).alias("rank"), w.alias("token"))))
        probed = blocks.select("*", F.array_size("own").alias("size"), known.alias("known")).select("*", F.posexplode("known").alias("at", "one"))
        found = probed.join(F.broadcast(literal_table(spark, self.prefixes, "token:string,template:int,place:int,n:int,least:int")), F.col("one.token") == F.col("token"))
        found = found.where((F.col("size") >= F.col("least")) & (F.least(F.col("n") - F.col("place"), F.array_size("known") - F.col("at")) >= F.col("least")))
        first = found.groupBy(*key, "block", "wraps", "template").agg(F.first("own").alias("own"), F.first("words").alias("words"))
        counted = first.join(F.broadcast(literal_table(spark, self.full, "template:int,label:string,tokens:array<string>,least:int,reach:int")), "template")
        # of a window, what the template's own reach takes
        counted = counted.withColumn("at", F.size(F.filter("words", lambda w: w["line"] <= F.col("block"))))
        near = F.slice("words", F.greatest(F.col("at") - F.col("reach") + 1, F.lit(1)), F.least("at", "reach") + F.col("reach"))
        counted = counted.withColumn("words", F.when(F.col("wraps"), near)).withColumn("own", F.when(F.col("wraps"), F.array_distinct("words.word")).otherwise(F.col("own")))
        shared = F.array_size(F.array_intersect("own", "tokens"))
        alone = F.transform(F.array_distinct("words.line"), lambda i: F.array_size(F.array_intersect(F.transform(F.filter("words", lambda w: w["line"] == i), lambda w: w["word"]), F.col("tokens"))))
        whole = (shared >= F.col("least")) & (~F.col("wraps") | (shared > F.array_max(alone)))
        return counted.where(whole).select(*key, "block", "label", "template", (shared / F.array_size("tokens")).alias("containment"))


def containment_join(documents: DataFrame, key: list[str], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """Every block of a text with at least threshold of a template's tokens (as sets): key columns, block (place of the
    line from 0), label, template (number), containment.

    Blocks are lines, and for notices that wrap the words around each line break, as many on either side as the longest
    template has (block: the line before the break). A block around a break counts for a template only if it holds more
    of its tokens than the part of any one line in it does: what stands on one line is that line's alone.

    Tokens are ordered by their frequency in the documents, rarest first. To hold `least` of a template's n tokens, a
    block must hold one of its n - least + 1 rarest (prefix), have at least `least` tokens itself (length), and behind
    the first shared token both must have enough tokens left (position). Candidates are then counted in full.

    Null and empty texts have no blocks; rows with equal keys and texts count as one. Templates, not texts, set the size
    of the index, which is broadcast. Without templates, or documents, there are no rows."""
    index = Index(documents, [templates], threshold)
    blocks = documents.where(F.col("text").isNotNull()).select(*key, F.explode(index.blocks(F.col("text"))).alias("b")).select(*key, "b.*")
    return index.match(blocks, key)


def _json(x) -> str:
    import json

    return json.dumps(x)


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> list[Column]:
    """n_words, n_base, first_word, last_word and base (array of labels) of a text, by places where a phrase's words
    stand consecutively. Null and empty texts: no words, no places."""
    spaced = _spaced(F.coalesce(text, F.lit("")))
    n_words = _spaces(spaced) - 1
    any_of = spaced.rlike("(?i) (" + "|".join(phrases) + ") ")
    split = {p: F.split(spaced, f"(?i) {p}(?= )", -1) for p in phrases}
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    times = {p: (F.array_size(x) - 1).cast("long") for p, x in split.items()}
    firsts = [F.when(times[p] > 0, _spaces(x[0])) for p, x in split.items()]
    lasts = [F.when(times[p] > 0, n_words - (_spaces(F.element_at(x, -1)) - 1) - len(p.split())) for p, x in split.items()]
    labels = F.array_compact(F.array(*[F.when(times[p] > 0, F.lit(label)) for p, label in phrases.items()]))
    total = zero
    for p in phrases:
        total = total + times[p]
    return [
        n_words,
        F.when(any_of, total).otherwise(zero),
        F.when(any_of, F.least(*firsts) if len(firsts) > 1 else firsts[0]).otherwise(none),
        F.when(any_of, F.greatest(*lasts) if len(lasts) > 1 else lasts[0]).otherwise(none),
        F.when(any_of, labels).otherwise(F.array().cast("array<string>")),
    ]


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of documents. templates: by
    default TEMPLATES and NOTICES.

    labels: those of the phrases and of every template that a block of the text holds; score: 1 with a phrase, else the
    largest containment found, else 0 (of equals any, for it is one number). Texts are read twice: to count the tokens
    of the templates, and for phrases and blocks together. Repeated rows have equal results; null and empty texts have no
    words and score 0; whole texts count, of any length; an empty table gives no rows; other columns take no part."""
    index = Index(documents, [TEMPLATES, NOTICES] if templates is None else [templates], threshold)
    names = ["n_words", "n_base", "first_word", "last_word", "base"]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("of"), "text")
    read = rows.select("doc_id", "of", *[c.alias(n) for n, c in zip(names, phrase_places(F.col("text"), phrases), strict=True)], index.blocks(F.col("text")).alias("blocks"))
    read = Scratch(documents.sparkSession, "licenses").save(read, "read")  # small rows: numbers, and blocks of few
    found = index.match(read.where(F.size("blocks") > 0).select("doc_id", "of", F.explode("blocks").alias("b")).select("doc_id", "of", "b.*"), ["doc_id", "of"])
    by_text = found.groupBy(F.col("doc_id").alias("id"), F.col("of").alias("text_of")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = read.drop("blocks").join(by_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("text_of")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", *names[:4], F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
