"""License scans: text blocks that contain a license notice, by an exact set-similarity join.

A template is a license notice. A block is a window of a document's words, a
quarter longer than the template it is for; windows overlap and run on across
line ends, so wrapped notices are whole. A window ends at a line end where neither
of the next two words is of the template, so that other text does not complete a
notice. Both are sets of words. A block matches when it holds at least
``CONTAINMENT`` of a template's words; of templates of fewer than ``SHORT`` words
it must hold the last word of the label, too, or all words. All matching blocks
are found:

* words are ordered by the number of lines they are in, the rarest first; only
  words of templates are counted, as others are part of no overlap;
* prefix filter: of an overlap of ``need`` words, one lies among the first
  ``size - need + 1`` of the template and of the block, so blocks and templates
  are joined on those;
* length filter: a block of fewer than ``need`` template words is out, and one
  that lies within another;
* positional filter: the places of the shared word in both orders bound the
  overlap;
* what is left is intersected in full.

The templates are a parameter of fixed size and are broadcast; blocks are never
joined with one another.

Besides, the places of fixed phrases are counted (``PHRASES``). Their labels are
always given; the join adds labels of its own.

Defined results: a null or empty text has no words, no labels and score 0. Rows
are scanned one by one, so repeated rows and ids give repeated results. Columns
other than ``doc_id`` and ``text`` are not carried. Empty tables give empty
tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.llm.common import WORDS_ONLY, as_bytes, slices
from convoca.sources.staging import stage

CONTAINMENT = 0.8
SHORT = 10
# fixed values: phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: notices as licenses ask for them
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS_ONLY).split()


def places(found: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    """Starts of the phrases among the words, and the labels of those that occur."""
    line, starts, labels = b" " + b" ".join(found) + b" ", [], set()
    for phrase, label in phrases.items():
        wanted, at = b" " + phrase.encode() + b" ", -1
        before, counted = 0, 0
        while (at := line.find(wanted, at + 1)) >= 0:
            before += line.count(b" ", counted, at)
            counted = at
            starts.append(before)
            labels.add(label)
    return starts, labels


def _template_words(text: str) -> frozenset[bytes]:
    return frozenset(words(text.encode()))


def frequencies(texts: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many lines each word of the templates occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                for line in (text or b"").translate(_KEEP_LINES).split(b"\n"):
                    held.update(vocabulary.intersection(line.split(b" ")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"]
        )

    rows = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


# like WORDS_ONLY, but lines stay apart
_KEEP_LINES = WORDS_ONLY[:10] + b"\n" + WORDS_ONLY[11:]


def _windows(texts: list[bytes], order: dict, templates: list, needs: dict, widths: list[int]) -> list[list[dict]]:
    """The blocks of each text: windows with enough of a template's words that lie within no other."""
    tokens: list[int] = []
    firsts, lines = [], []
    for text in texts:
        firsts.append(len(tokens))
        for line in text.split(b"\n"):
            if own := line.split():
                lines.append(len(tokens))
                tokens += [order.get(word, -1) for word in own]
    out: list[list[dict]] = [[] for _ in texts]
    token, first, line = np.array(tokens, np.int32), np.array(firsts, np.int64), np.array(lines, np.int64)
    for k, _, own in templates:
        member = np.zeros(len(order) + 1, dtype=bool)
        member[own] = True
        inside = np.r_[member[token], False]
        at = np.nonzero(inside)[0]
        if len(at) < needs[k]:
            continue
        ends = np.sort(np.r_[first, line[~(inside[line] | inside[line + 1])]])
        part = np.searchsorted(ends, at, side="right")
        stop = np.minimum(np.searchsorted(at, at + widths[k]), np.searchsorted(part, part, side="right"))
        enough = (stop - np.arange(len(at)) >= needs[k]) & (stop > np.r_[0, stop[:-1]])
        for a in np.nonzero(enough)[0]:
            held = np.unique(token[at[a] : at[min(stop[a], len(at)) - 1] + 1])
            held = held[member[held]]
            if len(held) >= needs[k]:
                doc = np.searchsorted(first, at[a], side="right") - 1
                out[doc].append({"word": int(at[a] - first[doc]), "template": k, "tokens": held.tolist()})
    return out


def scan(docs: DataFrame, templates=None, phrases=None, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``score`` is 1 where a phrase occurs, else the largest containment found;
    ``blocks`` lists (word, label, containment) of the matching blocks by their first words.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    spark = docs.sparkSession
    sets = [(label, own) for label, text in templates if (own := _template_words(text))]
    sizes = [n for _, text in templates if (n := len(words(text.encode())))]
    vocabulary = frozenset().union(*[own for _, own in sets])
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    counted = frequencies(texts.select("text"), vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    ordered = [(k, label, sorted(order[w] for w in own)) for k, (label, own) in enumerate(sets)]
    needs = {k: math.ceil(containment * len(own) - 1e-9) for k, _, own in ordered}
    least = min(needs.values())
    widths = [n + n // 4 for n in sizes]
    # -1 is in no block: all words are needed
    telling = {
        k: order[last] if (last := words(label.encode())[-1]) in sets[k][1] else -1
        for k, label, own in ordered
        if len(own) < SHORT and words(label.encode())
    }

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            texts = [(text or b"").translate(_KEEP_LINES) for text in as_bytes(batch.column(2))]
            for found, kept in zip(map(bytes.split, texts), _windows(texts, order, ordered, needs, widths), strict=True):
                starts, labels = places(found, phrases)
                values = (
                    len(found), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(labels)), kept,
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [
                pa.string(),
                pa.list_(pa.struct([("word", pa.int64()), ("template", pa.int32()), ("tokens", pa.list_(pa.int32()))])),
            ]
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=_SCANNED)

    scanned = stage(texts.mapInArrow(blocks, _SCANNED_TYPES), "license-blocks")
    prefixes = spark.createDataFrame(
        [
            (token, at, k, label, len(own), needs[k], own, telling.get(k))
            for k, label, own in ordered
            for at, token in enumerate(own[: len(own) - needs[k] + 1])
        ],
        "token int, at int, template int, label string, size int, need int, own array<int>, telling int",
    )
    block = scanned.select("row", F.explode("blocks").alias("b")).select(
        "row", "b.word", "b.template", "b.tokens", F.size("b.tokens").alias("n")
    )
    asked = block.select("*", F.posexplode(F.expr(f"slice(tokens, 1, n - {least - 1})")).alias("place", "token"))
    bound = F.expr("1 + least(place, at) + least(n - place, size - at) - 1")
    candidates = (
        asked.join(F.broadcast(prefixes), ["token", "template"])
        .filter((F.col("n") >= F.col("need")) & (bound >= F.col("need")))
        .dropDuplicates(["row", "word", "template"])
    )
    shared = F.size(F.array_intersect("tokens", "own"))
    told = F.col("telling").isNull() | (F.col("shared") == F.col("size")) | F.array_contains("tokens", F.col("telling"))
    hits = candidates.withColumn("shared", shared).filter("shared >= need").filter(told)
    per_row = hits.groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("own_labels"),
        F.max(F.col("shared") / F.col("size")).alias("containment"),
        F.array_sort(F.collect_set(F.struct("word", "label", (F.col("shared") / F.col("size")).alias("containment")))).alias(
            "blocks"
        ),
    )
    both = F.array_union(
        F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ",")),
        F.coalesce("own_labels", F.array().cast("array<string>")),
    )
    return (
        scanned.drop("blocks")
        .join(per_row, "row", "left")
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
            F.array_join(F.array_sort(both), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
            "blocks",
        )
    )


_SCANNED = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
_SCANNED_TYPES = (
    "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, blocks array<struct<word:bigint,template:int,tokens:array<int>>>"
)
