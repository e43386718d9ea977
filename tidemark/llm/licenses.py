"""License scan: an exact set-similarity join of text blocks with license notices. SQL functions only.

A block is a window of words, twice as wide as the longest notice of its size class and half overlapping the next, so
every occurrence of a notice lies whole in one block. A notice meets a block when the block holds at least a share
``threshold`` of the notice's different words. Words are ordered by how many rows of the whole corpus hold them, rarest
first, and with ``need`` words to share:

* prefix filter: the first ``len - need + 1`` words of both sides, in that order, have a word in common;
* length filter: a block with fewer than ``need`` words of the notices cannot meet;
* positional filter: at the first common word, the words left on the shorter side must still reach ``need``.

These lose no block; what they leave is counted exactly. Words outside the notices cannot be shared and are left out of
blocks first, which changes no overlap. Notices are a parameter of bounded size: their words and the order of them are
literals of the plan. Texts are never shuffled; only matches and one small row for each document are.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words of a lower-cased text. Cutting there takes a quarter of the time of finding each word.
BETWEEN = WORD.replace("^", "")
#: Share of a notice's different words that a block must hold. Notices of nine words or fewer must be there whole.
THRESHOLD = 0.9
#: Words from one block to the next in the smallest size class; each further class has four times as many.
STRIDE = 16
#: Most notices, as their words are literals of the plan.
MOST = 1_000

#: Phrases whose words stand consecutively, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, family and words of common license notices. Of a family, a block bears the notice it holds most of.
NOTICES = (
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl-2", "gpl", "under the GNU General Public License, version 2"),
    ("gpl-2", "gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "gpl", "under the GNU General Public License, version 3"),
    ("gpl-3", "gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-2.1", "gpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3", "gpl", "under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "gpl", "under the GNU Affero General Public License, version 3"),
    ("mpl-2", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2", "epl", "made available under the terms of the Eclipse Public License 2.0"),
    ("boost-1", "boost", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1", "cc", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by", "cc", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "cc", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "cc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc", "Licensed under CC BY-SA 4.0"),
)


class Notice(NamedTuple):
    label: str
    family: str
    words: tuple[str, ...]
    stride: int
    need: int


def notices_of(notices, threshold: float) -> list[Notice]:
    """Notices with their different words, size class and least number of words to share; those without words are left out."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    found = []
    for label, family, text in notices:
        words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        stride = STRIDE
        while stride < len(words):
            stride *= 4
        if words:
            own = tuple(dict.fromkeys(words))
            found.append(Notice(label, family, own, stride, math.ceil(threshold * len(own) - 1e-9)))
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} notices")
    return found


def _worded(docs: DataFrame) -> DataFrame:
    """``doc_id, _key, _w``: the words of every text (null: none), as a generated column so that they are cut once."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN), "")
    return docs.select("doc_id", text_key().alias("_key"), F.explode(F.array(words)).alias("_w"))


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def word_order(docs: DataFrame, notices: list[Notice]) -> list[str]:
    """The words of the notices, rarest first: by rows of ``docs`` that hold them, then by word. Bounded by the notices."""
    words = sorted({w for n in notices for w in n.words})
    held = _worded(docs).select(F.explode(F.array_intersect(_literals(words), "_w")).alias("word"))
    count = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def matches(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, _key, label, family, first_word, n_block, shared, containment``: every block and notice that meet.

    ``first_word`` is the first of the ``n_block`` words of the block, ``shared`` the different words of the notice in
    it. Of notices with one label, a block names each that it meets. Null and empty texts have no blocks; a text of any
    length is cut into blocks of bounded width; repeated rows and columns of other names change nothing.
    """
    found = notices_of(notices, threshold)
    spark = docs.sparkSession
    schema = "_stride int, _word string, _i int, _len int, _need int, _words array<string>, label string, family string"
    if not found:
        return _worded(docs).where("false").select("doc_id", "_key", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("family", "string"), ("first_word", "long"), ("n_block", "int"), ("shared", "int"), ("containment", "double"))])
    rank = {w: i for i, w in enumerate(word_order(docs, found))}
    index, classes = [], {}
    for n in found:
        own = sorted(n.words, key=rank.get)
        prefix = own[: len(own) - n.need + 1]
        index += [(n.stride, w, i, len(own), n.need, own, n.label, n.family) for i, w in enumerate(prefix, 1)]
        rare, all_words, least = classes.get(n.stride, (set(), set(), n.need))
        classes[n.stride] = rare | set(prefix), all_words | set(own), min(least, n.need)
    rare = sorted(set().union(*[c[0] for c in classes.values()]))
    at = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w")))))
    docs = _worded(docs).withColumn("_at", at).select("doc_id", "_key", F.explode(F.array(F.struct("_w", "_at"))).alias("_d"))
    blocks = [_blocks(F.col("_d._w"), F.col("_d._at"), stride, sorted(first), sorted(words, key=rank.get), least) for stride, (first, words, least) in sorted(classes.items())]
    rows = docs.select("doc_id", "_key", F.inline(F.flatten(F.array(*blocks))))
    rows = rows.withColumn("_n", F.size("_tokens"))
    least = reduce(lambda c, s: c.when(F.col("_stride") == s, classes[s][2]), classes, F.when(F.lit(False), 0))
    rows = rows.select("*", F.posexplode(F.slice("_tokens", F.lit(1), F.col("_n") - least + 1)).alias("_j0", "_word"))
    # The index holds a few words for each notice: bounded by MOST notices.
    met = rows.join(F.broadcast(spark.createDataFrame(index, schema)), ["_stride", "_word"])
    j = F.col("_j0") + 1
    met = met.where((F.col("_n") >= F.col("_need")) & (j <= F.col("_n") - F.col("_need") + 1))
    met = met.where(F.least(F.col("_len") - F.col("_i"), F.col("_n") - j) + 1 >= F.col("_need"))
    met = met.withColumn("shared", F.size(F.array_intersect("_words", "_tokens"))).where("shared >= _need")
    return met.select("doc_id", "_key", "label", "family", "first_word", "n_block", "shared", (F.col("shared") / F.col("_len")).alias("containment")).distinct()


def _blocks(words: Column, at: Column, stride: int, prefix: list[str], order: list[str], least: int) -> Column:
    """Blocks of one size class that hold a prefix word and at least ``least`` words of its notices, these in global order."""
    near = F.transform(F.filter(at, lambda x: x["w"].isin(prefix)), lambda x: F.floor(x["i"] / F.lit(stride)).cast("int"))
    places = F.filter(F.array_union(near, F.transform(near, lambda b: b - 1)), lambda b: b >= 0)
    block = lambda b: F.slice(words, b * stride + 1, F.lit(2 * stride))
    made = F.transform(
        places,
        lambda b: F.struct(
            F.lit(stride).alias("_stride"),
            (b * stride).cast("long").alias("first_word"),
            F.least(F.lit(2 * stride), F.size(words) - b * stride).alias("n_block"),
            F.array_intersect(_literals(order), block(b)).alias("_tokens"),
        ),
    )
    return F.filter(made, lambda x: F.size(x["_tokens"]) >= least)


def best_labels(met: DataFrame) -> DataFrame:
    """``doc_id, _key, _labels, _score``: of each family the notice that a block holds most of, by share, then by words."""
    top = F.max(F.struct("containment", "shared"))
    best = met.groupBy("doc_id", "_key", "family", "first_word", "n_block").agg(top.alias("_top"), F.collect_set(F.struct("containment", "shared", "label")).alias("_all"))
    labels = F.transform(F.filter("_all", lambda x: (x["containment"] == F.col("_top.containment")) & (x["shared"] == F.col("_top.shared"))), lambda x: x["label"])
    return best.select("doc_id", "_key", F.col("_top.containment").alias("_c"), F.explode(labels).alias("_l")).groupBy("doc_id", "_key").agg(F.collect_set("_l").alias("_labels"), F.max("_c").alias("_score"))


def places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of the places where the words of a phrase stand consecutively."""
    own = phrase.split()
    last = F.size(words) - len(own)
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(own)])
    might = reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in own]) & (last >= 0)
    return F.when(might, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def report(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD, base: dict[str, str] = BASE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row; other columns are dropped.

    ``labels`` holds the base labels and those of :func:`best_labels`; ``score`` is 1 with a base label, else the largest
    containment of a block and a notice that meet, else 0. Null and empty texts have no words and no labels; rows that
    repeat are judged alike, rows of one id by their own text; an empty table gives no rows.
    """
    rows = _worded(docs).select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"), *[places(F.col("_w"), p).alias(f"_p{k}") for k, p in enumerate(base)])
    starts = F.concat(*[F.col(f"_p{k}") for k in range(len(base))]) if base else F.array().cast("array<int>")
    named = F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, label) for k, label in enumerate(base.values())])) if base else F.array().cast("array<string>")
    rows = rows.select("doc_id", "_key", "n_words", starts.alias("_starts"), F.array_sort(F.array_distinct(named)).alias("_base"))
    own = best_labels(matches(docs, notices, threshold)).withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
    out = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
