"""License scans: a trained paragraph classifier, with DataFrame functions alone on the corpus.

Model: multinomial logistic regression over sparse binary word n-grams (one and two words), classes = licence families and "unknown", trained on
the driver from fixed notices and their variants (a few hundred rows, no corpus rows). Probabilities are calibrated by a temperature fitted on
held-out variants. A paragraph (a line of the text, or a block of lines between blank lines) is of a family if that class is likeliest, its calibrated probability
reaches a threshold, and comparison with the family's templates confirms it: it holds enough of the n-grams of one of them, or all n-grams of one of the
family's names. A block counts where none of its lines is confirmed for its family by itself.

Scan: paragraphs without any of the words that a confirmed notice must have (a rule derived from the templates, which loses nothing) go; the rest are cut into distinct n-grams, which meet the weight table by a broadcast equi-join (the table's size is fixed by the templates,
not by the corpus); logits are sums per paragraph, combined before the shuffle.

Edges: null and empty texts have no paragraph with licence; paragraphs without known n-grams are unknown; rows equal in doc_id and text are scanned
once and answered for each; an empty table gives an empty result. Columns of the input are not carried but for doc_id.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortica.llm.common import ascii_lower, pinned

#: Notices of common licences, as they are written above texts and code.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is distributed under the terms of the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "This software is licensed under the MIT license."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Released under the GPL version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "Released under the GPL version 2."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1 or later.", "Released under the LGPL version 3."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 2-Clause License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "Released into the public domain under CC0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without permission of the publisher.", "Copyright by the authors. All rights reserved."],
}
#: Names of the licences and other short notices, which confirm a paragraph that holds all their n-grams.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "mit": ["MIT License"],
    "gpl-3.0": ["GNU General Public License v3", "GNU General Public License v3.0", "GNU General Public License, version 3", "GPL version 3", "GPLv3", "GPL-3.0"],
    "gpl-2.0": ["GNU General Public License v2", "GNU General Public License v2.0", "GNU General Public License, version 2", "GPL version 2", "GPLv2", "GPL-2.0"],
    "lgpl": ["GNU Lesser General Public License", "LGPL version 3", "LGPL version 2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc0": ["CC0 1.0", "CC0-1.0"],
    "proprietary": ["All rights reserved."],
}
#: Sentences that use the same words and grant nothing.
ORDINARY = [
    "The driver showed a valid license to the officer.", "The version of the song released in 2.0 format was free of charge.", "He studied at MIT and worked for the public.", "General conditions of the work are met by the following group.",
    "The library is open to the public from nine to five.", "The foundation published a new version of the study.", "You can redistribute the chairs in the room and modify the order.", "Software is used in the source of the river.", "The Apache helicopter landed at the base.",
    "A creative mind and common sense are all you need.", "This program is shown on television every evening.", "The terms of the contract were not clear to the author.", "The copy was made without permission of the owner.", "Under the bridge the water was cold.",
    "The clause in the sentence is subject to the rules of grammar.", "This work is the result of many years.", "The commons of the village are open to all.", "Any person may attend the meeting free.", "By nine the room was full of people.", "The licensed bar on the corner is open late.",
    "International rules of the game changed in version 3.", "The mozilla is a made up animal.", "The rights of the public were reserved by law.", "Later on, the free software conference began.", "Attribution of the painting is disputed.", "A lesser person would have left the house.",
]
#: Function words, which are never what a paragraph is picked by as long as others will do.
FUNCTION_WORDS = "a all an and any are as at be been by can either file files for form from has have in into is it its may no not of on or part person possible that the this to under use with without you".split()
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
UNKNOWN = "unknown"


def grams_of(text: str) -> set[str]:
    """The n-grams of a training paragraph; grams() is the same on a column."""
    w = re.findall(WORDS, text.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def grams(paragraphs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Paragraphs that have one of the needed words, with one row per distinct n-gram in place of the line."""
    p = pinned(paragraphs, "words", F.regexp_extract_all(ascii_lower(F.col("line")), F.lit(WORDS), F.lit(0))).drop("line")
    p = p.where(F.arrays_overlap("words", F.array(*map(F.lit, needed))))
    after = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), after, lambda a, b: F.concat(a, F.lit(" "), b))
    return p.withColumn("gram", F.explode(F.array_distinct(F.concat("words", pairs)))).drop("words")


def variants(seed: int, each: int) -> list[tuple[str, str]]:
    """Rows (text, class) made from the fixed sentences: whole, cut short, with a few words lost or put around. each is the bound: rows per sentence."""
    rnd, rows = random.Random(seed), []
    around = sorted({w for s in ORDINARY for w in s.split()})
    for family, sentences in [*TEMPLATES.items(), (UNKNOWN, ORDINARY)]:
        for s in sentences:
            for k in range(each):
                w = s.split()
                if k % 3 == 1:
                    w = [x for x in w if rnd.random() > 0.06] or w
                if k % 3 == 2:
                    w = [*rnd.sample(around, rnd.randint(0, 4)), *w, *rnd.sample(around, rnd.randint(0, 4))]
                rows.append((" ".join(w), family))
    # pieces of notices that name no licence are unknown
    rows += [(" ".join(rnd.sample(around, rnd.randint(1, 25))), UNKNOWN) for _ in range(20 * each)]
    return rows


def named(seed: int, each: int) -> list[tuple[str, str]]:
    """Rows (text, class) of the names: alone, and with a few words around."""
    rnd, around = random.Random(seed), sorted({w for s in ORDINARY for w in s.split()})
    some = lambda k: rnd.sample(around, rnd.randint(0, 4) if k % 3 == 2 else 0)
    return [(" ".join([*some(k), s, *some(k)]), f) for f, ss in NAMES.items() for s in ss for k in range(each)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@functools.lru_cache
def train(seed: int = 1, each: int = 9, rounds: int = 400, decay: float = 1e-4) -> dict:
    """Weights by n-gram, classes and temperature."""
    rows, held = variants(seed, each) + named(seed, each), variants(seed + 1, each) + named(seed + 1, each)
    classes = [*TEMPLATES, UNKNOWN]
    vocabulary = sorted({g for t, c in rows for g in grams_of(t) if c != UNKNOWN} | {g for t in ORDINARY for g in grams_of(t)})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(at) + 1))
        x[:, -1] = 1
        for i, (t, _) in enumerate(rows):
            x[i, [at[g] for g in grams_of(t) if g in at]] = 1
        return x, np.eye(len(classes))[[classes.index(c) for _, c in rows]]

    x, y = matrix(rows)
    w, m = np.zeros((x.shape[1], len(classes))), 0.0
    for _ in range(rounds):
        m = 0.9 * m + x.T @ (_softmax(x @ w) - y) / len(x) + decay * w
        w -= 0.5 * m
    hx, hy = matrix(held)
    loss = lambda t: -np.log((_softmax(hx @ w / t) * hy).sum(axis=1) + 1e-12).mean()
    temperature = min((0.5 * 1.1**k for k in range(40)), key=loss)
    return {"classes": classes, "vocabulary": vocabulary, "weights": np.round(w / temperature, 6), "temperature": temperature}


@functools.lru_cache
def key_words(overlap: float) -> tuple[str, ...]:
    """Words of which every paragraph that is similar enough to a template has one.

    For each template, words are chosen until the n-grams they occur in are more than 1 - overlap of the template: a paragraph without any of them
    cannot hold the share asked for. Words of fewer templates and ordinary sentences are chosen first.
    """
    common: dict[str, int] = {}
    sentences = [s for ss in TEMPLATES.values() for s in ss]
    for s in [*sentences, *ORDINARY * 3, *FUNCTION_WORDS * 99]:
        for w in {g for g in grams_of(s) if " " not in g}:
            common[w] = common.get(w, 0) + 1
    chosen: set[str] = set()
    for s in sentences:
        g = grams_of(s)
        touched = lambda: sum(any(w in chosen for w in x.split(" ")) for x in g)
        for w in sorted({x for x in g if " " not in x}, key=lambda w: (common[w], -len(w), w)):
            if touched() > (1 - overlap) * len(g) + 1e-9:
                break
            chosen.add(w)
    # a name is held as a whole, so one of its words will do
    for s in (s for ss in NAMES.values() for s in ss):
        own = sorted({x for x in grams_of(s) if " " not in x}, key=lambda w: (common.get(w, 0), -len(w), w))
        if not chosen & set(own):
            chosen.add(own[0])
    return tuple(sorted(chosen))


def name_bits() -> tuple[dict[str, int], dict[str, list[int]]]:
    """A number for each n-gram of the names, and the names of each family as sets of these bits."""
    at = {g: i for i, g in enumerate(sorted({g for ss in NAMES.values() for s in ss for g in grams_of(s)}))}
    return at, {f: [sum(1 << at[g] for g in grams_of(s)) for s in ss] for f, ss in NAMES.items()}


def weight_table(spark: SparkSession, model: dict) -> DataFrame:
    """gram, w (weight of each class), t (for each template: 1 if the template has the gram), b (the gram's bit among those of the names, 60 to a number). A few thousand rows, fixed by the templates."""
    templates = [grams_of(s) for ss in TEMPLATES.values() for s in ss]
    bits = name_bits()[0]
    bit = lambda g: [1 << bits[g] % 60 if g in bits and bits[g] // 60 == k else 0 for k in range(-(-len(bits) // 60))]
    rows = [(g, [float(v) for v in model["weights"][i]], [int(g in t) for t in templates], bit(g)) for i, g in enumerate(model["vocabulary"])]
    return spark.createDataFrame(rows, "gram string, w array<double>, t array<int>, b array<bigint>")


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, block (number of its first line), place (of a line in its block; -1: all lines of the block), line. Numbers from 0."""
    d = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    blank = lambda x: F.translate(x, " \t\r", "") == ""
    # a block starts with each blank line, and the line end before it is where the text is split
    starts = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when((i == 0) | blank(x), i)), lambda i: i.isNotNull())
    d = d.withColumn("b", F.explode(F.arrays_zip(starts.alias("block"), F.split("text", r"\n(?=[ \t\r]*(?:\n|\z))").alias("lines")))).select("row", "doc_id", "text_key", "b.block", "b.lines")
    d = pinned(d, "each", F.split("lines", "\n"))
    own = F.transform("each", lambda x, i: F.struct(i.alias("place"), x.alias("line")))
    several = F.size(F.filter("each", lambda x: ~blank(x))) > 1
    whole = F.when(several, F.array(F.struct(F.lit(-1).alias("place"), F.col("lines").alias("line")))).otherwise(F.slice(own, 1, 0))
    d = d.select("row", "doc_id", "text_key", "block", F.explode(F.concat(own, whole)).alias("p"))
    return d.select("row", "doc_id", "text_key", "block", "p.place", "p.line").where("line <> ''")


def scan_paragraphs(docs: DataFrame, threshold: float = 0.9, overlap: float = 0.6) -> DataFrame:
    """doc_id, text_key, paragraph (number of its first line, from 0), family, probability, similarity of every paragraph that is confirmed as a licence notice."""
    model = train()
    families, k = list(TEMPLATES), len(model["classes"])
    owner = [f for f in families for _ in TEMPLATES[f]]
    sizes = [len(grams_of(s)) for ss in TEMPLATES.values() for s in ss]
    g = grams(paragraphs(docs), key_words(overlap))
    bits, names_of = name_bits()
    n_bits = -(-len(bits) // 60)
    table = weight_table(docs.sparkSession, model)
    table = table.select("gram", *[F.col("w")[i].alias(f"w{i}") for i in range(k)], *[F.col("t")[j].alias(f"t{j}") for j in range(len(owner))], *[F.col("b")[j].alias(f"b{j}") for j in range(n_bits)])
    met = g.join(F.broadcast(table), "gram").groupBy("row", "doc_id", "text_key", "block", "place")
    s = met.agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(k)], *[F.sum(f"t{j}").alias(f"t{j}") for j in range(len(owner))], *[F.bit_or(f"b{j}").alias(f"b{j}") for j in range(n_bits)])
    bias = model["weights"][-1]
    logits = F.array(*[F.col(f"w{i}") + F.lit(float(bias[i])) for i in range(k)])
    s = s.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    total = F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    s = s.withColumn("class", F.array_position("logits", F.col("top")).cast("int")).withColumn("probability", 1 / total)
    names = F.array(*map(F.lit, model["classes"]))
    part = lambda b, j: b >> 60 * j & (1 << 60) - 1
    holds = lambda b: functools.reduce(lambda x, y: x & y, [F.col(f"b{j}").bitwiseAND(F.lit(part(b, j)).cast("long")) == F.lit(part(b, j)).cast("long") for j in range(n_bits)])
    has_name = lambda f: functools.reduce(lambda x, y: x | y, map(holds, names_of[f])).cast("int").cast("double")
    similarity = lambda f: F.greatest(has_name(f), *[F.col(f"t{j}") / F.lit(sizes[j]) for j in range(len(owner)) if owner[j] == f], F.lit(0.0))
    like = F.coalesce(*[F.when(F.col("family") == f, similarity(f)) for f in families], F.lit(0.0))
    s = s.withColumn("family", F.element_at(names, F.col("class"))).withColumn("similarity", like)
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= threshold) & (F.col("similarity") >= overlap)
    s = s.where(sure).select("doc_id", "text_key", "block", "place", "family", "probability", "similarity").distinct()
    s = s.withColumn("last", F.max("place").over(Window.partitionBy("doc_id", "text_key", "block", "family"))).where("place >= 0 or last < 0")
    return s.select("doc_id", "text_key", (F.col("block") + F.greatest("place", F.lit(0))).alias("paragraph"), "family", "probability", "similarity")


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_paragraphs, n_notices, families (sorted), probability and similarity of the surest notice (null without one)."""
    hits = scan_paragraphs(docs, **options).groupBy(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"))
    hits = hits.agg(F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))).cast("long")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("n_paragraphs"))
    out = own.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "families", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))
