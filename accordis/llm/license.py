"""Licence scans: a trained paragraph classifier over word n-grams, with an unknown class and template confirmation.

Training: TEMPLATES (short public licence notices), windows of their words and NAMES of licences in some languages are the
positive rows, ordinary notices and a bounded sample of the corpus's own lines without a cue (from any place of a text) the
negative ones. A softmax regression over hashed words and word pairs is fitted on the driver; its weights are a table of at
most 2 ** hash_bits rows. Its threshold is set on all lines of the corpus, repeats counted: of them at most `ordinary_share`
are given a family without a cue. `fit_and_scan` sets it and scans in one pass, as only lines that reach least_probability count.

Scanning is plain DataFrame code. A paragraph is a line, and also a run of lines that are wrapped: each but the last ends
without a stop, and none is blank. Every line and every run is judged. Bounds drop those without a cue that no family can win
before anything is exploded: first a paragraph with none of the model's strong words (all other trained words and their pairs
together can't reach the threshold, and words that were never trained weigh something only by a clash of hashes), then one
whose positive weights, all given to one family, can't. Of the others, distinct n-grams are joined to the weights, summed by
paragraph and family, and turned into probabilities. A paragraph whose best family stays below the threshold is unknown. A
family is confirmed if the paragraph holds at least `least_share` of the n-grams of one of its templates; templates are
compared by a second broadcast join.

Result: a row for each line that has a cue word or is given a family, and for each run that is given one: doc_id, unit (line or
run), paragraph (its number among the text's lines, or runs and lines that stand alone, from 0), family ("unknown" too),
probability, template_share and confirmed.

Defined results: null and empty texts have no paragraphs; a null doc_id is kept; rows that repeat doc_id and text give their
paragraphs once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Public licence notices.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."],
}
# Short names, trained alone and in NOTICES.
NAMES = {
    "mit": ["MIT"], "apache": ["Apache-2.0", "Apache 2.0", "Apache License 2.0"], "gpl": ["GPL-3.0", "GPLv3", "GPL", "GNU General Public License"], "lgpl": ["LGPL-2.1", "LGPLv3", "GNU Lesser General Public License"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD 3-Clause"], "mpl": ["MPL-2.0", "Mozilla Public License 2.0"], "cc-by": ["CC BY 4.0", "CC-BY-4.0"], "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0"], "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
}
NOTICES = ["{}", "Published under {}", "Licensing: {}", "Lizenz: {}", "Lizenziert unter {}", "Licencia {}", "Publicado bajo {}", "Licence {}", "Publi\u00e9 sous {}"]
DISCLAIMER = "The software is provided \"as is\", without warranty of any kind, express or implied"  # of the MIT licence
# Sentences with licence words that grant nothing.
ORDINARY = ["A driving license is required to rent a car.", "The council granted the restaurant a liquor license last week.", "He was licensed to practise medicine in the state.", "The software was released under pressure from its users.", "The general public is invited to the opening.", "She wrote about copyright law and the free press.", "No permission was needed to enter the building.", "The terms of the agreement were published in the journal.", "The warranty covers parts for two years.", "Redistribution of wealth was debated in parliament."]
CUES = ("license", "licence", "copyright", "copyleft", "spdx", "all rights reserved", "permission is hereby", "free software", "redistribut", "creative commons", "public domain")
FAMILIES = tuple(TEMPLATES)
#: Stands where a run of lines was wrapped.
WRAP = "\x0b"


@dataclass(frozen=True)
class Settings:
    hash_bits: int = 16
    #: Corpus lines that train, of up to background_chars characters.
    background: int = 1000
    background_chars: int = 4000
    #: Of all lines, the share that may be given a family without a cue, unless they reach most_probability.
    ordinary_share: float = 0.002
    most_probability: float = 0.9
    rounds: int = 300
    rate: float = 2.0
    decay: float = 1e-3
    least_share: float = 0.6
    least_probability: float = 0.5


@dataclass
class Model:
    weights: dict[int, list[float]] = field(default_factory=dict)
    bias: list[float] = field(default_factory=list)
    threshold: float = 0.5
    #: No line without one of these words is given a family; None: any line may be.
    strong: list[str] | None = None

    def least(self) -> float:
        """What a line's weights for a family less those for unknown must come to before the family can win."""
        best = max(b - self.bias[-1] for b in self.bias[:-1])
        return math.log(self.threshold / (1 - self.threshold)) - best - 1e-6


def named_grams(line: Column) -> Column:
    """Words and word pairs of a line."""
    words = F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}\p{N}]+(?:[.\-+][\p{L}\p{N}]+)*)"), F.lit(1))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def hashed(gram: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(1 << bits))


def grams(line: Column, bits: int) -> Column:
    """Distinct hashed words and word pairs of a line."""
    return F.array_distinct(F.transform(named_grams(line), lambda g: hashed(g, bits)))


def whole_words(words: list[str]) -> str:
    """A pattern for any of some words between letters' and digits' ends. It goes on only where a word begins, and words share their
    beginnings, so that most places of a text cost one look."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def rest(node: dict) -> str:
        ways = "|".join(re.escape(c) + rest(child) for c, child in sorted(node.items()) if c)
        return f"(?:{ways})?" if ways and "" in node else f"(?:{ways})" if ways else ""

    # what isn't a letter or digit, told for ASCII first; words are lower-case, and so is what they are sought in
    before = r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]|[^\x00-\x7F\p{L}\p{N}]|^)"
    return before + rest(tree) + r"(?![\p{L}\p{N}])" if words else "(?!)"


def has_cue(lowered: Column) -> Column:
    """Whether a lower-cased line holds a cue."""
    found = F.contains(lowered, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found |= F.contains(lowered, F.lit(cue))
    return found


def lines(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """(doc_id, unit, paragraph, line, cue) of lines that have a cue or may be given a family, and of runs of lines that may be."""
    least = model.least()
    may = lambda p: F.lit(True)
    if model.strong is not None:
        strong = F.lit(whole_words(model.strong))
        may = lambda p: has_cue(p["low"]) | F.regexp_like(p["low"], strong)
    most = [0] * (1 << s.hash_bits)  # of each gram, in hundredths and rounded up
    for g, w in model.weights.items():
        most[g] = max(0, math.ceil(100 * (max(w[:-1]) - w[-1])))
    table = F.split(F.lit(",".join(map(str, most))), ",").cast("array<int>")  # folded to a constant

    def bound(line: Column) -> Column:
        one = F.array(grams(line, s.hash_bits))  # a lambda holds each value once
        return F.get(F.transform(one, lambda gs: F.aggregate(gs, F.lit(0), lambda n, g: n + F.get(table, g.cast("int"))) / F.sqrt(F.greatest(F.size(gs), F.lit(1)).cast("double"))), F.lit(0))

    units = lambda text, unit: F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.lit(unit).alias("unit"), i.alias("paragraph"), line.alias("line"), F.lower(line).alias("low")))
    wrapped = F.filter(units(F.regexp_replace("text", r"(?<![.!?:;\n])\n(?=[^\n])", WRAP), "run"), lambda p: F.contains(p["line"], F.lit(WRAP)) & may(p))
    of_lines = docs.select("doc_id", "text", F.filter(units(F.col("text"), "line"), may).alias("found")).filter(F.size("found") > 0)
    # words and cues don't reach over a wrap, so a run has one only if a line has: other texts aren't joined to runs at all
    found = of_lines.select("doc_id", F.explode(F.concat("found", wrapped)).alias("p"))
    found = found.select("doc_id", "p.unit", "p.paragraph", "p.line", ((F.col("p.unit") == "line") & has_cue(F.col("p.low"))).alias("cue"))
    return found.filter(F.col("cue") | (bound(F.col("line")) >= 100 * least)).distinct()


def examples() -> list[tuple[str, str]]:
    """(family, text): templates, their two halves if long, names of licences, and ordinary sentences as unknown."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            out.append((family, text))
            if len(words) >= 12:
                out += [(family, " ".join(words[: len(words) // 2 + 2])), (family, " ".join(words[len(words) // 2 - 2 :]))]
    out += [(family, notice.format(name)) for family, names in NAMES.items() for name in names for notice in NOTICES] + [("mit", DISCLAIMER)]
    return out + [("unknown", t) for t in ORDINARY]


def strong_words(named: list[tuple[str, dict[str, int]]], model: Model) -> list[str] | None:
    """Words of which a line needs one to be given a family. The others are chosen so that they and their pairs, whichever a
    line holds, stay below what a family needs; words frequent in unknown rows come first."""
    least = model.least()
    if least <= 0:
        return None
    margin = {g: np.maximum(0, np.array(model.weights[h][:-1]) - model.weights[h][-1]) for _, gs in named for g, h in gs.items()}
    margin = {g: m for g, m in margin.items() if m.any()}
    frequent = Counter(g for family, gs in named if family == "unknown" for g in gs)
    words = sorted({w for g in margin for w in g.split(" ")}, key=lambda w: (-frequent[w], margin[w].max() if w in margin else 0.0, w))
    pairs = [(set(g.split(" ")), m) for g, m in margin.items() if " " in g]
    weak: set[str] = set()
    for w in words:
        tried = weak | {w}
        held = np.array([margin[x] for x in tried if x in margin] + [m for p, m in pairs if p <= tried] or [np.zeros(len(FAMILIES))])
        sums = np.cumsum(np.sort(held, axis=0)[::-1], axis=0) / np.sqrt(np.arange(1, len(held) + 1))[:, None]
        if sums.max() < least:
            weak = tried
    return sorted(set(words) - weak)


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """The model, with its threshold from all lines of docs."""
    model, named = train(docs, s)
    model.threshold = threshold(judged(docs, model, s), docs, model, s)
    model.strong = strong_words(named, model)
    return model


def fit_and_scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """scan(docs, fit(docs)), for which the texts are judged once."""
    model, _ = train(docs, s)
    found = materialize(judged(docs, model, s))
    return given(found, threshold(found, docs, model, s), s)


def threshold(found: DataFrame, docs: DataFrame, model: Model, s: Settings) -> float:
    """The lowest threshold, in steps of 0.01 from the model's own, that at most ordinary_share of all lines reach without a cue."""
    n = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long")).alias("n")).first()["n"] or 0
    reach = found.filter((F.col("unit") == "line") & ~F.col("cue") & (F.col("top") != "unknown")).groupBy(F.floor(F.col("p") * 100).alias("step")).count().collect()
    at = math.ceil(100 * model.threshold - 1e-9)
    while at < 100 * s.most_probability - 1e-9 and sum(r["count"] for r in reach if r["step"] >= at) > n * s.ordinary_share:
        at += 1
    return max(model.threshold, min(s.most_probability, at / 100))


def train(docs: DataFrame, s: Settings) -> tuple[Model, list[tuple[str, dict[str, int]]]]:
    """The model with the lowest threshold that it may have, and its training rows. Corpus lines are a bounded sample of a line of each text, at a place that its hash gives: those of the lowest
    hashes among lines without a cue."""
    spark = docs.sparkSession
    parts = F.transform(F.array(F.split("text", "\n")), lambda p: F.get(p, F.pmod(F.xxhash64(F.get(p, F.lit(0))), F.size(p)).cast("int")))
    sample = docs.select(F.get(parts, F.lit(0)).alias("line")).filter(F.length("line").between(1, s.background_chars) & ~has_cue(F.lower("line")))
    sample = sample.distinct().orderBy(F.xxhash64("line"), "line").limit(s.background)
    rows = spark.createDataFrame(examples(), "family string, line string").unionAll(sample.select(F.lit("unknown").alias("family"), "line")).select("family", F.transform(named_grams(F.col("line")), lambda g: F.struct(g.alias("gram"), hashed(g, s.hash_bits).alias("hash"))).alias("g")).collect()
    named = [(r["family"], {g["gram"]: g["hash"] for g in r["g"]}) for r in rows]
    rows = sorted((family, sorted(set(gs.values()))) for family, gs in named)
    classes = [*FAMILIES, "unknown"]
    terms = sorted({g for _, gs in rows for g in gs})
    place = {g: i for i, g in enumerate(terms)}
    x = Rows([[place[g] for g in gs] for _, gs in rows], len(terms))
    y = np.array([classes.index(f) for f, _ in rows])
    per_class = np.bincount(y, minlength=len(classes))
    weight = (1 / np.maximum(1, per_class))[y]
    weight /= weight.sum()
    w, b, wanted = np.zeros((len(terms), len(classes))), np.zeros(len(classes)), np.eye(len(classes))[y]
    for _ in range(s.rounds):
        p = softmax(x.times(w) + b)
        error = (p - wanted) * weight[:, None]
        w -= s.rate * len(classes) * x.transposed_times(error) + s.decay * w
        b -= s.rate * error.sum(axis=0)
    ordinary = softmax(x.times(w) + b)[y == len(classes) - 1]
    least = max([s.least_probability, *(ordinary[:, :-1].max(axis=1) + 0.01)])
    model = Model({g: w[i].tolist() for g, i in place.items()}, b.tolist(), float(min(s.most_probability, least)))
    model.strong = strong_words(named, model)
    return model, named


class Rows:
    """A sparse matrix of equal entries in each row, which has length 1."""

    def __init__(self, columns: list[list[int]], width: int) -> None:
        sizes = np.array([len(c) for c in columns], dtype=np.int64)
        self.n, self.held = len(columns), np.flatnonzero(sizes)
        self.columns = np.array([c for row in columns for c in row], dtype=np.int64)
        self.starts = (np.cumsum(sizes) - sizes)[self.held]
        self.values = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)[:, None]
        self.order = np.argsort(self.columns, kind="stable")
        self.of = np.repeat(np.arange(self.n), sizes)[self.order]
        self.used, self.begins = np.unique(self.columns[self.order], return_index=True)
        self.width = width

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]))
        if len(self.held):
            out[self.held] = np.add.reduceat(w[self.columns] * self.values, self.starts)
        return out

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, e.shape[1]))
        if len(self.used):
            out[self.used] = np.add.reduceat(e[self.of] * self.values[self.order], self.begins)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scan(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The licence paragraphs of docs."""
    return given(judged(docs, model, s), model.threshold, s)


def given(found: DataFrame, threshold: float, s: Settings) -> DataFrame:
    """What judged() found, at a threshold that isn't lower than its model's."""
    reaches = (F.col("p") >= threshold) & (F.col("top") != "unknown")
    out = found.filter(F.col("cue") | reaches).withColumn("template_share", F.when(reaches, F.col("template_share")).otherwise(0.0))
    return out.select("doc_id", "unit", "paragraph", F.when(reaches, F.col("top")).otherwise("unknown").alias("family"), F.col("p").alias("probability"), "template_share", (F.col("template_share") >= s.least_share).alias("confirmed"))


def judged(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """Paragraphs of docs that have a cue or reach the model's threshold: their likeliest class (top), its probability p and, of a family, template_share."""
    spark = docs.sparkSession
    classes = [*FAMILIES, "unknown"]
    weights = F.broadcast(spark.createDataFrame([(g, *w) for g, w in sorted(model.weights.items())], "gram long, " + ", ".join(f"w{i} double" for i in range(len(classes)))))
    found = lines(docs, model, s).withColumn("grams", grams(F.col("line"), s.hash_bits))
    terms = found.select("doc_id", "unit", "paragraph", F.xxhash64("line").alias("line_hash"), "cue", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram"))
    keys = ["doc_id", "unit", "paragraph", "line_hash"]
    sums = terms.join(weights, "gram", "left").groupBy(*keys).agg(F.first("n").alias("n"), F.first("cue").alias("cue"), *(F.round(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)), 9).alias(f"z{i}") for i in range(len(classes))))
    z = [F.exp(F.col(f"z{i}") / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")) + F.lit(b)) for i, b in enumerate(model.bias)]
    total = sum(z[1:], z[0])
    best = F.array_max(F.array(*(F.struct((e / total).alias("p"), F.lit(-i).alias("i")) for i, e in enumerate(z))))
    top = F.transform(F.array(best), lambda best: F.struct(best["p"].alias("p"), F.element_at(F.array(*map(F.lit, classes)), 1 - best["i"]).alias("top"), F.col("cue").alias("cue")))
    # exploded, as the optimizer would copy the sums into a plain filter
    named = sums.select(*keys, F.explode(F.filter(top, lambda r: r["cue"] | ((r["p"] >= model.threshold) & (r["top"] != "unknown")))).alias("best")).select(*keys, "best.*")
    listed = [(f, number) for f, texts in TEMPLATES.items() for number, _ in enumerate(texts)]
    template_rows = spark.createDataFrame([(f, i, TEMPLATES[f][i]) for f, i in listed], "family string, template int, line string")
    template_grams = template_rows.select("family", "template", grams(F.col("line"), s.hash_bits).alias("g")).select("family", "template", F.size("g").alias("size"), F.explode("g").alias("gram"))
    shares = terms.join(F.broadcast(template_grams), "gram").groupBy(*keys, "family", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("share")).groupBy(*keys, "family").agg(F.max("share").alias("template_share"))
    shares = shares.withColumnsRenamed({"doc_id": "_d", "unit": "_u", "paragraph": "_p", "line_hash": "_l", "family": "_f"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("unit") == F.col("_u")) & (F.col("paragraph") == F.col("_p")) & (F.col("line_hash") == F.col("_l")) & (F.col("top") == F.col("_f"))
    return named.join(shares, same, "left").select(*keys, "cue", "p", "top", F.coalesce("template_share", F.lit(0.0)).alias("template_share"))
