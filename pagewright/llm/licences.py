"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates; native on the data.

Training happens once on the driver, on the fixed templates and statements below and nothing else: multinomial logistic
regression over sparse word 1- and 2-grams, with ordinary prose, licence-like prose and licences of no listed family as
the unknown class. The
fitted weights, one row per n-gram, are a table whose size the templates fix.

Scanning is DataFrame operations only. Every line is a paragraph, and so is every run of lines that a hard line break
joins (the line ends without a sentence mark and the next one isn't blank), so wrapped licence texts are read whole. A
paragraph's known n-grams are joined with the weights and summed, once for paragraphs that have the same, the constant
added, and a softmax gives the family. A temperature fitted on left-out paragraphs calibrates the probability; below `min_probability`, or when
unknown is likeliest, the family is unknown, and the paragraph is reported only if it holds a template's 2-gram with a
content word. The share of the family's best template's 2-grams found in the paragraph confirms the prediction.

Texts and paragraphs with none of the `passing` words aren't scored. They hold no phrase, and the model itself can give
them nothing but unknown: `most_without` bounds the score of any paragraph that lacks the `gate` words, from the weights.

Defined cases: a null, empty or blank text has no paragraphs; equal paragraphs of a document are reported each with its
line number (of a joined one, that of its first line, with `lines` above 1); control characters 1 and 2 count as
blanks; rows with equal ids give rows each; null ids are kept; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch

UNKNOWN = "unknown"
# Function words; a 2-gram of nothing else says nothing of licences.
FUNCTION = frozenset("a all an and any are as at be been but by can for from had has have he her his if in into is it its may no not of on one or our out she so than that the their them there these they this those to under until up upon was we were when where which who will with without you your".split())
# The most frequent words of the four languages of PROSE.
FREQUENT = "the of and to a in is that it for was on with as by be this are at from an de la le et les des en un du une que pour est par qui dans der die und den von zu das mit sich auf ist im ein el y los se del las con no su"
# Short statements by which texts commonly name a licence.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is released under the Apache 2.0 license.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache License 2.0.", "You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Distributed under the MIT License.", "MIT License", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL, version 3 or later.", "Licensed under the GPLv3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Distributed under the GNU GPL.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "Released under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Distributed under the GNU LGPL.", "Licensed under the LGPL, version 3."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Distributed under the GNU AGPL."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the BSD license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under MPL 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Licensed under the ISC license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0", "This article is distributed under a Creative Commons Attribution license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Released under CC BY-SA 3.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0 for noncommercial use.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under CC BY-NC 3.0."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0", "Released under CC BY-ND 3.0."],
    "public-domain": ["This work is in the public domain.", "Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying is strictly prohibited.", "Copyright 2020 the company. All rights reserved.", "No part of this work may be copied without permission."],
}
# Paragraphs that are no licence statements, some of them with licence vocabulary.
OTHERS = [
    "The weather was fine and the children played in the garden until the evening.", "Results of the second experiment are shown in the following table.", "She asked for permission to leave the room early.", "The driver lost his licence after the accident last year.",
    "A licence is needed to fish in this river from spring to autumn.", "The warranty covers repairs for two years after purchase.", "The court ruled on a question of copyright in the case of the two publishers.", "You need a license plate on every car in this state.", "Version 3 of the program was published in May.",
    "The public library opens at nine and closes at six.", "He studied at MIT and later worked on free software.", "The apache people live in the southwest.", "General conditions and terms of the contract are in the appendix.", "Creative work needs time and patience.", "The software may be used by any person in the office.",
    "Food was redistributed among the villages.", "Its licence terms are set out in the agreement between both parties.", "The common attribution of the painting is disputed.", "This file describes the data format of the second release.", "The source of the river lies in the mountains.",
    "Er kam mit dem Zug und ging mit den Kindern in den Garten.", "La casa de la familia está en el centro de la ciudad.", "Elle est venue avec les enfants dans la maison de la ville.", "The library was released in spring and the second version came later.", "All of the rights of the workers were discussed at the meeting.",
    "You may use the room without charge.", "The terms of the agreement were published by the court.", "This work is the first of its kind in the world.", "He may copy the text by hand for any person who asks.", "The program is free for all visitors of the museum.",
]
# Names by which the families, and licences of none of them, go in short statements, and such statements.
NAMES = {
    "apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0", "Apache License 2.0"], "mit": ["MIT", "MIT License", "MIT/X11", "MIT/Expat"], "gpl": ["GPL", "GPLv3", "GNU GPL", "GPL-2.0", "GNU General Public License"], "lgpl": ["LGPL", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License"], "agpl": ["AGPL", "AGPLv3", "GNU AGPL", "Affero General Public License"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD 2-Clause", "New BSD", "Simplified BSD"], "mpl": ["MPL", "MPL 2.0", "Mozilla Public License"], "isc": ["ISC", "ISC License"], "cc-by": ["CC BY", "CC-BY-4.0", "Creative Commons Attribution"], "cc-by-sa": ["CC BY-SA", "CC-BY-SA-4.0", "Creative Commons ShareAlike"], "cc-by-nc": ["CC BY-NC", "CC-BY-NC-4.0", "Creative Commons NonCommercial"],
    "cc-by-nd": ["CC BY-ND", "CC-BY-ND-4.0", "Creative Commons NoDerivatives"], "public-domain": ["CC0", "CC0 1.0", "public domain", "Unlicense"], "proprietary": ["proprietary", "all rights reserved", "closed source"],
    UNKNOWN: ["Eclipse", "Eclipse Public License v 2.0", "EPL-2.0", "Boost", "Boost Software License 1.0", "Artistic", "Artistic License 2.0", "zlib", "WTFPL", "EUPL", "CDDL", "Python Software Foundation", "PostgreSQL", "Open Font License", "Microsoft Public License", "driving", "television", "fishing", "trade"],
}
FORMS = ["License: {}", "{} licence", "{} licensed", "Released under {}.", "Licensed under the {} license.", "This code is {} licensed.", "SPDX-License-Identifier: {}", "Lizenziert unter der {}-Lizenz", "{}-Lizenz", "Sous licence {}.", "Licencia {}."]
# Prose of four languages with words that are also names of licences.
PROSE = [
    "mit", "mit", "mit", "mit", "mit", "mit", "by", "by", "or", "may", "any", "all", "without", "under", "mit der", "mit dem", "mit den und der", "mit einer", "und mit", "sich mit", "mit ihrer Schwester nach Hause", "Er sprach mit der Familie, die auf dem Land lebt.", "Das Haus mit dem Garten ist von der Stadt nicht weit.", "mit von zu das", "Die Frau ging mit den Kindern auf den Markt, und es war kalt.", "ist mit im nicht dem ein",
    "avec les", "dans la", "de la et le", "pour une", "by", "and by the", "by the river", "of the", "with the", "is it that was for", "in the", "the and to of a", "version", "source", "public", "work", "software", "general", "copy", "file", "free", "notice", "this", "under the bridge", "terms", "permission", "en el", "de los", "por la", "no", "domain", "common", "use", "conditions",
    "The version of the story by the river was free for all.", "A copy of the notice was in the file.", "The general public was in the square.", "These conditions and terms of use were new to us.", "Open source", "The software is new.", "He was licensed as a doctor.", "The work of art is on loan.", "No part of it was new.", "copyright", "The rights of man.", "reserved seats", "All seats are reserved.",
]
WORD = r"[^a-z0-9.]+"
# A line end within a paragraph, between a line without a sentence mark at its end and one that isn't blank, with the next
# line's number and comment mark; both lines are numbered here.
JOINED = r"(?<=[^\s.!?:;\x01])[ \t]*\n\d+\x01[ \t]*(?:[#*/;%-]+[ \t]+)?(?=\S)"
CONFIRM = 0.6


def ngrams(text: str) -> list[str]:
    """Distinct 1- and 2-grams; the native columns below follow the same rule."""
    words = [w for w in (x.strip(".") for x in re.split(WORD, text.lower())) if w]
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _fit(x: np.ndarray, y: np.ndarray, k: int, weight: np.ndarray, ridge: float = 0.02, rounds: int = 250, rate: float = 0.5) -> np.ndarray:
    w, speed = np.zeros((x.shape[1], k)), 0.0
    hot = np.eye(k)[y] * (weight / np.bincount(y, weight, minlength=k)[y] ** 0.5)[:, None]
    hot *= len(y) / hot.sum()
    share = hot.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x.T @ (hot - share * p) / len(y) - ridge / len(y) * w
        w = w + rate * speed
    return w


def _rows() -> dict[tuple[str, int], int]:
    """Training paragraphs with their classes, and how often each counts."""
    families = [*TEMPLATES, UNKNOWN]
    stated = [(form.format(name), families.index(f)) for form in FORMS for f, names in NAMES.items() for name in names]
    # Words of prose stand alone in most texts of other vocabulary, so these rows count for more.
    return Counter([(t, i) for i, ts in enumerate(TEMPLATES.values()) for t in ts] + stated + [(t, len(TEMPLATES)) for t in [*OTHERS, *PROSE * 4]])


@functools.cache
def _matrix() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """N-grams, a row of them for each training paragraph with a last column of ones, the paragraphs' classes and weights."""
    rows = _rows()
    grams = sorted({g for t, _ in rows for g in ngrams(t)})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1))
    x[:, -1] = 1
    for r, (t, _) in enumerate(rows):
        found = [at[g] for g in ngrams(t)]
        x[r, found] = 1 / max(1, len(found)) ** 0.5
    return grams, x, np.array([c for _, c in rows]), np.array(list(rows.values()), float)


@functools.cache
def _folds(folds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every training paragraph by a fit without its fold, and the classes; n-grams of that fold alone count as unseen."""
    _, x, y, weight = _matrix()
    held = []
    for fold in range(folds):
        test = np.arange(len(y)) % folds == fold
        part = x[test].copy()
        part[:, :-1] = (part[:, :-1] > 0) & (x[~test, :-1] > 0).any(axis=0)
        part[:, :-1] /= np.maximum(1, part[:, :-1].sum(axis=1, keepdims=True)) ** 0.5
        held.append((part @ _fit(x[~test], y[~test], len(TEMPLATES) + 1, weight[~test]), y[test]))
    return np.vstack([h[0] for h in held]), np.concatenate([h[1] for h in held])


@functools.cache
def trained() -> tuple[list[str], list[str], np.ndarray, float]:
    """Families, n-grams, weights (a row per n-gram and a last one of constants), and the temperature."""
    grams, x, y, weight = _matrix()
    z, truth = _folds()

    def loss(t):
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return -(q[np.arange(len(q)), truth] - np.log(np.exp(q).sum(axis=1))).mean()

    return [*TEMPLATES, UNKNOWN], grams, _fit(x, y, len(TEMPLATES) + 1, weight), float(min(np.geomspace(0.2, 5, 60), key=loss))


def held_out() -> tuple[float, float, float]:
    """Of the templates and other paragraphs, each scored by a fit without its fold: the share given its right class, the
    mean probability of the class given, and the share of other paragraphs left unknown."""
    families, _, _, temperature = trained()
    z, truth = _folds()
    q = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    q /= q.sum(axis=1, keepdims=True)
    right = q.argmax(axis=1) == truth
    other = truth == len(families) - 1
    return float(right.mean()), float(q.max(axis=1).mean()), float(right[other].mean())


@functools.cache
def phrases() -> list[str]:
    """The templates' 2-grams with a content word: what an unknown paragraph must hold to be reported."""
    return sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(t) if " " in g and any(len(w) >= 4 and w not in FUNCTION for w in g.split())})


def most_without(words: set[str]) -> float:
    """How far a family's score can exceed that of unknown, at most, in a paragraph with none of these words.

    A score is the constant and the sum of the weights of the n known n-grams over the root of n; so the most that any
    n-grams can add, whatever n, is the largest of the sums of the greatest advantages over the roots of their numbers.
    """
    _, grams, weights, _ = trained()
    left = np.array([not words & set(g.split()) for g in grams])
    ahead = weights[:, :-1] - weights[:, -1:]
    gains = -np.sort(-np.maximum(ahead[:-1][left], 0), axis=0)
    roots = np.arange(1, len(gains) + 1)[:, None] ** 0.5
    return float((np.max(np.cumsum(gains, axis=0) / roots, axis=0, initial=0) + ahead[-1]).max())


@functools.cache
def gate() -> list[str]:
    """Words without any of which every paragraph is unknown to the model: all that it knows, but for those that it can
    spare, the most frequent ones first, then those that speak least for any family."""
    _, grams, weights, _ = trained()
    ahead = np.maximum((weights[:-1, :-1] - weights[:-1, -1:]).max(axis=1), 0)
    strength: dict[str, float] = {}
    for gram, most in zip(grams, ahead):
        for w in gram.split():
            strength[w] = max(strength.get(w, 0.0), float(most))
    words = set(strength)
    for w in [*FREQUENT.split(), *sorted(words - set(FREQUENT.split()), key=lambda w: (strength[w], w))]:
        if w in words and most_without(words - {w}) < 0:
            words.remove(w)
    return sorted(words)


@functools.cache
def passing() -> list[str]:
    """Words without any of which no paragraph is reported: those of the gate, and the longest content word of each phrase."""
    return sorted({*gate(), *(max((w for w in g.split() if w not in FUNCTION), key=lambda w: (len(w), w)) for g in phrases())})


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Weights (gram, w) and templates (family, grams) as tables; both are fixed by the templates."""
    families, grams, weights, _ = trained()
    model = spark.createDataFrame([(g, [float(v) for v in weights[i]]) for i, g in enumerate(grams)], "gram string, w array<double>")
    known = spark.createDataFrame([(f, [g for g in ngrams(t) if " " in g]) for f in TEMPLATES for t in TEMPLATES[f]], "family string, template array<string>")
    return model, known


def _words(text):
    return F.array_remove(F.split(F.lower(text), r"\.*[^a-z0-9.]+\.*|^\.+|\.+$"), "")


def _pairs(words):
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _once(name: str, value):
    """A column that is evaluated once a row, however often later steps use it."""
    return F.explode(F.array(value)).alias(name)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, lines, paragraph: each line that isn't blank, and each run of lines joined by hard line breaks."""
    lines = F.split(F.translate(F.col(text_col), "\x01\x02", "  "), r"\r?\n")
    numbered = F.array_join(F.transform(lines, lambda l, i: F.concat(i.cast("string"), F.lit("\x01"), l)), "\n")
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.split(F.regexp_replace(numbered, JOINED, "\x02"), "\n")).alias("run"))
    runs = runs.select("doc_id", F.substring_index("run", "\x01", 1).cast("int").alias("line"), _once("parts", F.split(F.expr("substr(run, instr(run, '\x01') + 1)"), "\x02")))
    whole = F.when(F.size("parts") > 1, F.array(F.struct(F.col("line").alias("line"), F.size("parts").alias("lines"), F.array_join("parts", " ").alias("paragraph"))))
    single = F.transform("parts", lambda l, i: F.struct((F.col("line") + i).alias("line"), F.lit(1).alias("lines"), l.alias("paragraph")))
    return runs.select("doc_id", F.explode(F.concat(single, F.coalesce(whole, F.slice(single, 1, 0)))).alias("u")).select("doc_id", "u.*").filter(F.btrim("paragraph") != "")


def scan(docs: DataFrame, min_probability: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph of a family, or unknown with a phrase of licences: doc_id, line, lines, paragraph, family, probability, similarity, confirmed."""
    families, _, weights, temperature = trained()
    spark = docs.sparkSession
    model, known = _tables(spark)
    passes = lambda words: F.exists(words, lambda w: w.isin(*passing()))
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(passes(_words(F.col("text"))))
    units = paragraphs(held).select("*", _once("words", _words(F.col("paragraph")))).filter(passes(F.col("words")))
    # All that is told of a paragraph depends on the n-grams that the model knows, so these stand for it.
    known_grams = F.array_sort(F.filter(F.array_distinct(F.concat("words", _pairs(F.col("words")))), lambda g: g.isin(*trained()[1])))
    found = units.select("doc_id", "line", "lines", "paragraph", _once("grams", known_grams)).filter(F.size("grams") > 0)
    found = Scratch(spark, "licences").table("found", found)
    texts = found.select("grams").distinct()
    hits = texts.select("grams", F.explode("grams").alias("gram")).join(F.broadcast(model), "gram")
    sums = hits.groupBy("grams").agg(F.count("*").alias("n"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(families))])
    constant = weights[-1]
    scores = F.array(*[(F.coalesce(F.col(f"s{i}") / F.sqrt("n"), F.lit(0.0)) + float(constant[i])) / temperature for i in range(len(families))])
    scored = sums.select("grams", scores.alias("z"))
    top = F.array_max("z")
    scored = scored.withColumn("p", F.transform("z", lambda v: F.exp(v - top))).withColumn("probability", F.array_max("p") / F.aggregate("p", F.lit(0.0), lambda a, b: a + b))
    names = F.array(*[F.lit(f) for f in families])
    best = F.element_at(names, F.array_position("z", top).cast("int"))
    scored = scored.withColumn("predicted", best).withColumn("family", F.when(F.col("probability") >= min_probability, best).otherwise(UNKNOWN))
    compared = scored.join(F.broadcast(known.withColumnRenamed("family", "predicted")), "predicted", "left")
    share = F.coalesce(F.size(F.array_intersect("grams", "template")) / F.size("template"), F.lit(0.0))
    confirmed = compared.groupBy("grams", "family", "probability").agg(F.max(share).alias("similarity"))
    # Unknown paragraphs are of interest only where they speak of licences.
    told = confirmed.filter((F.col("family") != UNKNOWN) | F.exists("grams", lambda g: g.isin(*phrases())))
    out = found.join(told, "grams")
    return out.select("doc_id", "line", "lines", "paragraph", "family", "probability", "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= CONFIRM)).alias("confirmed"))
