"""Licence scan: a trained paragraph classifier over word n-grams, calibrated, and confirmed against templates.

Every step is a Spark expression or Spark's own machine learning (JVM code, no Python on executors).

1. Paragraphs are the lines of a text; lines of more than LONG words are cut into sentences. A paragraph is looked at if it
   has a cue word of licences or shares a word triple with a template; no other can be confirmed by step 5.
2. Training rows are runs of words of the templates, with words left out by hash, and as the unknown class a bounded,
   hashed sample of the corpus's paragraphs that share no word triple with a template, runs of those put around cue words, and
   sentences that speak of licences without being one.
3. A multinomial logistic regression on hashed runs of one to three words gives each family a probability.
4. A fifth of the training rows is held back: it sets the temperature of the probabilities and the least probability
   of a known family, such that one in a hundred unknown paragraphs would pass.
5. A prediction stands if enough of the word triples of the paragraph, or of a template of that family, are shared.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import cut_lineage

#: Words above which a line is cut into sentences; hashed features; unknown paragraphs sampled at most (expected number).
LONG, FEATURES, SAMPLE = 80, 1 << 14, 2_000
#: Share of word triples that confirms a family; share of unknown paragraphs that may pass; folds, one held back.
SHARED, PASSING, FOLDS = 0.5, 0.01, 5
UNKNOWN = "unknown"

#: Words of licence notices; a notice need not have one.
CUES = r"(?i)licen[cs]|copyright|permission|warrant|redistribut|public domain|spdx|creative commons|\bgnu\b|all rights reserved"

#: Customary notices of each licence family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT license, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "Released under CC0 1.0, no copyright reserved.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and placed it in the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the publisher, all rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited, all rights reserved.",
    ),
}

#: Sentences with cue words, or with phrases of templates, that name no licence.
OTHERS = (
    "The driver must carry a valid licence at all times.",
    "Terms and conditions apply, see the license agreement of your provider.",
    "Copyright law protects original works of authorship.",
    "The warranty covers parts and labour for two years.",
    "Permission to enter the building is granted by the porter.",
    "She asked for permission to leave early and got it.",
    "A fishing license can be bought at the town hall.",
    "The court issued a warrant for his arrest.",
    "Redistribution of income was debated in parliament.",
    "The gnu is a large antelope of the African plains.",
    "He obtained a pilot license after two years of training.",
    "The committee on copyright met again last week.",
    "Their restaurant lost its liquor license in March.",
    "No license was found for this work.",
    "The label of the box names the licensed distributor.",
    "You need written permission from the landlord.",
    "She sent a copy of the letter to her sister.",
    "The museum is open free of charge to children.",
    "No part of this story is true.",
    "You may not use this door after dark.",
    "You should have received a parcel along with this letter.",
    "The rest of this work was lost in a fire.",
)


def _words(text: Column) -> Column:
    """Lower-case words and numbers, in which 2.0 and by-nc are one word each."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    """All runs of n words."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _triples(words: Column) -> Column:
    """Distinct word triples; of shorter paragraphs, the whole."""
    return F.array_distinct(F.when(F.size(words) >= 3, _runs(words, 3)).otherwise(F.array(F.array_join(words, " "))))


@cache
def _template_triples() -> tuple[str, ...]:
    """The same of all templates, which are ASCII, without Spark."""
    out = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        words = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", text.lower())
        out |= {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return tuple(sorted(out))


@cache
def _triple_pattern() -> str:
    """A pattern that finds every template triple in lower-case text (and some more: words may be parts of 2.0 and the like)."""
    tree: dict = {}
    for triple in _template_triples():
        node = tree
        for c in triple + "\n":
            node = node.setdefault(c, {})

    def pattern(node: dict) -> str:
        own = {" ": r"[^\p{L}\p{N}]++", "\n": r"(?![\p{L}\p{N}])"}
        parts = [own.get(c, re.escape(c)) + pattern(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return r"(?<![\p{L}\p{N}])" + pattern(tree)


def _maybe(text: Column) -> Column:
    """A cue word, or what may be a template triple."""
    return text.rlike(CUES) | F.lower(text).rlike(_triple_pattern())


def _speaks(paragraph: Column) -> Column:
    """A cue word, or a word triple of a template."""
    listed = F.array(*[F.lit(t) for t in _template_triples()])
    return paragraph.rlike(CUES) | (F.lower(paragraph).rlike(_triple_pattern()) & F.arrays_overlap(_triples(_words(paragraph)), listed))


def _paragraphs(text: Column) -> Column:
    lines = F.split(text, r"[\n\r]+")
    long = lambda line: F.regexp_count(line, F.lit(r"\S+")) > LONG
    cut = F.transform(lines, lambda line: F.when(long(line), F.split(line, r"(?<=[.!?])\s+")).otherwise(F.array(line)))
    return F.filter(F.flatten(cut), _speaks)


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    data = F.from_json(F.lit(json.dumps([{"family": f, "text": t} for f, t in rows])), "array<struct<family:string,text:string>>")
    return spark.range(1).select(F.explode(data).alias("x")).select("x.*").withColumn("words", _words(F.col("text")))


def templates(spark: SparkSession) -> DataFrame:
    """family, triples of every template."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return _literal(spark, rows).select("family", "words", _triples(F.col("words")).alias("triples"))


def _draw(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(2.0**53)


def training_rows(spark: SparkSession, docs: DataFrame, sample: int) -> DataFrame:
    """family, words, fold: variants of the templates, and the unknown class."""
    known = templates(spark).select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("v"))
    # variant 0 is whole, others are runs that hold at least 60 of 100 words, the last twenty are as long as wrapped lines; without one word in twelve
    share = F.when(F.col("v") == 0, 1.0).otherwise(0.6 + 0.4 * _draw(F.lit("share"), "words", "v"))
    length = F.greatest(F.least(F.size("words"), F.lit(3)), F.ceil(F.size("words") * share)).cast("int")
    line = F.least(F.size("words"), 7 + F.floor(F.lit(8.0) * _draw(F.lit("line"), "words", "v"))).cast("int")
    length = F.when(F.col("v") < 40, length).otherwise(line)
    begin = F.floor(_draw(F.lit("begin"), "words", "v") * (F.size("words") - F.col("n") + 1)).cast("int") + 1
    known = known.withColumn("n", length).withColumn("run", F.slice("words", begin, F.col("n")))
    kept = F.filter("run", lambda w, i: (F.col("v") == 0) | (_draw(w, i, F.col("v")) > 1 / 12))
    known = known.select("family", kept.alias("words"), "v")

    share_of = F.lit(float(sample))
    total = max(docs.count(), 1)
    some = docs.where(_draw(F.lit("corpus"), F.col("doc_id")) * total < share_of).select(F.explode(F.split("text", r"[\n\r]+")).alias("line"))
    some = some.where("length(line) > 0").select(F.slice(_words(F.col("line")), 1, LONG).alias("words")).where("size(words) > 0")
    listed = templates(spark).select(F.explode("triples").alias("triple")).distinct()
    alien = some.withColumn("id", F.xxhash64("words")).dropDuplicates(["id"]).where(_draw(F.col("id")) < 0.5)
    like = alien.select("id", F.explode(_triples(F.col("words"))).alias("triple")).join(F.broadcast(listed), "triple").select("id").distinct()
    alien = alien.join(like, "id", "left_anti").orderBy("id").limit(sample)
    cue = F.element_at(F.array(*[F.lit(w) for w in ("license", "licensed", "copyright", "permission", "warranty", "public")]), F.pmod("id", F.lit(6)).cast("int") + 1)
    amid = F.concat(F.slice("words", 1, 6), F.array(cue), F.slice("words", 7, 12))
    unknown = alien.select(F.lit(UNKNOWN).alias("family"), F.when(F.pmod("id", F.lit(2)) == 0, amid).otherwise(F.col("words")).alias("words"), F.lit(1).alias("v"))
    others = _literal(spark, [(UNKNOWN, t) for t in OTHERS]).select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("v"))
    others = others.select("family", F.filter("words", lambda w, i: (F.col("v") == 0) | (_draw(w, i, F.col("v")) > 1 / 6)).alias("words"), "v")
    rows = known.unionByName(unknown).unionByName(others).where("size(words) > 0")
    return rows.select("family", "words", F.pmod(F.xxhash64("words", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _runs(words, 2), _runs(words, 3)))


class Scanner:
    """The trained classifier with its temperature and least probability."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> None:
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        numbers = F.from_json(F.lit(json.dumps({f: float(i) for i, f in enumerate(self.families)})), "map<string,double>")
        self.hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
        rows = cut_lineage(training_rows(spark, docs, sample).withColumn("label", F.element_at(numbers, F.col("family"))), "licence-training")
        rows = self.hashing.transform(rows.withColumn("grams", _grams(F.col("words"))))
        learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False)
        self.model = learner.fit(rows.where("fold > 0").select("label", "features"))
        held = cut_lineage(self._raw(rows.where("fold = 0")).select("label", "raw"), "licence-held")
        self.temperature, self.least = 1.0, 0.5
        self._calibrate(held)

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("raw", vector_to_array("rawPrediction"))

    @staticmethod
    def _softmax(raw: Column, temperature: float) -> Column:
        top = F.array_max(raw)
        exps = F.transform(raw, lambda x: F.exp((x - top) / temperature))
        total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
        return F.transform(exps, lambda x: x / total)

    def _calibrate(self, held: DataFrame) -> None:
        """The temperature of least loss, and the probability of a known family that few unknown rows reach."""
        grid = [2.0 ** (i / 2) for i in range(-4, 7)]
        right = lambda t: F.element_at(self._softmax(F.col("raw"), t), F.col("label").cast("int") + 1)
        losses = held.agg(*[F.avg(-F.log(F.greatest(right(t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        if losses["t0"] is None:
            return
        self.temperature = grid[min(range(len(grid)), key=lambda i: losses[f"t{i}"])]
        known = F.array_max(F.slice(self._softmax(F.col("raw"), self.temperature), 1, len(TEMPLATES)))
        strange = held.where(F.col("label") == len(TEMPLATES)).agg(F.percentile(known, 1 - PASSING).alias("p")).first()["p"]
        self.least = min(0.95, max(0.5, strange or 0.0))

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """Adds family (null: unknown) and probability (of the best known family) to rows with `words`."""
        spark = paragraphs.sparkSession
        scored = self._raw(self.hashing.transform(paragraphs.withColumn("grams", _grams(F.col("words")))))
        scored = scored.withColumn("p", self._softmax(F.col("raw"), self.temperature))
        known = F.slice("p", 1, len(TEMPLATES))
        best = F.array_position(known, F.array_max(known)).cast("int")
        names = F.array(*[F.lit(f) for f in self.families])
        scored = scored.withColumns({"predicted": F.element_at(names, best), "probability": F.array_max(known), "triples": _triples(F.col("words"))})
        # the templates are fixed values, a few dozen rows
        model = templates(spark).groupBy("family").agg(F.collect_list("triples").alias("templates")).withColumnRenamed("family", "predicted")
        joined = scored.join(F.broadcast(model), "predicted", "left")
        common = lambda t: F.size(F.array_intersect(F.col("triples"), t)) / F.least(F.size("triples"), F.size(t))
        shared = F.coalesce(F.array_max(F.transform("templates", common)), F.lit(0.0))
        stands = (F.col("probability") >= self.least) & (shared >= SHARED)
        return joined.withColumns({"shared": shared, "family": F.when(stands, F.col("predicted"))})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_paragraphs (with a cue word or a word triple of a template), n_licences, families, family, probability of every row.

    families are the confirmed ones, sorted and joined by commas; family is the most probable of them (of equals the first in
    the alphabet), null with probability 0 where there is none. A null or empty text has no paragraphs. Rows
    that share a doc_id share a result, which holds the paragraphs of all of them; rows without doc_id count as one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanner = Scanner(docs.sparkSession, rows, sample)
    paragraphs = rows.where(_maybe(F.col("text"))).select("doc_id", F.explode(_paragraphs(F.col("text"))).alias("paragraph"))
    # the same paragraph of many documents is classified once
    paragraphs = paragraphs.groupBy("doc_id", "paragraph").agg(F.count("*").alias("times"))
    paragraphs = cut_lineage(paragraphs.withColumn("h", F.xxhash64("paragraph")), "paragraphs")
    distinct = paragraphs.groupBy("h", "paragraph").agg(F.count("*").alias("c")).withColumn("words", _words(F.col("paragraph"))).where("size(words) > 0")
    judged = cut_lineage(scanner.classify(distinct).select("h", "paragraph", "family", "probability"), "judged")
    found = paragraphs.join(judged, ["h", "paragraph"], "left").groupBy("doc_id").agg(
        F.sum("times").alias("n_paragraphs"),
        F.sum(F.when(F.col("family").isNotNull(), F.col("times")).otherwise(0)).alias("n_licences"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
        F.min(F.when(F.col("family").isNotNull(), F.struct((-F.col("probability")).alias("minus"), "family"))).alias("best"),
    )
    out = rows.select("doc_id").alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return out.select(
        F.col("r.doc_id").alias("doc_id"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.col("best.family").alias("family"),
        F.coalesce(-F.col("best.minus"), F.lit(0.0)).alias("probability"),
    )
