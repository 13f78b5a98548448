"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

All of the main path is DataFrame expressions and JVM estimators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Short notices by licence family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Distributed under the MIT license, see the LICENSE file.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Distributed under the terms of the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL v3 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the GNU LGPL v3.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL v3 license.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the 2-clause BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the terms of the ISC license.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 1.0.",
        "Released under the EPL 2.0 license.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons BY-NC license.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the MPL 2.0.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2024 the author. All rights reserved.",
        "No part may be reproduced without the prior written permission of the publisher.",
        "Unauthorised copying of this file is strictly prohibited; proprietary and confidential.",
    ],
}
#: Sentences that share words with licences and are none.
DECOYS = [
    "He lost his driving license last year.", "The license plate was hard to read.", "She has a license to teach at the school.", "The version of the song was released in the summer.",
    "Permission to land was given by the tower.", "The rights of the people were few.", "All seats are reserved.", "The general public was not admitted.", "A copy of the letter was sent to the school.",
    "The work is done under the roof of the house.", "Conditions in the field were met with patience.", "They published the story in the paper without any warranty of truth.", "The terms of the peace were hard.",
    "Free of charge, the museum opens on Sunday.", "It was released under the bridge into the river.", "The software was slow to start.", "The public domain of the king was large.", "The licensed dealer sells cars under the old name.",
]
UNKNOWN = "unknown"
#: Longest n-gram.
N = 3
#: A template word that more than this share of the negative paragraphs hold is no licence word.
COMMON = 0.01


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams_of(words: Column, licence_words: Column) -> Column:
    """The 1- to 3-grams of an array of words that hold a licence word."""

    def of_length(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))
        known = F.transform(F.filter(grams, lambda g: F.arrays_overlap(g, licence_words)), lambda g: F.array_join(g, " "))
        return F.when(F.size(words) >= n, known).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of_length, range(1, N + 1)))


@dataclass
class LicenceModel:
    """``words`` are the licence words: every n-gram of the vectorizer's vocabulary holds one."""

    vectorizer: CountVectorizerModel
    classifier: LogisticRegressionModel
    families: list[str]
    words: list[str]
    temperature: float
    threshold: float

    def licence_words(self) -> Column:
        return F.array(*map(F.lit, self.words))


def _templates(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """family, text, and whether it is held out of the first fit: the last wording of families with three or more."""
    rows = [(f, t, len(ts) >= 3 and i + 1 == len(ts)) for f, ts in templates.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, text string, held boolean")


def _variants(rows: DataFrame) -> DataFrame:
    """Each text with every single word left out, with words put before and after it, and as it is."""
    words = words_of(F.col("text"))
    n = F.size("words")
    rows = rows.withColumn("words", words)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice("words", 1, i - 1), F.slice("words", i + 1, F.greatest(n - i, F.lit(0)))))
    around = F.array(*[F.concat(F.split(F.lit(a), " "), F.col("words"), F.split(F.lit(b), " ")) for a, b in (("copyright 2024 the authors", "see the file for details"), ("note", "x"), ("the text of this page is", "and so on"), ("x", "all other uses need consent"))])
    made = F.concat(F.array("words"), F.when(n > 3, without).otherwise(F.array("words")), around)
    return rows.select("family", "held", F.explode(made).alias("words"))


def train_licence_model(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES, decoys: list[str] = DECOYS, negatives: DataFrame | None = None, max_negatives: int = 2000, target_precision: float = 0.99) -> LicenceModel:
    """Multinomial logistic regression on sparse word 1- to 3-grams of variants of the templates.

    The unknown class is trained on ``decoys`` and on at most ``max_negatives``
    paragraphs of ``negatives`` (column ``text``; those with the least hash). Only
    n-grams with a licence word are features: a template's word that few negatives
    hold. The temperature that divides the log-odds is chosen by likelihood on wordings
    (the last template of each family of three or more) and a third of the unknown
    paragraphs that a first fit has not seen. A paragraph is no unknown when the families'
    probabilities together reach the threshold: the least at which ``target_precision`` of
    those held-out paragraphs that are called licences are some licence.
    """
    none = _variants(spark.createDataFrame([(UNKNOWN, t, False) for t in decoys], "family string, text string, held boolean"))
    template_words = F.flatten(F.collect_list(words_of(F.col("text"))))
    words = set(_templates(spark, templates).agg(template_words).first()[0])
    if negatives is not None:
        drawn = negatives.select(F.lit(UNKNOWN).alias("family"), "text").filter(F.col("text").isNotNull()).distinct().orderBy(F.xxhash64("text"), "text").limit(max_negatives)
        drawn = written(drawn.select("family", F.lit(False).alias("held"), words_of(F.col("text")).alias("words")), "negatives")
        often = drawn.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().filter(F.col("count") > COMMON * drawn.count())
        words -= {r["w"] for r in often.filter(F.col("w").isin(sorted(words))).collect()}
        none = none.unionByName(drawn)
    none = none.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(3)) == 0)
    own = F.array(*map(F.lit, sorted(words)))
    known = _variants(_templates(spark, templates))
    families = [UNKNOWN, *templates]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = _once(known.unionByName(none), "words").withColumn("grams", ngrams_of(F.col("words"), own))
    rows = written(rows.select("family", "grams", "held", label.cast("double").alias("label")).coalesce(1), "licence-examples")
    grams = rows.filter(F.col("family") != UNKNOWN).select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()  # of the templates: bounded
    vectorizer = CountVectorizerModel.from_vocabulary([r["g"] for r in grams], inputCol="grams", outputCol="features")
    vectorizer.setBinary(True)
    data = vectorizer.transform(rows).cache()
    fit = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=40, featuresCol="features", labelCol="label")
    trial = fit.fit(data.filter("not held"))
    scores = written(trial.transform(data.filter("held")).select("label", vector_to_array("rawPrediction").alias("raw")), "licence-scores")
    temperatures = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    likelihood = [F.sum(F.log(_softmax(F.col("raw"), t)[F.col("label").cast("int")] + F.lit(1e-12))).alias(str(i)) for i, t in enumerate(temperatures)]
    sums = scores.agg(*likelihood).first()
    temperature = temperatures[max(range(len(temperatures)), key=lambda i: sums[i] if sums[i] is not None else float("-inf"))]
    some = scores.select("label", (1 - _softmax(F.col("raw"), temperature)[0]).alias("some"))
    steps = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    right = some.agg(*[F.avg(F.when(F.col("some") >= s, (F.col("label") > 0).cast("double"))).alias(str(i)) for i, s in enumerate(steps)]).first()
    threshold = next((s for i, s in enumerate(steps) if right[i] is not None and right[i] >= target_precision), steps[-1])
    model = fit.fit(data)
    data.unpersist()
    return LicenceModel(vectorizer, model, families, sorted(words), temperature, threshold)


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` whose ``columns`` are worked out once a row, however often later expressions use them."""
    for c in columns:
        df = df.withColumn(c, F.explode(F.array(c)))
    return df


def _softmax(raw: Column, temperature: float) -> Column:
    e = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def judge(paragraphs: DataFrame, model: LicenceModel, templates: dict[str, list[str]], least_overlap: float) -> DataFrame:
    """``paragraphs`` (column ``text``) of a known family: family, probability, overlap, confirmed are added."""
    kept = paragraphs.columns
    rows = _once(paragraphs.withColumn("words", words_of(F.col("text"))), "words").withColumn("grams", ngrams_of(F.col("words"), model.licence_words()))
    rows = model.classifier.transform(model.vectorizer.transform(_once(rows, "grams")))
    rows = _once(rows.select(*kept, "grams", vector_to_array("rawPrediction").alias("raw")), "raw")
    rows = _once(rows.withColumn("p", _softmax(F.col("raw"), model.temperature)), "p")
    rows = _once(rows.filter(1 - F.col("p")[0] >= model.threshold).withColumn("known", F.slice("p", 2, len(model.families) - 1)), "known")
    families = F.array(*map(F.lit, model.families[1:]))
    rows = rows.withColumn("probability", F.array_max("known")).withColumn("family", F.element_at(families, F.array_position("known", F.col("probability")).cast("int")))
    grams = F.array_distinct(ngrams_of(words_of(F.col("text")), model.licence_words()))
    known = _templates(paragraphs.sparkSession, templates).withColumn("template", F.filter(grams, lambda g: F.instr(g, " ") > 0))
    known = known.groupBy("family").agg(F.collect_list("template").alias("templates"))  # a row for each family
    shares = F.transform("templates", lambda t: F.try_divide(F.size(F.array_intersect(t, F.col("grams"))), F.size(t)))
    rows = rows.join(F.broadcast(known), "family", "left").withColumn("overlap", F.coalesce(F.array_max(shares), F.lit(0.0)))
    return rows.select(*kept, "family", "probability", "overlap", (F.col("overlap") >= least_overlap).alias("confirmed"))


def scan_licences(docs: DataFrame, model: LicenceModel, templates: dict[str, list[str]] = TEMPLATES, least_overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence paragraphs of whole texts: doc_id, paragraph (its first line, from 0), lines, family, probability, overlap, confirmed, text.

    Lines without a licence word have no feature, so the classifier knows nothing of
    them; where the model calls a paragraph without features unknown, which training
    sees to, no licence is missed by leaving them out. Of the others every line is
    judged, and so is every run of neighbouring ones, for notices wrapped over several
    lines: a run counts instead of its lines of the same family where it agrees with a
    template better than any of them. Paragraphs whose probability of any licence is
    below the model's threshold aren't returned. ``overlap`` is the largest share of a template of
    that family whose word 2- and 3-grams are in the paragraph; from ``least_overlap`` on
    it confirms the prediction.

    The texts are read and cut where they lie; only lines with licence words are
    shuffled. Null and empty texts have no paragraphs. Very long texts and lines are
    judged whole. Of families with equal probabilities the first of the model's list
    counts. Each row of ``docs`` is scanned, repeated or not; a null id stays null. An
    empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("paragraph", "text"))
    lines = written(lines.filter(F.arrays_overlap(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), model.licence_words())), "licence-lines")
    place = Window.partitionBy("row").orderBy("paragraph")
    lines = lines.withColumn("run", F.col("paragraph") - F.row_number().over(place))
    runs = lines.groupBy("row", "doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("own")).filter(F.size("own") > 1)
    runs = runs.select("row", "doc_id", "run", F.col("own")[0]["paragraph"].alias("paragraph"), F.size("own").alias("lines"), F.array_join("own.text", "\n").alias("text"))
    both = lines.withColumn("lines", F.lit(1)).unionByName(runs)
    found = written(judge(both, model, templates, least_overlap), "licence-paragraphs")
    same = ["row", "run", "family"]
    best = found.groupBy(*same).agg(F.max(F.when(F.col("lines") == 1, F.col("overlap"))).alias("line"), F.max(F.when(F.col("lines") > 1, F.col("overlap"))).alias("whole"))
    wrapped = best.select(*same, F.coalesce((F.col("whole") >= least_overlap) & (F.col("whole") > F.coalesce("line", F.lit(0.0))), F.lit(False)).alias("wrapped"))
    chosen = found.join(wrapped, same).filter(F.col("wrapped") == (F.col("lines") > 1))
    return chosen.select("doc_id", "paragraph", "lines", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"), "confirmed", "text")
