"""License scans: a trained paragraph classifier with a calibrated unknown class.

Paragraphs are the lines of a text. Features are the word 1- and 2-grams that occur in licence
templates, by presence (a sparse vector over a bounded vocabulary). A multinomial
logistic regression tells the licence families and ``unknown`` apart. It learns from the
templates, whole and amid prose, from look-alike sentences, and from half of all
the corpus's own paragraphs as unknown. The threshold of a detection is calibrated on the other
half: at most ``FALSE_RATE`` of unknown paragraphs may reach it. Nothing is sampled: paragraphs are counted by the set of template n-grams
they hold, which is all that the classifier sees. A detected
paragraph is confirmed when it holds at least ``CONTAINMENT`` of the 2-grams of one of its family's templates.

A notice may also be wrapped over several lines. Its place is found by *windows of words*, whatever the line breaks: a
window of a template of n words is any run of ``STRETCH`` * n words, and holds the notice if it has ``CONTAINMENT`` of the template's
2-grams. Of overlapping windows the one with the most 2-grams stays. The words of a window that lies on more than one line go through the same classifier,
which must reach the threshold for the template's own family; the row's family and probability are those of that class.
Only texts with a key word are looked at: a template's key words touch so many of its 2-grams that a window lacking them all cannot hold
the notice, so nothing is lost.

Everything on the path is DataFrame, SQL and Spark ML (JVM) work: scan, explode, n-grams, vectorise,
classify, compare. Rows are never shuffled except the few detections and, for windows, the places of template 2-grams in texts with
a key word (by text; a text's places fit where the text did); the model and the templates are bounded by the template list.

Defined cases: null, empty and word-less paragraphs are not scored; every row of a table is scanned, so
repeated rows give repeated detections; probability ties go to ``unknown`` first, then to the family that
sorts first; texts and lines of any length are read whole; further columns are not read, whatever their names; a null ``doc_id``
stays null; an empty table gives no rows, and a model fitted on one knows the templates alone.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialize

UNKNOWN = "unknown"
# sums of the weights of all learned paragraphs, as unknown and around templates
UNKNOWN_WEIGHT, MIXED_WEIGHT = 1000, 768
# steps of the threshold between 0 and 1
STEPS = 1 << 16
FALSE_RATE = 0.001
LEAST_PROBABILITY = 0.5
CONTAINMENT = 0.8
STRETCH = 1.25
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: Wording of common licence notices, by family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: Sentences that use licence words without granting anything.
LOOK_ALIKES = [
    "His license expired last year.", "You need a driver's license to rent a car.", "The poet takes license with the facts.",
    "She studied at MIT and later at Berkeley.", "The Apache helicopter was released in 1986.", "Permission to enter is granted by the guard.",
    "The general public may visit the library.", "This version of the work is free.", "Terms and conditions apply to all sales.",
    "The software was released in version 3.", "A copy of the file was obtained.", "The university licensed the patent to a company.",
    "All rights to this work are with the author.", "The foundation published a free report.", "Commercial use of creative work pays.",
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def bigrams(tokens: Column) -> Column:
    """Pairs of neighbours. The one-element array binds ``tokens`` once, so its expression is not repeated per pair."""
    pairs = lambda t: F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.concat(F.get(t, i), F.lit(" "), w))
    return F.get(F.transform(F.array(tokens), pairs), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph number from 0, paragraph) of all lines that hold a word."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_no", "paragraph"))
    return lines.where(F.trim("paragraph") != "")


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, template_bigrams)."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, template string").withColumn("template_bigrams", F.array_distinct(bigrams(words(F.col("template")))))


def vocabulary(spark: SparkSession) -> list[str]:
    """All 1- and 2-grams of the templates."""
    tokens = words(F.col("template"))
    grams = templates(spark).select(F.explode(F.concat(tokens, bigrams(tokens))).alias("gram")).distinct()
    return sorted(r[0] for r in grams.collect())


class LicenseModel:
    """Vectoriser, classifier, family names by class and the calibrated threshold."""

    def __init__(self, vectoriser: CountVectorizerModel, classifier: LogisticRegressionModel, families: list[str], threshold: float):
        self.vectoriser, self.classifier, self.families, self.threshold = vectoriser, classifier, families, threshold

    def classify(self, rows: DataFrame, column: str = "paragraph") -> DataFrame:
        """Adds ``family`` and ``probability`` of the likeliest licence family, and ``p_unknown``."""
        return _classify(rows, column, self.vectoriser, self.classifier, self.families)


def held_grams(text: Column, vocabulary: list[str]) -> Column:
    """The 1- and 2-grams of a text that the vocabulary holds, with repeats. Words outside it become null first, so only pairs of
    known words are joined and looked up. The one-element arrays bind the words once."""
    single, double = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    ends = sorted({w for g in double for w in g.split(" ")} | set(single))
    known = lambda t: F.transform(t, lambda w: F.when(w.isin(ends), w))
    joined = lambda t: F.transform(t, lambda w, i: F.concat(w, F.lit(" "), F.get(t, i + 1)))
    held = lambda t: F.concat(F.filter(t, lambda w: w.isin(single)), F.filter(joined(t), lambda p: p.isin(double)))
    return F.get(F.transform(F.transform(F.array(words(text)), known), held), F.lit(0))


def _vectorise(rows: DataFrame, column: str, vectoriser: CountVectorizerModel) -> DataFrame:
    # the vectoriser passes over other grams
    return vectoriser.transform(rows.withColumn("__grams", held_grams(F.col(column), vectoriser.vocabulary)))


def _scored(rows, kept, classifier, families) -> DataFrame:
    # a generator stands between the model and what reads its result, so the model runs once per row
    scored = classifier.transform(rows).select(*kept, F.explode(F.array(vector_to_array("__probability"))).alias("__p"))
    known = F.slice("__p", 2, len(families) - 1)
    best = F.array_max(known)
    names = F.array(*[F.lit(f) for f in families[1:]])
    return scored.select(*kept, F.element_at(names, F.array_position(known, best).cast("int")).alias("family"),
                         best.alias("probability"), F.col("__p")[0].alias("p_unknown"))


def _classify(rows, column, vectoriser, classifier, families) -> DataFrame:
    return _scored(_vectorise(rows, column, vectoriser), rows.columns, classifier, families)


def compare(rows: DataFrame, family: str | None = "family") -> DataFrame:
    """Adds ``template`` and ``similarity``: of the row's family's templates (all, without a family) the best contained one."""
    held = rows.withColumn("__bigrams", bigrams(words(F.col("paragraph")))).withColumn("__row", F.monotonically_increasing_id())
    t = F.broadcast(templates(rows.sparkSession).withColumnRenamed("family", "template_family"))
    pairs = held.join(t, (F.col(family) == F.col("template_family")) if family else F.lit(True))
    similarity = F.size(F.array_intersect("template_bigrams", "__bigrams")) / F.size("template_bigrams")
    best = F.max(F.struct(similarity.alias("similarity"), F.size("template_bigrams").alias("size"), F.col("template"))).alias("__best")
    return pairs.groupBy("__row", *rows.columns).agg(best).select(*rows.columns, F.col("__best.template").alias("template"), F.col("__best.similarity").alias("similarity"))


def gram_sets(docs: DataFrame) -> DataFrame:
    """(__grams, learn, number, n): the sets of template n-grams that the distinct paragraphs of a table hold, and how many hold each.

    ``learn`` parts the paragraphs by hash into those to learn from and those to calibrate on; ``number`` deals them to the templates.
    """
    held = F.array_sort(F.array_distinct(held_grams(F.col("paragraph"), vocabulary(docs.sparkSession))))
    # a generator stands between, so that the words are made once
    lines = paragraphs(docs).select(F.xxhash64("paragraph").alias("h"), F.explode(F.array(held)).alias("__grams")).groupBy("h", "__grams").agg(F.count(F.lit(1)))
    return lines.groupBy("__grams", (F.col("h") % 2 == 0).alias("learn"), F.pmod("h", F.lit(sum(map(len, TEMPLATES.values())))).cast("int").alias("number")).agg(F.count(F.lit(1)).alias("n"))


def threshold_of(scored: DataFrame, false_rate: float) -> float:
    """The smallest multiple of 1 / ``STEPS`` that at most ``false_rate`` of all rows reach; ``scored``: (probability, n rows)."""
    total = scored.agg(F.sum("n")).first()[0] or 0
    step = F.floor(F.col("probability") * STEPS).cast("int").alias("step")
    allowed, least = total * false_rate, int(LEAST_PROBABILITY * STEPS)
    # one row a step: their number is bounded whatever the table
    for r in scored.groupBy(step).agg(F.sum("n").alias("n")).where(F.col("step") >= least).orderBy(F.desc("step")).collect():
        allowed -= r.n
        if allowed < 0:
            return (r.step + 1) / STEPS
    return LEAST_PROBABILITY


def fit(docs: DataFrame, false_rate: float = FALSE_RATE) -> LicenseModel:
    """Train on the templates and on half of all distinct paragraphs of ``docs``, calibrate on the other half.

    The classifier sees which template n-grams a paragraph holds, so paragraphs are counted by that set and no text is left out or cut.
    Sets that hold a template are no examples of the unknown class. The counts of each class are scaled to a fixed sum,
    so that a large corpus does not drown the templates.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(TEMPLATES)]
    label = lambda f: F.lit(float(families.index(f)))
    kind = F.element_at(F.create_map(*[c for f in families for c in (F.lit(f), label(f))]), F.col("family"))
    tokens = words(F.col("template"))
    whole = spark.createDataFrame([(f, t, k) for k, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)], "family string, template string, number int")
    whole = whole.select("number", kind.alias("label"), F.array_distinct(F.concat(tokens, bigrams(tokens))).alias("own"))
    sets = materialize(gram_sets(docs), "license-grams")
    contained = [F.size(F.array_intersect("__grams", F.array(*[F.lit(p) for p in w.pairs]))) / len(w.pairs) for w in wordings()]
    unlicensed = sets.where(F.greatest(*contained) < CONTAINMENT)
    learn = unlicensed.where("learn")
    total = learn.agg(F.sum("n")).first()[0] or 0
    # notices amid prose: every learned paragraph around one of the templates
    weight = lambda most: F.col("n") * F.lit(min(1.0, most / max(total, 1)))
    mixed = learn.join(F.broadcast(whole), "number").select(F.array_union("own", "__grams").alias("__grams"), "label", weight(MIXED_WEIGHT).alias("weight"))
    plain = whole.select(F.col("own").alias("__grams"), "label", F.lit(1.0).alias("weight"))
    decoy = spark.createDataFrame([(t,) for t in LOOK_ALIKES], "paragraph string").select(words(F.col("paragraph")).alias("t"))
    decoys = decoy.select(F.concat("t", bigrams(F.col("t"))).alias("__grams"), label(UNKNOWN).alias("label"), F.lit(1.0).alias("weight"))
    train = plain.unionByName(mixed).unionByName(decoys).unionByName(learn.select("__grams", label(UNKNOWN).alias("label"), weight(UNKNOWN_WEIGHT).alias("weight")))
    vectoriser = CountVectorizerModel.from_vocabulary(vocabulary(spark), inputCol="__grams", outputCol="__features", binary=True)
    learner = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=30,
                                 probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__class")
    classifier = learner.fit(vectoriser.transform(train).select("__features", "label", "weight"))
    scored = _scored(vectoriser.transform(unlicensed.where(~F.col("learn")).select("__grams", "n")), ["n"], classifier, families)
    return LicenseModel(vectoriser, classifier, families, threshold_of(scored, false_rate))


class Wording:
    """A template's words as windows need them: number, 2-grams, words of its window and its key words."""

    def __init__(self, number: int, family: str, template: str, containment: float):
        tokens = re.findall(WORD, template.lower())
        self.number, self.family, self.template = number, family, template
        self.pairs = sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:])})
        self.window = math.ceil(STRETCH * len(tokens))
        # a window that holds the notice lacks fewer 2-grams than these words touch
        enough, self.keys = len(self.pairs) - math.ceil(containment * len(self.pairs) - 1e-9) + 1, []
        for word in sorted(set(tokens), key=lambda w: (-len(w), w)):
            if sum(any(k in p.split(" ") for k in self.keys) for p in self.pairs) < enough:
                self.keys.append(word)


def wordings(containment: float = CONTAINMENT) -> list[Wording]:
    """All templates that can be wrapped: of two words or more."""
    every = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    found = [Wording(n, family, text, containment) for n, (family, text) in enumerate(every)]
    return [w for w in found if w.pairs]


def windows(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, paragraph_no, last_no, paragraph, template, template_family, similarity, on_one_line): the notices of a text, wherever lines break.

    ``paragraph_no`` and ``last_no`` are the lines of the first and the last 2-gram, ``paragraph`` the window's words;
    ``on_one_line``: some line alone holds the notice.
    """
    known = wordings(containment)
    keys = sorted({k for w in known for k in w.keys})
    pairs_known = sorted({p for w in known for p in w.pairs})
    longest = max(w.window for w in known)
    # the one-element array binds the text in lower case, which is made once and not for every key
    has_key = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in keys])
    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.get(F.transform(F.array(F.lower("text")), has_key), F.lit(0)))
    # a blank line is a word of its own, without letters, which no window crosses
    tokens_of = lambda line: F.when(line.rlike(r"^[ \t\r]*$"), F.array(F.lit(""))).otherwise(words(line))
    lined = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.transform(tokens_of(line), lambda w: F.struct(w.alias("w"), i.alias("line")))))

    def places(tokens: Column) -> Column:
        """The template 2-grams of a text: place, 2-gram, lines, and the words from there on."""
        both = lambda t, i: F.when(t["w"] == "", F.lit("")).otherwise(F.concat(t["w"], F.lit(" "), F.get(tokens, i + 1)["w"]))
        pair = lambda t, i: F.struct(i.alias("at"), both(t, i).alias("pair"), t["line"].alias("line"), F.get(tokens, i + 1)["line"].alias("last"))
        found = F.filter(F.transform(tokens, pair), lambda p: p["pair"].isin(["", *pairs_known]))
        return F.transform(found, lambda p: F.struct(p["at"].alias("at"), p["pair"].alias("pair"), p["line"].alias("line"), p["last"].alias("last"),
                                                     F.slice(tokens, p["at"] + 1, F.lit(longest))["w"].alias("words")))

    # generators stand between, so that tokens are made once
    hits = (asked.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode(F.array(lined)).alias("tokens"))
            .select("row", "doc_id", F.explode(places(F.col("tokens"))).alias("h")).select("row", "doc_id", "h.*"))
    spark = docs.sparkSession
    templates_by_pair = spark.createDataFrame([(p, w.number, len(w.pairs), w.window, w.template, w.family) for w in known for p in ["", *w.pairs]],
                                              "pair string, number int, size int, window int, template string, template_family string")
    ahead = Window.partitionBy("row", "number").orderBy("at").rangeBetween(0, longest - 2)
    held = hits.join(F.broadcast(templates_by_pair), "pair").withColumn("__in", F.collect_list(F.struct("at", "pair", "line", "last")).over(ahead)).where(F.col("pair") != "")
    blank = F.array_min(F.transform(F.filter("__in", lambda h: h["pair"] == ""), lambda h: h["at"]))
    held = held.withColumn("__to", F.least(F.col("at") + F.col("window") - 2, blank - 1))
    held = held.withColumn("__in", F.filter("__in", lambda h: h["at"] <= F.col("__to")))
    held = held.withColumn("matched", F.size(F.array_distinct(F.col("__in")["pair"]))).withColumn("end", F.array_max(F.col("__in")["at"]) + 1)
    held = held.withColumn("last_no", F.array_max(F.col("__in")["last"])).withColumn("similarity", F.col("matched") / F.col("size"))
    of_line = lambda n: F.filter("__in", lambda h: (h["line"] == n) & (h["last"] == n))["pair"]
    alone = F.exists(F.array_distinct(F.col("__in")["line"]), lambda n: F.size(F.array_distinct(of_line(n))) / F.col("size") >= containment)
    held = held.where(F.col("similarity") >= containment).withColumn("on_one_line", alone).drop("__in", "__to", "pair", "last")
    # of windows that overlap the largest alone: most 2-grams, then the fuller template, the shorter run, the earlier one
    order = F.struct("matched", "similarity", (F.col("at") - F.col("end")).alias("short"), (-F.col("at")).alias("early"), (-F.col("number")).alias("first"))
    near = Window.partitionBy("row").orderBy("at").rangeBetween(-longest, longest)
    others = F.collect_list(F.struct(order.alias("o"), F.col("at").alias("a"), F.col("end").alias("e"))).over(near)
    beaten = F.exists("__others", lambda o: (o["a"] <= F.col("end")) & (o["e"] >= F.col("at")) & (o["o"] > F.col("__order")))
    best = held.withColumn("__order", order).withColumn("__others", others).where(~beaten)
    return best.select("doc_id", F.col("line").alias("paragraph_no"), "last_no", F.array_join(F.slice("words", F.lit(1), F.col("end") - F.col("at") + 1), " ").alias("paragraph"),
                       "template", "template_family", "similarity", "on_one_line")


def wrapped(docs: DataFrame, model: LicenseModel, containment: float = CONTAINMENT) -> DataFrame:
    """Detections (columns of ``scan``) of notices that are wrapped over lines, so that none holds them alone."""
    found = model.classify(windows(docs, containment).where(~F.col("on_one_line")))
    found = found.where((F.col("probability") >= model.threshold) & (F.col("probability") > F.col("p_unknown")) & (F.col("family") == F.col("template_family")))
    return found.select("doc_id", F.col("paragraph_no").cast("int").alias("paragraph_no"), "family", "probability", "template", "similarity", F.lit(True).alias("confirmed"))


def scan(docs: DataFrame, model: LicenseModel, containment: float = CONTAINMENT) -> DataFrame:
    """One row per detected line, and per notice wrapped from that line on: doc_id, paragraph_no, family, probability, template, similarity, confirmed."""
    found = model.classify(paragraphs(docs)).where((F.col("probability") >= model.threshold) & (F.col("probability") > F.col("p_unknown")))
    return compare(found.drop("p_unknown")).select(
        "doc_id", F.col("paragraph_no").cast("int").alias("paragraph_no"), "family", "probability", "template", "similarity",
        (F.col("similarity") >= containment).alias("confirmed")).unionByName(wrapped(docs, model, containment))
