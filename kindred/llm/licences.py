"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line, or a notice that is wrapped over lines that follow each other. Its features are the word n-grams (one to three words)
that notices have and that hold a cue, and how many other words there are, hashed; a sparse multinomial logistic regression names the family. It is trained on notices of each
family, whole and with words missing, and on all paragraphs of the corpus that no notice speaks for, as the class ``unknown``, with and
without the words that licences are known by: paragraphs of the same features are one row with their number. The probability that a family
needs is calibrated on a quarter of these paragraphs, which are held out, so that hardly any unknown one reaches it. A prediction counts as confirmed if
a notice of the family has enough of its n-grams in the paragraph.

Every line that has any word of a notice is scored, but for words of grammar and single digits; without
one nothing speaks for a family. Lines that follow each other and have such a word, or words of notices only, are
one paragraph of any length, which is scored as a whole for a notice that no line holds alone; what a confirmed
notice has is then taken out, and the rest scored again, until no notice is confirmed. A notice counts once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import staged

UNKNOWN = "unknown"
#: Notices by which licences are known.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "Licensed under the GNU Affero General Public License, version 3."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["This work has been released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
}
#: Identifiers by which they are known, each a notice of its own.
NAMES = {"agpl": "AGPL-3.0-only", "apache": "Apache-2.0", "bsd": "BSD-3-Clause", "cc-by": "CC-BY-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc0": "CC0-1.0", "gpl": "GPL-3.0-only", "lgpl": "LGPL-3.0-only", "mit": "MIT", "mpl": "MPL-2.0"}
for _family, _name in NAMES.items():
    NOTICES[_family].append(f"SPDX-License-Identifier: {_name}")
#: Words of notices that tell nothing alone.
GRAMMAR = {*"a all and any are as be been by can following form has in is it may no not of or part person provided that the this to under use with without work you".split(), *"0123456789"}
CUES = sorted({w for own in NOTICES.values() for t in own for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()} - GRAMMAR)
#: Parts of words that most licence paragraphs have one of; examples of the unknown class are drawn with and without.
COMMON = "(?i)licen[cs]|copyright|rights reserved|public domain|creative commons|redistribut|permission|waived"
COMMON_PARTS = ["licenc", "licens", *COMMON.split("|")[1:]]
#: All words of notices.
WORDS = sorted({w for own in NOTICES.values() for t in own for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()})
FAMILIES = sorted(NOTICES)


def _runs(notice: str, n: int = 2) -> list[str]:
    own = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
    return [" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]


#: Runs of one to three words of notices, since other words tell nothing; those that hold a cue, which are the features; and those of two words.
TOLD = sorted({r for own in NOTICES.values() for t in own for n in (1, 2, 3) for r in _runs(t, n)})
TELLING = [r for r in TOLD if not set(r.split()).isdisjoint(CUES)]
RUNS = sorted({r for own in NOTICES.values() for t in own for r in _runs(t)})
#: Features of the model, its penalty, the weight of all examples of each kind of the unknown class together at most, the
#: share of them that may reach a family, and the part of a notice that confirms it.
FEATURES, PENALTY, EXAMPLES, FALSE, CONFIRMED = 1 << 14, 0.002, 3_000, 0.005, 0.6


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(own: Column) -> Column:
    """Distinct runs of one to three words, joined by blanks."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (n - 1))
        made = F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))
        return F.when(F.size(own) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def with_grams(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with ``grams``. Words are a column first: inside the n-grams they would be split anew for every run.
    A filter on what is made of them would undo that, so write the rows before one."""
    return rows.withColumn("own", words(text)).withColumn("grams", grams(F.col("own"))).drop("own")


def telling(own: Column) -> Column:
    """Of n-grams those that are features, in order, and one that says how many words are in no notice, in doublings."""
    other = F.size(F.array_except(F.filter(own, lambda g: ~g.contains(" ")), F.lit(WORDS)))
    return F.concat(F.sort_array(F.array_intersect(own, F.lit(TELLING))), _others(other))


def _others(many: Column) -> Column:
    doublings = F.floor(F.log2(many + F.lit(1)))
    return F.when(many > 0, F.array(F.concat(F.lit("others "), doublings.cast("string")))).otherwise(F.array().cast("array<string>"))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice) of the fixed notices."""
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("notice")) for f in FAMILIES for t in NOTICES[f]])
    return spark.range(1).select(F.inline(rows))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines) of the runs of lines with a cue, or with words of notices only; ``lines`` has (position, paragraph,
    cue). A run has a line with a cue. Written, since training and the scan both read it."""
    picked = docs.select(docs[id_col].cast("long").alias("id"), F.split(docs[text_col], "\n").alias("lines"))
    cues = F.array(*[F.lit(w) for w in CUES])

    def told(x: Column, i: Column) -> Column:
        own = x["own"]
        cue = F.arrays_overlap(own, cues)
        of_notices = (F.size(own) > 0) & ~F.exists(own, lambda w: ~w.isin(WORDS))
        return F.struct(i.alias("position"), x["line"].alias("paragraph"), cue.alias("cue"), F.when(cue, True).otherwise(of_notices).alias("held"))

    split = F.arrays_zip(F.col("lines").alias("line"), F.transform("lines", words).alias("own"))
    marked = picked.select("id", F.transform(split, told).alias("lines"))
    # Between two lines that break lies a run, which may be empty.
    breaks = F.transform(F.filter("lines", lambda x: ~x["held"]), lambda x: x["position"])
    marked = marked.select("id", "lines", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("lines"))).alias("breaks"))
    n = F.size("breaks")
    ends = F.arrays_zip(F.slice("breaks", 1, n - 1).alias("after"), F.slice("breaks", 2, n - 1).alias("before"))
    made = F.transform(F.filter(ends, lambda e: e["before"] - e["after"] > 1), lambda e: F.slice(F.col("lines"), e["after"] + 2, e["before"] - e["after"] - 1))
    made = F.filter(made, lambda run: F.exists(run, lambda x: x["cue"]))
    return staged(marked.select("id", F.explode(made).alias("lines")), "runs")


def paragraphs(found: DataFrame) -> DataFrame:
    """(id, position, paragraph) of the lines with a cue, of ``runs``."""
    cued = F.transform(F.filter("lines", lambda x: x["cue"]), lambda x: F.struct(x["position"], x["paragraph"]))
    return found.select("id", F.inline(cued))


@dataclass
class Model:
    regression: LogisticRegressionModel
    threshold: float

    def classified(self, rows: DataFrame) -> DataFrame:
        """Rows with ``grams``, with (family, probability): the likeliest family, and the probability of
        any; unknown if that does not reach the threshold (a text may name two families)."""
        made = _features(rows.withColumn("told", telling(F.col("grams")))).drop("told")
        made = self.regression.transform(made).withColumn("chances", vector_to_array("probability"))
        known = F.slice("chances", 1, len(FAMILIES))
        made = made.withColumn("probability", 1 - F.element_at("chances", -1)).withColumn("place", F.array_position(known, F.array_max(known)))
        names = F.array(*[F.lit(f) for f in FAMILIES])
        family = F.when(F.col("probability") >= self.threshold, F.element_at(names, F.col("place").cast("int"))).otherwise(UNKNOWN)
        return made.withColumn("family", family).drop("features", "rawPrediction", "prediction", "chances", "place")


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="told", outputCol="features").transform(rows)


def _examples(docs: DataFrame, id_col: str, text_col: str, bound: int, found: DataFrame) -> DataFrame:
    """(told, label, weight, held): n-grams that tell, of notices, whole and without some words, and of all unknown paragraphs.

    Unknown paragraphs of the same n-grams are one row; those of a kind weigh as many as they are, ``bound`` together at most."""
    spark = docs.sparkSession
    names = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("notice")) for f, n in NAMES.items()])
    base = notices(spark).unionAll(spark.range(1).select(F.inline(names))).select("family", words(F.col("notice")).alias("own"))
    n = F.size("own")
    one = base.select("family", "own", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    missing = one.select("family", F.concat(F.slice("own", 1, F.col("k") - 1), F.slice("own", F.col("k") + 1, n)).alias("own"))
    parts = one.where((F.col("k") >= 3) & (F.col("k") * 10 >= n * 6)).select("family", F.slice("own", 1, F.col("k")).alias("own"))
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    known = base.select("family", "own").unionAll(missing).unionAll(parts).where((n > 1) & (F.size("own") > 0))
    known = known.select(telling(grams(F.col("own"))).alias("told"), label.cast("double").alias("label"), F.lit(4.0).alias("weight"), F.lit(False).alias("held"))
    # Unknown paragraphs: without a common cue and a run of a notice's words that tells, and with one but no run.
    # The regular expression in parts, which are found much faster.
    common = F.exists(F.array(F.lower("paragraph")), lambda x: functools.reduce(Column.__or__, [x.contains(part) for part in COMMON_PARTS])).alias("common")
    held = (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0).alias("held")
    cued = with_grams(paragraphs(found).where("id IS NOT NULL"), F.col("paragraph"))
    cued = staged(cued.select(F.array_intersect("grams", F.lit(RUNS)).alias("runs"), telling(F.col("grams")).alias("told"), common, held), "cued")
    speak = F.when(F.col("common"), F.lit(RUNS)).otherwise(F.lit([r for r in RUNS if r in TELLING]))
    apart = cued.where(~F.arrays_overlap("runs", speak)).groupBy("told", "common", "held").agg(F.count("*").alias("n"))
    # Lines without a cue differ only in the number of their words.
    text = docs.where(docs[id_col].isNotNull()).select(F.explode(F.split(docs[text_col], "\n")).alias("paragraph"))
    own = F.col("own")
    lines = text.where(~common).withColumn("own", words(F.col("paragraph")))
    bare = (F.size(own) > 0) & ~F.arrays_overlap(own, F.lit(CUES))
    lines = lines.select(_others(F.size(F.array_except(own, F.lit(WORDS)))).alias("told"), F.lit(False).alias("common"), held, bare.cast("long").alias("bare"))
    alike = lines.groupBy("told", "common", "held").agg(F.sum("bare").alias("n"))
    unknown = staged(apart.unionAll(alike.where("n > 0")), "unknown")
    total = {r.common: r.n for r in unknown.groupBy("common").agg(F.sum("n").alias("n")).collect()}  # two rows
    share = F.when(F.col("common"), min(1.0, bound / total.get(True, 1))).otherwise(min(1.0, bound / total.get(False, 1)))
    unknown = unknown.select("told", F.lit(float(len(FAMILIES))).alias("label"), (F.col("n") * share).alias("weight"), "held")
    return staged(known.unionAll(unknown), "examples")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = EXAMPLES, found: DataFrame | None = None) -> Model:
    """A model from the fixed notices and all unknown paragraphs, each kind of which weighs as ``bound`` of them at most.

    ``found``: the ``runs`` of the documents, if they are at hand."""
    found = runs(docs, id_col, text_col) if found is None else found
    rows = _features(_examples(docs, id_col, text_col, bound, found))
    train_on = staged(rows.where(~F.col("held")).select("features", "label", "weight"), "features")
    fit = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=0.5, maxIter=40, weightCol="weight")
    # A class for every family, also if no unknown paragraph was found.
    made = fit.fit(train_on.unionAll(train_on.limit(1).select("features", F.lit(float(len(FAMILIES))).alias("label"), F.lit(1e-3).alias("weight"))))
    often = F.ceil(F.col("weight") * 1e6).cast("long").alias("often")
    scored = made.transform(rows.where("held")).select((1 - F.element_at(vector_to_array("probability"), -1)).alias("p"), often)
    top = scored.agg(F.percentile("p", 1 - FALSE, F.col("often"))).first()[0]
    return Model(made, max(0.5, min(0.95, top or 0.0)))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(id, position, paragraph, family, probability, likeness, confirmed) of the lines with a family, and of notices
    over several lines, whose position is that of their paragraph's first line."""
    found = runs(docs, id_col, text_col) if found is None else found
    made = notices(docs.sparkSession).select("family", grams(words(F.col("notice"))).alias("notice"))
    made = made.groupBy("family").agg(F.collect_list("notice").alias("notices"))  # three for each family
    like = F.transform("notices", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    columns = ["id", "position", "paragraph", "family", "probability", "likeness"]

    def known(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("family") != UNKNOWN).join(F.broadcast(made), "family").withColumn("likeness", F.array_max(like))

    # Written before it is filtered: a filter on the family would evaluate the model again for each use of it.
    text = F.col("paragraph")
    marked = staged(model.classified(with_grams(paragraphs(found), text)).drop("grams"), "marked")
    alone = staged(known(with_grams(marked.where(F.col("family") != UNKNOWN), text)).select(*columns), "alone")

    place = [F.element_at("lines", 1)["position"].alias("position"), F.element_at("lines", -1)["position"].alias("last")]
    whole = F.array_join(F.transform("lines", lambda x: x["paragraph"]), " ")
    rest = found.where("size(lines) > 1").select("id", *place, whole.alias("paragraph"))
    rest = staged(with_grams(rest, text).withColumn("grams", F.array_intersect("grams", F.lit(TOLD))), "wide")
    wide = None
    for _ in FAMILIES:
        hits = staged(known(staged(model.classified(rest), "marked")).where(F.col("likeness") >= CONFIRMED), "hits")
        wide = hits if wide is None else wide.unionAll(hits)
        if hits.isEmpty():
            break
        rest = hits.select("id", "position", "last", "paragraph", F.array_except("grams", F.flatten("notices")).alias("grams"))
    wide = wide.select(*columns, "last").distinct()
    # Not a notice that a line of the paragraph holds alone; and its lines do not count beside it.
    near = alone.where(F.col("likeness") >= CONFIRMED).select(F.col("id").alias("near_id"), F.col("family").alias("near_family"), F.col("position").alias("near"))
    held = F.col("id").eqNullSafe(F.col("near_id")) & (F.col("family") == F.col("near_family")) & F.col("near").between(F.col("position"), F.col("last"))
    wide = wide.join(near, held, "left_anti")
    taken = wide.select(F.col("id").alias("near_id"), F.col("position").alias("first"), F.col("last").alias("end"))
    inside = F.col("id").eqNullSafe(F.col("near_id")) & F.col("position").between(F.col("first"), F.col("end")) & (F.col("likeness") < CONFIRMED)
    alone = alone.join(taken, inside, "left_anti")
    return alone.unionAll(wide.select(*columns)).withColumn("confirmed", F.col("likeness") >= CONFIRMED)


def licensed(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, n_confirmed, families) for every row: lines of the text, lines and wrapped
    notices with a licence family, those confirmed, and the confirmed families, sorted, joined by commas.

    Null or empty text has no paragraphs. Rows that repeat an id are one text."""
    hits = scan(docs, model, id_col, text_col, found).select("id", "position", "family", "confirmed").distinct()
    by_doc = hits.groupBy("id").agg(
        F.countDistinct("position", "family").alias("n_licence"),
        F.countDistinct(F.when(F.col("confirmed"), F.struct("position", "family"))).alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    )
    count = F.when(F.coalesce(F.length(docs[text_col]), F.lit(0)) == 0, 0).otherwise(F.size(F.split(docs[text_col], "\n")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), count.cast("long").alias("n_paragraphs"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
