"""Licence notices in documents: a trained paragraph classifier confirmed by templates, in DataFrame functions only.

A paragraph is what stands between blank lines, however it is wrapped; its features are the word 2-grams and 3-grams that also
occur in a template. A place is a stretch of a paragraph, as long as a template, whose n-grams stand in the template's order up to
SLACK inserted or missing words. Every family of which a place holds enough of a template is compared there: by a sparse
multinomial logistic regression, as the family's probability against the unknown class on the place's own n-grams, and with the
other families at the same place, of which the best confirmed stays. So notices side by side are all found.

The regression is fitted on templates with words dropped at random and on stretches of ordinary paragraphs of the corpus, which may
share features with templates but hold none of them (the unknown class). The probability from which a family is believed is
calibrated on variants and stretches that were not fitted.

Only n-grams that meet the vocabulary, which is as large as the templates, leave the scan.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import materialize

UNKNOWN = "unknown"
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 62)
#: Variants of each template, and paragraphs of the corpus and stretches with template n-grams out of them at most, that the
#: classifier is fitted on.
VARIANTS, FIT_PARAGRAPHS = 24, 2_000
#: Share of a template's n-grams that a paragraph must hold to confirm its family.
CONFIRMED = 0.6
#: Words by which n-grams of one notice may be out of step, and words to a block of a paragraph.
SLACK, BLOCK = 8, 64

# Short notices of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "reserved": ("All rights reserved.", "This software is proprietary and confidential; all rights reserved."),
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(column: str) -> Column:
    """The word 2-grams and 3-grams of an array, as texts."""
    two, three = (f"CASE WHEN size({column}) >= {n} THEN transform(sequence(0, size({column}) - {n}), i -> concat_ws(' ', "
                  + ", ".join(f"{column}[i + {k}]" for k in range(n)) + ")) ELSE array() END" for n in (2, 3))
    return F.expr(f"concat({two}, {three})")


def _gram_key(w: str, n: int, i: str = "0") -> str:
    return "xxhash64(" + ", ".join(f"{w}[{i} + {k}]" for k in range(n)) + ")"


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, paragraph, w): the words of each part between blank lines."""
    parts = docs.select("doc_id", "text_hash", F.posexplode_outer(F.split("text", r"\n[ \t\r]*\n")).alias("paragraph", "part"))
    return parts.select("doc_id", "text_hash", "paragraph", words(F.col("part")).alias("w"))


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, two, three): keys of the 2-gram and 3-gram (null at the end) that begin at each word of `w`."""
    return rows.where("size(w) >= 2").select(*keep, F.expr(
        f"inline(transform(sequence(0, size(w) - 2), i -> struct(i AS at, {_gram_key('w', 2, 'i')} AS two, "
        f"IF(i + 2 < size(w), {_gram_key('w', 3, 'i')}, NULL) AS three)))"))


def _either(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "at", F.explode(F.array("two", "three")).alias("gram")).where("gram IS NOT NULL")


class Model:
    """Weights per n-gram and family, and the probability from which a family is believed."""

    def __init__(self, families: list[str], vocabulary: list[tuple[str, list[float]]], constant: list[float], level: float):
        self.families, self.vocabulary, self.constant, self.level = families, vocabulary, constant, level


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, number int, template string").withColumn("w", words(F.col("template")))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """A model from the templates and a bounded sample of the corpus' paragraphs, drawn by the hash of their words."""
    spark = docs.sparkSession
    known = templates(spark).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn(
        "w", F.filter("w", lambda x, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64("variant", "template", i), F.lit(8)) > 0)))
    known = known.select("family", "variant", ngrams("w").alias("grams"))
    vocabulary = {r["gram"] for r in templates(spark).select(F.explode(ngrams("w")).alias("gram")).distinct().collect()}
    of_templates = templates(spark).select("family", "number", F.explode(F.array_distinct(ngrams("w"))).alias("gram"))
    of_templates = of_templates.join(of_templates.groupBy("family", "number").agg(F.count("*").alias("size")), ["family", "number"])

    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.col(text).alias("text"))
    rows = _paragraphs(rows).where("size(w) >= 2").select("w", F.xxhash64("w").alias("key"))
    total = rows.count()
    share = int(min(1.0, FIT_PARAGRAPHS / max(1, total)) * 1_000_000)
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).groupBy("key").agg(F.first("w").alias("w"))
    stretches = drawn.select("key", F.explode(F.expr(
        f"transform(sequence(0, size(w) - 1, {BLOCK // 2}), i -> slice(w, i + 1, {BLOCK}))")).alias("w"))
    stretches = materialize(stretches.select("key", F.xxhash64("w").alias("part"), F.array_distinct(ngrams("w")).alias("grams")),
                            "licence-sample")
    held = stretches.select("key", "part", F.explode("grams").alias("gram")).distinct().join(F.broadcast(of_templates), "gram")
    held = materialize(held.groupBy("key", "part", "family", "number").agg((F.count("*") / F.max("size")).alias("share")), "licence-held")
    # ordinary text: shares n-grams with templates, and no template confirms any part of its paragraph
    ordinary = held.groupBy("key").agg(F.max("share").alias("most")).where(F.col("most") < CONFIRMED)
    ordinary = held.join(ordinary, "key", "left_semi").select("part").distinct().orderBy(F.hash("part"), "part").limit(FIT_PARAGRAPHS)
    other = stretches.join(ordinary, "part", "left_semi").groupBy("part").agg(F.first("grams").alias("grams")).select(
        F.lit(UNKNOWN).alias("family"), F.pmod("part", F.lit(VARIANTS)).cast("int").alias("variant"), "grams")
    # an empty paragraph is unknown, whatever the corpus holds
    blank = spark.range(VARIANTS).select(F.lit(UNKNOWN).alias("family"), F.col("id").cast("int").alias("variant"),
                                         F.array().cast("array<string>").alias("grams"))
    families = [UNKNOWN, *sorted(TEMPLATES)]
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = known.unionByName(other).unionByName(blank).withColumn("label", number.cast("double"))
    rows = materialize(rows.withColumn("tested", F.col("variant") % 4 == 3), "licence-fit")
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(
        spark.createDataFrame([(sorted(vocabulary),)], "grams array<string>"))
    fitted = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60).fit(
        counted.transform(rows.where("NOT tested")).select("label", "features"))
    weights, constant = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    model = Model(families, [(g, [float(x) for x in weights[:, k]]) for k, g in enumerate(counted.vocabulary)],
                  [float(x) for x in constant], 0.5)
    seen = fitted.transform(counted.transform(rows.where("tested"))).select("family", vector_to_array(
        "probability").alias("p"))
    best = F.array_max(F.transform(F.slice("p", 2, len(families) - 1), lambda p: p / (p + F.col("p")[0])))
    quantiles = seen.withColumn("best", best).agg(
        F.max(F.when(F.col("family") == UNKNOWN, F.col("best"))).alias("noise"),
        F.percentile_approx(F.when(F.col("family") != UNKNOWN, F.col("best")), 0.02).alias("signal")).first()
    noise, signal = quantiles["noise"] or 0.0, quantiles["signal"] or 1.0
    model.level = min(0.9, max((noise + signal) / 2, noise + 1e-6))
    return model


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, paragraph, at, family, probability, likeness, confirmed) for each place that holds enough of a template.

    `paragraph` is the number of the part between blank lines, `at` the word in it at which the notice would begin, `likeness` the
    share of the template that is held, at least CONFIRMED; `probability` is the family's against unknown. `confirmed` is whether
    it is believed and no other believed family holds the same place better (by likeness, then by n-grams held, then by name).
    Null and empty texts give no row, nor do texts without letters or digits. Equal rows are one; rows that repeat a doc_id with
    another text are told apart by its hash. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").withColumn(
        "text_hash", F.xxhash64("text"))
    named = spark.createDataFrame(model.vocabulary, "name string, weights array<double>").withColumn("w", F.split("name", " "))
    vocabulary = named.select(F.expr(f"IF(size(w) = 2, {_gram_key('w', 2)}, xxhash64(w[0], w[1], get(w, 2)))").alias("gram"), "weights")
    twos = named.where("size(w) = 2").select(F.expr(_gram_key("w", 2)).alias("two"))
    place = ["doc_id", "text_hash", "paragraph"]
    # the vocabulary is as large as the templates, and holds the 2-gram that each of its 3-grams begins with
    hits = _placed(_paragraphs(docs), *place).join(F.broadcast(twos), "two", "left_semi")
    hits = _either(hits, *place).join(F.broadcast(vocabulary.select("gram")), "gram", "left_semi").distinct()
    hits = materialize(hits.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "licence-hits")

    own = _either(_placed(templates(spark), "family", "number", "w"), "family", "number", "w").groupBy("family", "number").agg(
        F.max(F.size("w")).alias("long"), F.count_distinct("gram").alias("size"), F.collect_list(F.struct("at", "gram")).alias("all"))
    own = own.select("family", "number", "long", "size", F.expr("inline(all)")).withColumnRenamed("at", "offset")
    of = [*place, "family", "number", "long", "size"]
    lines = hits.join(F.broadcast(own), "gram").groupBy(*of, (F.col("at") - F.col("offset")).alias("start")).agg(
        F.collect_set("gram").alias("grams"))
    near = lines.withColumn("bucket", F.explode(F.expr(f"array(floor(start / {SLACK}), floor(start / {SLACK}) - 1)")))
    near = near.groupBy(*of, "bucket").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"), F.max(F.struct(
        F.size("grams").alias("n"), (-F.col("start")).alias("back"))).alias("most"))
    near = near.select(*place, "family", "long", (-F.col("most.back")).alias("at"), F.size("grams").alias("held"),
                       (F.size("grams") / F.col("size")).alias("likeness")).where(f"likeness >= {CONFIRMED}")
    best = near.groupBy(*place, "family", "at").agg(F.max(F.struct("likeness", "held", "long")).alias("best"))
    found = materialize(best.select(*place, "family", "at", "best.*"), "licence-places")

    reach = found.withColumn("block", F.explode(F.expr(
        f"sequence(floor((at - {SLACK}) / {BLOCK}), floor((at + long + {SLACK}) / {BLOCK}))")))
    block = F.floor(F.col("at") / BLOCK).alias("block")
    inside = reach.withColumnRenamed("at", "begins").join(hits.select(*place, "at", "gram", block), [*place, "block"]).where(
        f"at BETWEEN begins - {SLACK} AND begins + long + {SLACK}")
    number = F.array_position(F.array(*[F.lit(f) for f in model.families]), F.col("family")).cast("int")
    constant = F.array(*[F.lit(c) for c in model.constant])
    odds = inside.select(*place, "family", "begins", "gram").distinct().join(F.broadcast(vocabulary), "gram").groupBy(
        *place, "family", "begins").agg(F.sum(F.element_at("weights", number) - F.col("weights")[0]).alias("z"))
    odds = odds.withColumn("z", F.col("z") + F.element_at(constant, number) - constant[0])
    odds = odds.withColumn("probability", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "z"))))).drop("z")
    found = materialize(found.join(odds.withColumnRenamed("begins", "at"), [*place, "family", "at"]), "licence-scored")

    believed = found.where(F.col("probability") >= model.level).withColumn(
        "block", F.explode(F.expr(f"sequence(floor(at / {BLOCK}), floor((at + long) / {BLOCK}))")))
    worse = believed.alias("a").join(believed.alias("b"), [*place, "block"]).where(
        "a.family <> b.family AND 2 * (least(a.at + a.long, b.at + b.long) - greatest(a.at, b.at)) >= least(a.long, b.long) AND "
        "struct(b.likeness, b.held, b.family) > struct(a.likeness, a.held, a.family)").select(
        *place, F.col("a.family").alias("family"), F.col("a.at").alias("at"), F.lit(True).alias("worse")).distinct()
    confirmed = (F.col("probability") >= model.level) & F.col("worse").isNull()
    return found.join(worse, [*place, "family", "at"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text_hash", "paragraph", "at", "family", "probability",
        "likeness", confirmed.alias("confirmed"))


def summarize(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, licenses, probability) for every row of `docs`: confirmed families, sorted, and the largest
    probability of a confirmed notice (0 without one)."""
    per_doc = found.where("confirmed").groupBy("doc_id", "text_hash").agg(
        F.count_distinct("paragraph").alias("n_paragraphs"), F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("licenses"),
        F.max("probability").alias("probability")).withColumnsRenamed({"doc_id": "of", "text_hash": "hash"})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["of"]) & (rows["text_hash"] == per_doc["hash"]), "left").select(
        "doc_id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
