"""License scans: a logistic regression over sparse word n-grams names the licence family of a paragraph; a comparison
with the family's templates confirms it.

Training, scoring and comparison are DataFrame operations. The model's features are runs of three and four words, and
shorter ones with an anchor, a word that every paragraph of the templates has; scoring looks only at paragraphs with an
anchor.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Common notices of licence families, in lower case, and the paragraphs of their standard texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "licensed under the gnu affero general public license, version 3.",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu affero general public license along with this program. if not, see <https://www.gnu.org/licenses/>.",
    ),
    "apache-2.0": (
        "licensed under the apache license, version 2.0.",
        "released under the apache 2.0 license.",
        'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0',
        'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.',
    ),
    "bsd": (
        "released under the bsd license.",
        "licensed under the bsd 3-clause license.",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    ),
    "cc-by": ("licensed under cc by 4.0.", "this work is licensed under a creative commons attribution 4.0 international license."),
    "cc-by-nc": ("licensed under cc by-nc 4.0.", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license."),
    "cc-by-sa": ("licensed under cc by-sa 4.0.", "this work is licensed under a creative commons attribution-sharealike 4.0 international license."),
    "cc0": ("released under cc0 1.0 universal.", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under cc0."),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license, version 2.",
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu general public license along with this program; if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa.",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license, version 3.",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu general public license along with this program. if not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "released under the isc license.",
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license, version 3.",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version.",
        "you should have received a copy of the gnu lesser general public license along with this library.",
    ),
    "mit": (
        "released under the mit license.",
        "licensed under the mit license.",
        'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:',
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    ),
    "mpl-2.0": (
        "licensed under the mozilla public license, version 2.0.",
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/.",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain.",
        "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, under the unlicense.",
    ),
}
# Sentences with anchors that name no family.
UNKNOWN = (
    "all rights reserved, copyright of the author.", "copyright of the publisher, no part may be copied.", "a driving license is needed to rent a car.",
    "the license fee for this software is due each year.", "please read the license before you install the program.", "the pub lost its license last year.",
    "he studied at mit and worked on free software.", "the apache helicopter landed at noon.", "apache spark runs on many machines.",
    "a gnu is a large antelope of the public parks.", "the general public may visit the permission office.", "permission to enter was granted by the guard.",
    "creative work needs no license.", "the commons of the village are in the public domain of memory.", "redistribution of wealth was the subject.",
    "mozilla makes a browser for the public.", "version 3 of the license agreement was signed.", "the license plate was hard to read.",
    "use of this license key is subject to the terms of sale.", "copyright law differs by country.", "licensed dealers only.", "licensed under a secret agreement between the two firms.",
    "the software is licensed, not sold.", "this document is licensed to the buyer.", "she was licensed to practise in 1990.", "lesser known works are under copyright.",
    "use of the material is subject to permission of the rights holder.", "ask the museum for permission to print the picture.", "the house of commons passed a copyright act.", "the license of the bar was renewed for three years.",
    "no license is granted by implication.", "the museum shows copies of old books with permission of the author.", "software is written by people and used by people.", "the warranty of this car ends after three years.", "she sold copies of the book without fee.",
    "the following conditions must be met before the merger.", "this work is the result of many years.", "the program is free to visitors of the fair.", "you should have received a letter by now.", "the rights of the people are limited by law.", "licensed from the studio for one season.", "a fishing license costs ten coins.", "the apache river runs through the public lands.",
)
# What stands around a notice in files.
BEFORE = ("", "this file is part of the project. ", "copyright 2020 the authors. ", "notice: ")
AFTER = ("", " see the license file for details.", " all other rights are reserved.")
# Strings of which a licence notice holds one at least.
ANCHORS = ("licens", "licenc", "copyright", "apache", "gnu", "gpl", "mozilla", "unencumbered", "redistribut", "permission", "commons", "cc0", "cc by", "warrant", "free to copy")
#: A template's word pairs that a paragraph must have for its family to be confirmed.
OVERLAP = 0.7
#: Share of held sentences of no family that may pass for a notice; the comparison with templates still holds them back.
ACCEPTED = 0.05
#: Rows of training and calibration data at most; all come from the tables above.
TRAINING_ROWS = 20_000
#: A line of more code points is a paragraph of its own; shorter ones between lines without letters make one together.
LONG_LINE = 120


def anchored(text: Column) -> Column:
    """Whether a text in lower case holds an anchor."""
    found = F.contains(text, F.lit(ANCHORS[0]))
    for a in ANCHORS[1:]:
        found = found | F.contains(text, F.lit(a))
    return found


def tokens(text: Column) -> Column:
    """Words of a paragraph: runs of letters, digits and inner dots or hyphens, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*)"), 1)


def grams(words: Column, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """Distinct runs of so many words: all of three words or more, and those of fewer that hold an anchor."""

    def runs(n: int) -> Column:
        found = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return found if n > 2 else F.filter(found, anchored)

    return F.array_distinct(F.concat(*map(runs, sizes)))


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text. Comment marks don't matter, as words leave them out; lines of marks alone part paragraphs."""
    alone = F.regexp_replace(text, rf"(?dm)^(.{{{LONG_LINE + 1},}})$", "\n\n$1\n\n")
    return F.split(alone, r"\n(?:[^\p{L}\p{N}\n]*\n)+", -1)


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of literals."""
    def lit(x) -> str:
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else repr(x)

    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} as t({names})")


def training_rows(spark: SparkSession) -> DataFrame:
    """(family, text, held): notices and other sentences as they stand in files. A third of the notices and sentences, with all that may stand around them, is held out for calibration."""
    notes = values(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [("unknown", t) for t in UNKNOWN], "family, note")
    around = values(spark, [(b, a) for b in BEFORE for a in AFTER], "before, after")
    rows = notes.withColumn("held", F.pmod(F.xxhash64("note"), F.lit(3)) == 0).crossJoin(F.broadcast(around))  # the constants above
    return rows.select("family", F.concat("before", "note", "after").alias("text"), "held").limit(TRAINING_ROWS)


class Model:
    """Weights of the regression: a row per n-gram, an intercept per class, and the calibration."""

    def __init__(self, classes: list[str], weights: list[tuple], intercepts: list[float], scale: float, limit: float):
        self.classes, self.weights, self.intercepts, self.scale, self.limit = classes, weights, intercepts, scale, limit


def softmax(logits: list[float], scale: float) -> list[float]:
    top = max(logits)
    e = [math.exp((x - top) * scale) for x in logits]
    return [x / sum(e) for x in e]


def train(spark: SparkSession) -> Model:
    """Fit without the held notices, then calibrate on them: a scale of the logits that makes their true classes likeliest,
    and the probability of any family that all but ACCEPTED of the held sentences of no family stay under. The weights
    are those of a second fit on all rows.
    """
    rows = training_rows(spark).select("family", "held", grams(tokens(F.col("text"))).alias("grams")).coalesce(1).cache()
    classes = ["unknown", *sorted(TEMPLATES)]
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(rows)
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    data = vectors.transform(rows).withColumn("label", index.cast("double")).select("label", "held", "features").cache()
    regression = LogisticRegression(family="multinomial", maxIter=80, regParam=0.0005, elasticNetParam=0.2)
    held = [(int(r[0]), list(r[1].toArray())) for r in regression.fit(data.filter("not held")).transform(data.filter("held")).select("label", "rawPrediction").collect()]
    scale = min((s / 4 for s in range(1, 41)), key=lambda s: -sum(math.log(max(softmax(x, s)[y], 1e-12)) for y, x in held))
    wrong = sorted(1 - softmax(x, scale)[0] for y, x in held if not y)
    limit = max(0.5, wrong[int(len(wrong) * (1 - ACCEPTED))]) if wrong else 0.5
    fitted = regression.fit(data)
    rows.unpersist()
    data.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = [(g, *map(float, matrix[:, i])) for i, g in enumerate(vectors.vocabulary) if abs(matrix[:, i]).max() > 0]
    return Model(classes, weights, [float(x) for x in fitted.interceptVector], scale, min(limit, 0.9))


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph of `docs` (doc_id, text) that the model takes for a licence notice: doc_id, paragraph (its
    number from 0), family, probability (calibrated, of any family), overlap (of the family's nearest template), confirmed.

    Paragraphs: see `paragraphs`. Whole texts are scanned. A paragraph is of its likeliest family if the probability of any
    family is over the model's limit, else of none and left out. Null or empty text: no rows. Null doc_id: kept as null. Repeated
    rows: each gives its rows. Other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    model = model or train(spark)
    names = [f"w{i}" for i in range(len(model.classes))]
    weights = F.broadcast(values(spark, model.weights, ", ".join(["gram", *names])))  # bounded: n-grams of the tables above
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter(anchored(F.lower("text"))).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("doc_id", "row", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "line")).filter(anchored(F.lower("line")))
    lines = written(lines.withColumn("words", tokens(F.col("line"))), "paragraphs")
    hits = lines.select("row", "paragraph", F.explode(grams(F.col("words"))).alias("gram")).join(weights, "gram")
    sums = hits.groupBy("row", "paragraph").agg(*[F.sum(n).alias(n) for n in names])
    scores = F.array(*[F.lit(model.scale) * (F.col(n) + F.lit(b)) for n, b in zip(names, model.intercepts, strict=True)])
    found = sums.select("row", "paragraph", scores.alias("scores")).withColumn("top", F.array_max("scores"))
    found = found.withColumn("p", 1 - F.exp(F.get("scores", F.lit(0)) - F.col("top")) / F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    own = F.slice("scores", 2, len(model.classes) - 1)
    found = found.withColumn("family", F.element_at(F.array(*map(F.lit, model.classes[1:])), F.array_position(own, F.array_max(own)).cast("int"))).filter(F.col("p") > model.limit)
    pairs = lambda words: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " ")))
    notes = values(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], "family, note").select("family", pairs(tokens(F.col("note"))).alias("template")).groupBy("family").agg(F.collect_list("template").alias("templates"))
    out = lines.join(found, ["row", "paragraph"]).join(F.broadcast(notes), "family").withColumn("own", pairs(F.col("words")))
    overlap = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.size(t)))
    return out.withColumn("overlap", overlap).select("doc_id", "paragraph", "family", F.round("p", 4).alias("probability"), F.round("overlap", 4).alias("overlap"), (F.col("overlap") >= OVERLAP).alias("confirmed"))
