"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are blocks of lines without a blank line between them. Each is looked at in pieces: its
lines, and overlapping windows of `SPAN` words over the whole block, so that a wrapped notice is
read as one. Pieces are scored by a sparse multinomial logistic regression over word unigrams and
bigrams, trained on variants of the templates below, alone and beside ordinary lines, against
licence-like sentences and a bounded sample of the corpus's own lines (`background`, 1000). A
prediction counts if its probability reaches the threshold and the text agrees with a template of
the family: `confirm` of the template's word pairs, among them one that no other family has and one
with a stem of `STEMS`. So a paragraph without such a stem cannot be confirmed and is not scored.

The unknown class is calibrated on what the model has not seen: a first model learns without the
families of `LEFT_OUT`; its temperature comes from held-out variants of the others, and the
threshold is the one that best tells these from the left-out families. The final model learns all.

Defined cases: a null or blank text has no paragraph; each row is scanned for itself, so
repeated rows agree; an empty table gives an empty result (and trains without background).
Columns other than doc_id and text are not read.

Scale: one pass without a shuffle of texts. The weights are broadcast: their number is bounded by the
training set (`vocabulary`, 16384 n-grams). Only pieces with a cue leave the scan, and their
n-grams are summed map-side per piece.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let, new_path, text_of

OTHER = "other"
#: Names of public licences by family, as notices and SPDX lines write them.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("apache-2.0", "apache2", "apache 2.0", "apache v2"),
    "mit": ("mit", "x11"),
    "bsd": ("bsd", "bsd-2-clause", "bsd-3-clause", "new bsd", "simplified bsd"),
    "isc": ("isc",),
    "gpl": ("gpl", "gplv2", "gplv3", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-3.0-only", "gpl-2.0-or-later", "gpl-3.0-or-later", "gnu gpl"),
    "lgpl": ("lgpl", "lgplv2.1", "lgplv3", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-or-later", "lgpl-3.0-or-later", "gnu lgpl"),
    "agpl": ("agpl", "agplv3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "gnu agpl"),
    "mpl-2.0": ("mpl", "mpl-2.0", "mpl 2.0"),
    "epl-2.0": ("epl", "epl-1.0", "epl-2.0"),
    "eupl": ("eupl", "eupl-1.1", "eupl-1.2"),
    "bsl-1.0": ("bsl-1.0", "boost software"),
    "cc-by": ("cc by", "cc-by", "cc-by-4.0", "cc-by-3.0"),
    "cc-by-sa": ("cc by-sa", "cc-by-sa", "cc-by-sa-4.0", "cc-by-sa-3.0"),
    "cc-by-nc": ("cc by-nc", "cc-by-nc", "cc-by-nc-4.0", "cc by-nc-sa", "cc-by-nc-sa-4.0", "cc by-nc-nd"),
    "cc0": ("cc0", "cc0-1.0", "unlicense"),
    "proprietary": (),
}
#: Names that are words or firms as well: they count beside a licence word only.
PLAIN = ("mit", "x11", "bsd", "isc", "new bsd", "simplified bsd", "epl", "unlicense", "mpl", "cc by", "boost software")
#: Phrases of public licence notices by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "gpl": (
        "gnu general public license version 3",
        "gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "lgpl": (
        "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "agpl": (
        "gnu affero general public license",
        "under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    "mpl-2.0": (
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    ),
    "epl-2.0": (
        "eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
    ),
    "eupl": ("european union public licence", "licensed under the eupl version 1.2"),
    "bsl-1.0": ("boost software license version 1.0",),
    "cc-by": (
        "creative commons attribution 4.0 international license",
        "creative commons attribution 3.0 unported license",
        "creative commons attribution license",
    ),
    "cc-by-sa": (
        "creative commons attribution-sharealike 4.0 international license",
        "creative commons attribution-sharealike license",
        "creative commons attribution share-alike license",
    ),
    "cc-by-nc": (
        "creative commons attribution-noncommercial 4.0 international license",
        "creative commons attribution-noncommercial-sharealike 4.0 international license",
        "creative commons attribution-noncommercial license",
    ),
    "cc0": (
        "released into the public domain",
        "dedicated to the public domain under cc0",
        "cc0 1.0 universal public domain dedication",
        "this is free and unencumbered software released into the public domain",
    ),
    "proprietary": (
        "all rights reserved",
        "proprietary and confidential",
        "no part of this publication may be reproduced without the prior written permission of the publisher",
        "unauthorized copying of this file via any medium is strictly prohibited",
    ),
}
#: Sentences that use the words of licences without granting one.
DECOYS = (
    "he renewed his driver license at the office last week",
    "a fishing license is required for the lake",
    "the license plate was covered with mud",
    "the ministry issued a new license to the company version 2 of the plan",
    "she asked for permission to leave the room early",
    "permission is hereby required from the owner of the house",
    "copyright law is a complex topic in many countries",
    "the warranty of the car ended in the spring",
    "the general public was invited to the free concert",
    "software is used by many people every day",
    "the apache river runs through the valley",
    "students of mit visited the museum under the bridge",
    "all seats were reserved for the guests",
    "all rights of the workers must be respected",
    "the right version of the story was released under pressure",
    "terms and conditions apply to this offer",
    "the foundation published a free report for the public",
    "the european union and the public discussed the mozilla report",
    "creative work and common sense are needed for this attribution",
    "an eclipse was seen by the public in march",
)
#: Families that the calibration's model does not know.
LEFT_OUT = ("eupl", "isc", "mpl-2.0", "agpl")
FILLERS = ("", "our project is", "copyright 2020 example", "for more see the file")
#: Every template has a pair with one of these.
STEMS = ("licen", "copyright", "permission", "distribut", "reserved", "apache", "gpl", "gnu", "mozilla", "mpl", "cc-by", "by-sa", "by-nc", "cc0", "attribution", "domain", "proprietary", "reproduc", "unauthorized", "eupl", "epl-2.0", "epl-1.0", "bsd-", "bsl-1.0")
SPAN = 40
_WORD = "[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"


def _short(name: str) -> list[str]:
    named = [f"{name} license", f"{name} licence", f"license {name}", f"licence {name}", f"licensed {name}", f"{name} licensed", f"spdx-license-identifier {name}"]
    return named if name in PLAIN else [*named, f"under {name}", f"the {name}"]


#: What a notice is compared with.
TEMPLATES: dict[str, tuple[str, ...]] = {f: (*NOTICES[f], *(t for n in names for t in _short(n))) for f, names in NAMES.items()}


def template_pairs(template: str) -> list[str]:
    words = re.findall(_WORD, template)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def own_pairs() -> dict[str, list[str]]:
    """The word pairs that the templates of one family only have."""
    every = {f: {p for t in ts for p in template_pairs(t)} for f, ts in TEMPLATES.items()}
    return {f: sorted(ps - set().union(*(o for g, o in every.items() if g != f))) for f, ps in every.items()}


def has_cue(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, [low.contains(x) for x in STEMS]))


def with_stem(pairs: list[str]) -> list[str]:
    return [p for p in pairs if any(x in p for x in STEMS)]


def words_of(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0))


def pairs_of(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def grams(paragraph: Column) -> Column:
    return let(words_of(paragraph), lambda w: F.array_distinct(F.concat(w, pairs_of(w))))


def pieces(paragraph: Column) -> Column:
    """A paragraph's lines, and windows of SPAN words over all of it, half a window apart; normalised."""
    spelt = lambda words: F.array_join(words, " ")
    lines = F.transform(F.split(paragraph, "\n"), words_of)
    short = F.transform(F.filter(lines, lambda w: F.size(w) <= SPAN), spelt)

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SPAN // 2 - 1, F.lit(0)), F.lit(SPAN // 2))
        return F.transform(starts, lambda i: spelt(F.slice(words, i + 1, SPAN)))

    return F.array_distinct(F.concat(short, let(words_of(paragraph), windows)))


def paragraphs(text: Column) -> Column:
    """Of each paragraph with a cue, its pieces with one."""
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: has_cue(p))
    return F.transform(blocks, lambda p: F.filter(pieces(p), lambda x: has_cue(x)))


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, by a file in the shared folder: in a plan it would be kept with
    every plan that is made from it."""
    at = new_path(spark, "licence-rows")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(rows), 1000):
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows[i : i + 1000]).encode()))
    out.close()
    return spark.read.schema(schema).json(at)


def variants(lines: list[str]) -> list[dict]:
    """label, text, held (a quarter, for calibration): templates and decoys, whole and without one of
    their words, after a filler or beside an ordinary line."""
    rows, k = [], 0
    for label, said in [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(OTHER, t) for t in DECOYS]:
        words = said.split(" ")
        drops = range(0, len(words), max(1, len(words) // 6)) if len(words) > 4 else ()
        for text in (said, *(" ".join(words[:i] + words[i + 1 :]) for i in drops)):
            for before in (FILLERS[k % len(FILLERS)], FILLERS[(k + 1) % len(FILLERS)], *([" ".join(lines[k % len(lines)].split(" ")[: SPAN // 2])] if lines else [])):
                rows.append({"label": label, "text": f"{before} {text}".strip(), "held": k % 4 == 3})
                k += 1
    return rows + [{"label": OTHER, "text": x, "held": i % 4 == 3} for i, x in enumerate(lines)]


def train(docs: DataFrame, background: int = 1000, vocabulary: int = 1 << 14) -> dict:
    """names, weights per n-gram, intercepts, temperature, sure (the threshold). The background
    comes to the driver: at most that many lines."""
    spark, names = docs.sparkSession, [*TEMPLATES, OTHER]
    # Of so many documents only that no task sends a thousand lines.
    some = docs.filter(F.pmod(F.xxhash64(text_of()), F.lit(max(1, docs.count() // (4 * max(1, background))))) == 0)
    lines = some.select(F.explode(F.split(text_of(), "\n")).alias("line")).filter(F.length("line").between(20, 400) & ~has_cue(F.col("line")))
    plain = [" ".join(re.findall(_WORD, r.line.lower())) for r in lines.select(F.substring("line", 1, 400).alias("line")).orderBy(F.xxhash64("line"), "line").limit(background).collect()]
    number = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))]), F.col("label"))
    rows = durable(local_table(spark, variants(plain), "label string, text string, held boolean").select("label", number.alias("y"), grams(F.col("text")).alias("grams"), "held"), "licence-training")
    fitted = lambda some: (
        counts := CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=vocabulary, minDF=2.0).fit(some),
        LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3, maxIter=40).fit(counts.transform(some)),
    )
    left_out = F.col("label").isin(*LEFT_OUT)
    counts, lr = fitted(rows.filter(~F.col("held") & ~left_out))
    z = vector_to_array("rawPrediction")
    asked = durable(lr.transform(counts.transform(rows.filter(F.col("held") | left_out))).select("label", F.col("y").cast("int").alias("y"), z.alias("z")), "licence-calibration")

    def best_of(t: float) -> Column:
        return F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max("z")) / t))

    def loss(t: float) -> Column:
        total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max("z")) / t))
        return F.avg(F.log(total) - (F.get("z", F.col("y")) - F.array_max("z")) / t)

    heat = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
    losses = asked.filter(~left_out).agg(*[loss(t).alias(str(i)) for i, t in enumerate(heat)]).first()
    temperature = min(zip(losses, heat, strict=True), key=lambda x: x[0] if x[0] is not None else math.inf)[1]
    # A piece is named if its best class is a family and reaches the threshold.
    top = F.array_position("z", F.array_max("z")) - 1
    named = lambda s: ((top != len(names) - 1) & (best_of(temperature) >= s)).cast("double")
    grid = [round(0.3 + 0.05 * i, 2) for i in range(13)]
    gain = lambda s: F.avg(F.when(left_out, -named(s))) + F.avg(F.when(~left_out & (F.col("label") != OTHER), named(s) * (top == F.col("y")).cast("double")))
    gains = asked.agg(*[gain(s).alias(str(i)) for i, s in enumerate(grid)]).first()
    sure = max(zip(gains, grid, strict=True), key=lambda x: (x[0] if x[0] is not None else -math.inf, -x[1]))[1]
    counts, lr = fitted(rows)
    by_gram = lr.coefficientMatrix.toArray().T.round(9).tolist()
    return {"names": names, "weights": dict(zip(counts.vocabulary, by_gram, strict=True)), "intercepts": lr.interceptVector.toArray().tolist(), "temperature": temperature, "sure": sure}


def scored(asked: DataFrame, model: dict, table: DataFrame) -> DataFrame:
    """asked: distinct pieces. piece, family (the best class), probability."""
    names, width = model["names"], len(model["names"])
    hits = asked.select("piece", F.explode(grams(F.col("piece"))).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("piece").agg(F.array(*[F.sum(F.get("w", F.lit(i))) for i in range(width)]).alias("s"))
    zero = F.array(*[F.lit(0.0)] * width)
    z = F.transform(F.zip_with(F.coalesce("s", zero), F.array(*map(F.lit, model["intercepts"])), lambda a, b: a + b), lambda v: v / model["temperature"])
    total = F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("_z")))
    best = F.array_position("_z", F.array_max("_z")).cast("int") - 1
    return asked.join(sums, "piece", "left").withColumn("_z", z).select("piece", F.get(F.array(*map(F.lit, names)), best).alias("family"), (F.lit(1.0) / total).alias("probability"))


def agrees(piece: Column, family: Column, confirm: float) -> Column:
    """Whether a template of the family is in the piece."""
    texts = lambda xs: F.array(*map(F.lit, xs))
    of = F.element_at(F.create_map(*[x for f, ts in TEMPLATES.items() for x in (F.lit(f), F.array(*[texts(template_pairs(t)) for t in ts]))]), family)
    own = F.element_at(F.create_map(*[x for f, ps in own_pairs().items() for x in (F.lit(f), texts(ps))]), family)
    stemmed = F.array(*map(F.lit, dict.fromkeys(p for ts in TEMPLATES.values() for t in ts for p in with_stem(template_pairs(t)))))
    enough = lambda t, p: let(F.array_intersect(t, p), lambda c: (F.size(c) >= confirm * F.size(t)) & F.arrays_overlap(c, stemmed))
    return let(pairs_of(words_of(piece)), lambda p: F.arrays_overlap(own, p) & F.exists(of, lambda t: enough(t, p)))


def scan(docs: DataFrame, sure: float | None = None, confirm: float = 0.6, text_col: str = "text", id_col: str = "doc_id", **training) -> DataFrame:
    """One row per document: doc_id, licences (sorted families), n_paragraphs (with a cue),
    n_unknown (of these, without a family), found (array of piece, family, probability: what was
    confirmed). sure: the threshold, else the calibrated one."""
    typed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(typed, **training)
    least = model["sure"] if sure is None else sure
    spark, text = docs.sparkSession, text_of()
    table = durable(local_table(spark, [{"gram": g, "w": w} for g, w in model["weights"].items()], "gram string, w array<double>"), "licence-weights")
    some = F.when(has_cue(text), paragraphs(text)).otherwise(F.array().cast("array<array<string>>"))
    rows = durable(typed.select(F.monotonically_increasing_id().alias("_row"), "doc_id", some.alias("paragraphs")), "licence-paragraphs")
    each = rows.select("_row", F.posexplode("paragraphs").alias("k", "pieces")).select("_row", "k", F.explode("pieces").alias("piece"))
    named = scored(each.select("piece").distinct(), model, table)
    hits = durable(named.filter((F.col("family") != OTHER) & (F.col("probability") >= least)).filter(agrees(F.col("piece"), F.col("family"), confirm)), "licence-hits")
    known = each.join(hits, "piece")
    by_row = known.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("piece", "family", "probability"))).alias("found"), F.size(F.collect_set("k")).alias("_known"))
    out = rows.join(by_row, "_row", "left").withColumn("found", F.coalesce("found", F.array()))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x.family)))
    return out.select("doc_id", families.alias("licences"), F.size("paragraphs").cast("long").alias("n_paragraphs"), (F.size("paragraphs") - F.coalesce("_known", F.lit(0))).cast("long").alias("n_unknown"), "found")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_paragraphs", "n_unknown")
