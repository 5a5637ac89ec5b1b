"""License scans: Dice coefficient over word bigrams between license templates and the lines
of a text, the text as a whole, and its passages.

Normal form: lower case, runs of other characters than letters a-z and digits as one space.
With sets A of the unit and B of a template, Dice >= t needs |A| between t/(2-t)*|B| and
(2-t)/t*|B|; templates outside these size bounds are no candidates. It also needs t/(2-t)*|B|
shared bigrams, so a text without any word of a small set, chosen so that the bigrams holding
one leave too few others in every template, can't match and is skipped before it is split.

Passages are all windows of up to 1.5 times a template's words, over the ends of lines, within the
size bounds; they are compared with the notices and with the whole texts of license_texts. Of
overlapping passages the one that shares most bigrams counts (then the highest Dice). Only
texts that share t/(2-t)*|B| bigrams with a template are searched for its passages. A license that
lines and passages show counts the greater number of the two.

Defined results: null and empty texts match nothing; repeated rows give one finding per
doc_id and license; rows that share a doc_id but not a text are scanned apart and counted
together; a null doc_id has findings like any other; a unit counts for the license of its nearest
template, or for all equally near ones; extra columns are ignored. Templates are a parameter: a
list of (license, text), or a table with these columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.session import spread

from . import common
from .license_texts import TEXTS

THRESHOLD = 0.8
#: Up to so many template bigrams are broadcast; more are joined by a shuffle.
BROADCAST_BIGRAMS = 500_000
# Short notices and the first words of well-known license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
COMMON = {"the", "of", "a", "and", "to", "is", "in", "or", "by", "any", "this", "under", "for", "with", "use", "you", "may", "not", "are", "that"}


def normal(text: Column, keep_lines: bool = False) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+" if keep_lines else r"[^a-z0-9]+", " ")


def _bigrams(text: str) -> set[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def marker_words(templates, threshold: float) -> list[str]:
    """Words such that a unit reaching the threshold for any template holds one of them."""
    need = []
    for _, text in templates:
        b = _bigrams(text)
        need.append([b, len(b) - math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) + 1])
    chosen: list[str] = []
    while any(n > 0 for _, n in need):
        gain: dict[str, int] = {}
        for b, n in need:
            if n > 0:
                for w, k in Counter(w for x in b for w in set(x.split())).items():
                    gain[w] = gain.get(w, 0) + min(n, k)
        word = max(gain, key=lambda w: (w not in COMMON and not w.isdigit(), gain[w], w))
        chosen.append(word)
        for entry in need:
            held = {x for x in entry[0] if word in x.split()}
            entry[0], entry[1] = entry[0] - held, entry[1] - len(held)
    return chosen


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = [(i, name, len(b), x) for i, (name, text) in enumerate(templates) for b in [_bigrams(text)] for x in sorted(b)]
    return spark.createDataFrame(rows, "template int, license string, template_size int, bigram string")


def _marked(templates, threshold: float) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(sorted(marker_words(templates, threshold))) + ")(?![a-z0-9])"


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def passages(docs: DataFrame, templates, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice and lines (passages of different words) of the windows that match."""
    spark, low, high = docs.sparkSession, threshold / (2 - threshold), (2 - threshold) / threshold
    known = template_table(spark, templates)
    small = known.select("bigram").distinct().count() <= BROADCAST_BIGRAMS
    hint = F.broadcast if small else lambda x: x
    texts = docs.select("doc_id", F.lower("text").alias("text")).where(F.col("text").rlike(_marked(templates, threshold)))
    texts = texts.withColumn("h", F.xxhash64("text"))
    pairs = _pairs(F.filter(F.split(normal(F.col("text")), " "), lambda x: x != ""))
    # texts that share enough with a template as a whole
    shared = texts.select("doc_id", "h", F.explode(F.array_distinct(pairs)).alias("bigram")).join(hint(known), "bigram")
    shared = shared.groupBy("doc_id", "h", "template", "license", "template_size").agg(F.count_distinct("bigram").alias("n")).where(F.col("n") >= F.col("template_size") * low - 1e-9)
    fits = shared.groupBy("doc_id", "h").agg(F.collect_list(F.struct("template", "license", "template_size")).alias("near"))
    fits = common.small(common.written(fits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "near"), "license-fits"))
    texts = texts.join(fits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).dropDuplicates(["doc_id", "h"])
    # each bigram with the place where it last stood and the templates that hold it
    marks = known.groupBy("bigram").agg(F.collect_set("template").alias("of"))
    places = texts.select("doc_id", "h", F.posexplode(pairs).alias("at", "bigram"))
    places = places.withColumn("last", F.coalesce(F.lag("at").over(Window.partitionBy("doc_id", "h", "bigram").orderBy("at")), F.lit(-1))).join(hint(marks), "bigram", "left")
    rows = places.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("at", "last", "bigram", F.coalesce("of", F.array().cast("array<int>")).alias("of")))).alias("seq"))
    near = fits.select("d", "g", F.explode("near").alias("t"))
    rows = rows.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "seq", "t.template", "t.license", "t.template_size")
    size = F.col("template_size")
    words = F.element_at(F.create_map(*(F.lit(x) for i, (_, text) in enumerate(templates) for x in (i, math.ceil(1.5 * len(re.findall("[a-z0-9]+", text.lower())))))), F.col("template"))

    def best(s: Column) -> Column:
        """The window from s on of highest Dice: its last place, shared bigrams, Dice."""

        def step(acc: Column, x: Column) -> Column:
            new = x["last"] < s["at"]
            n, k = acc["n"] + F.when(new, 1).otherwise(0), acc["k"] + F.when(new & F.array_contains(x["of"], F.col("template")), 1).otherwise(0)
            dice = 2.0 * k / (n + size)
            better = (dice > acc["dice"]) & (n >= size * low - 1e-9) & (n <= size * high + 1e-9)
            return F.struct(n.alias("n"), k.alias("k"), F.when(better, x["at"]).otherwise(acc["end"]).alias("end"), F.when(better, k).otherwise(acc["shared"]).alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(-1).alias("end"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"))
        return F.aggregate(F.slice(F.col("seq"), s["at"] + 1, words), zero, step)

    starts = F.filter("seq", lambda x: F.array_contains(x["of"], F.col("template")))
    found = rows.select("doc_id", "h", "license", F.explode(F.transform(starts, lambda s: F.struct(s["at"].alias("at"), best(s).alias("b"), F.lit(0).alias("z")))).alias("x"), "seq").where(F.col("x.b.dice") >= threshold)
    found = found.select("doc_id", "h", "license", F.col("x.at").alias("at"), F.col("x.b.end").alias("end"), F.struct(F.col("x.b.shared").alias("shared"), F.round("x.b.dice", 6).alias("dice")).alias("rank"), F.xxhash64(F.transform(F.slice("seq", F.col("x.at") + 1, F.col("x.b.end") - F.col("x.at") + 1), lambda y: y["bigram"])).alias("words"))
    # a passage counts where no place of it lies in one that ranks higher (of equal ones of a
    # license, the first)
    key = ["doc_id", "h", "license", "at", "end", "rank", "words"]
    dealt = found.select(*key, F.explode(F.sequence("at", "end")).alias("place"), F.struct("rank", -F.col("at"), -F.col("end")).alias("own"))
    top, first = Window.partitionBy("doc_id", "h", "place"), Window.partitionBy("doc_id", "h", "place", "license")
    dealt = dealt.withColumn("keep", (F.col("rank") == F.max("rank").over(top)) & (F.col("own") == F.max("own").over(first)))
    held = dealt.groupBy(*key).agg(F.bool_and("keep").alias("keep")).where("keep")
    return held.groupBy("doc_id", "license").agg(F.max("rank.dice").alias("dice"), F.count_distinct("words").alias("lines"))


def listed(templates) -> list[tuple[str, str]]:
    """Templates as a list. A table of them is read whole: license lists have some hundred texts."""
    if isinstance(templates, DataFrame):
        templates = [(r["license"], r["text"]) for r in templates.select("license", "text").orderBy("license", "text").collect()]
    return [(name, text) for name, text in templates if name and _bigrams(text or "")]


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, texts=TEXTS) -> DataFrame:
    """doc_id, license, dice (rounded to 6 places) and lines (units that match), a row for
    each license found in a document. `templates` (notices) are compared with lines, texts as a
    whole and passages, `texts` (whole license texts) with passages."""
    templates, texts = listed(templates), listed(texts)
    if not templates:
        raise ValueError("no template holds two words")
    docs = spread(docs.select("doc_id", "text"))
    both = _lines(docs, templates, threshold).unionByName(passages(docs, [*templates, *texts], threshold))
    return both.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.max("lines").alias("lines"))


def _lines(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """The findings of whole lines and whole texts."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    known = F.broadcast(known) if sum(len(_bigrams(t)) for _, t in templates) <= BROADCAST_BIGRAMS else known
    marked = _marked(templates, threshold)
    texts = docs.select("doc_id", F.lower("text").alias("text")).where(F.col("text").rlike(marked))
    # rows are told apart by their text: equal doc_ids don't pool their words
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), normal(F.col("text"), keep_lines=True).alias("text"))
    # the whole text is a unit besides its lines; with one line they are the same
    units = texts.select("doc_id", "h", F.posexplode(F.array_distinct(F.transform(F.concat(F.array(F.regexp_replace("text", r"\n", " ")), F.split("text", "\n")), lambda x: F.trim(F.regexp_replace(x, " +", " "))))).alias("unit", "line")).where(F.col("line").rlike(marked))
    words = F.filter(F.split("line", " +"), lambda w: w != "")
    units = units.select("doc_id", "h", "unit", words.alias("w")).where(F.size("w") > 1)
    pairs = F.array_distinct(_pairs(F.col("w")))
    units = units.select("doc_id", "h", "unit", pairs.alias("b")).withColumn("unit_size", F.size("b"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(_bigrams(t)) for _, t in templates] or [0]
    units = units.where((F.col("unit_size") >= math.floor(low * min(sizes))) & (F.col("unit_size") <= math.ceil(high * max(sizes))))
    grams = units.select("doc_id", "h", "unit", "unit_size", F.explode("b").alias("bigram"))
    fits = (F.col("unit_size") >= F.col("template_size") * low - 1e-9) & (F.col("unit_size") <= F.col("template_size") * high + 1e-9)
    shared = grams.join(known, "bigram").where(fits).groupBy("doc_id", "h", "unit", "unit_size", "template", "license", "template_size").agg(F.count_distinct("bigram").alias("shared"))
    dice = 2.0 * F.col("shared") / (F.col("unit_size") + F.col("template_size"))
    found = shared.withColumn("dice", F.round(dice, 6)).where(dice >= threshold)
    # a unit speaks for the template it is nearest to, or for each of several equally near
    near = found.groupBy("doc_id", "h", "unit").agg(F.collect_list(F.struct("dice", "license")).alias("all"), F.max("dice").alias("dice"))
    found = near.select("doc_id", "h", "unit", "dice", F.explode(F.array_distinct(F.transform(F.filter("all", lambda x: x["dice"] == F.col("dice")), lambda x: x["license"]))).alias("license"))
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("h", "unit").alias("lines"))
