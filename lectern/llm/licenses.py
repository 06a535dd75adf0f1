"""License scans: TF-IDF cosine to templates, then inheritance from the nearest licensed ancestor directory.

A file's units are its lines, the whole file, and windows of words, whatever lines they run over: a window lies where a
template would lie by one of its anchors (a word that stands once in it, one for each quarter) and is as long as the
template. So headers in several lines, notices inside a line and texts inside a longer file are found. Each unit is
compared with every template as a sparse TF-IDF vector; words that no template has weigh most and so pull a unit of other
text away. The best template of cosine at least COSINE is the unit's license; a file's own license is that of its best
unit, a reservation of all rights only if no unit has another: it stands in many a license's copyright line.

Of the long licenses (Apache, CC0, GPL, LGPL, MPL) the templates are the headers, and title and opening passage of the text.

Most units needn't be compared. By the Cauchy-Schwarz inequality a unit without any of a template's cue words reaches at
most the norm of that template's other words; the cues are its heaviest words, as many as bring that norm below the
threshold. One regular expression finds the units with a cue.

A license file speaks for its directory: one named like LICENSE or COPYING, or one of which license units make up at
least half the words, each counted once. Files without a license of their own take that of the nearest directory above, by a join of
directories; several license files of a directory: the greatest cosine, then the first license by code point.

Everything is done with DataFrame expressions. Whole texts are read, only labels and directories are shuffled.

Defined results: a null or empty text has no license of its own; a null path lies in no directory and inherits nothing;
cosines count to nine decimals, ties go to the first license by code point; repeated rows are judged alike; no rows give
none. Other columns are passed through, but for those that bear the name of a result (license, cosine, origin, from_dir).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, sent_by_width
from lectern.llm.license_texts import TEXTS

COSINE, FILE_SHARE = 0.8, 0.5
#: Notices as they stand in files and on pages, and the texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    *TEXTS,
)
#: Reserves rights and gives none.
RESERVED = "Proprietary"
QUARTERS = 4
WORD = r"[a-z0-9]+"
#: Words of ordinary text are cues last: any choice of cues is right, but these would let most lines through.
ORDINARY = frozenset(
    "0 1 2 3 4 5 a all also an and any anyone are as at be been but by can certain change deal do each except following for from has have how if in into is it its make may mean means mit more must name names neither no "
    "nor not of on one only or other our owner person persons such so some than that the their them these they this those to under upon use used using v was way we when where whether which who whom whose will with without work works you your".split()
)
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"


class Templates:
    """Weights of the templates' words, and the words without which nothing reaches the threshold."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, cosine: float = COSINE):
        bags = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
        n = len(bags)
        df = Counter(w for b in bags for w in b)
        self.labels = [label for label, _ in templates]
        self.idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in sorted(df.items())}
        #: Of words that no template has.
        self.other = math.log(n + 1) + 1
        self.vectors = []
        self.cues: set[str] = set()
        #: Of a word: where it stands in a template, and how long the template is.
        self.anchors: dict[str, set[tuple[int, int]]] = {}
        for (_, text), b in zip(templates, bags, strict=True):
            words = re.findall(WORD, text.lower())
            for q in range(QUARTERS):
                own = [(-self.idf[w], i) for i, w in enumerate(words) if i * QUARTERS // len(words) == q and b[w] == 1 and w not in ORDINARY]
                if own:
                    self.anchors.setdefault(words[min(own)[1]], set()).add((min(own)[1], len(words)))
            v = {w: c * self.idf[w] for w, c in sorted(b.items())}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append(v)
            rest = sorted(v, key=lambda w: (w in ORDINARY, -v[w], w))
            # a cue less than needed would let a unit without cues reach the threshold
            while rest and math.sqrt(sum(v[w] ** 2 for w in rest)) >= cosine - 1e-9:
                self.cues.add(rest.pop(0))

    @property
    def cue_pattern(self) -> str:
        # by first letters, so that few branches are tried at a word
        first = sorted({w[0] for w in self.cues})
        return r"(?<![a-z0-9])(?=[" + "".join(first) + r"])(?:" + "|".join(f"{x}(?:{'|'.join(sorted(w[1:] for w in self.cues if w[0] == x))})" for x in first) + r")(?![a-z0-9])"


def _scores(words: Column, t: Templates) -> Column:
    """Array of (cosine, label) of a unit's words with every template."""
    vocabulary = sorted(t.idf)
    numbers = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    table = F.expr("map(" + ", ".join(f"'{w}', {numbers([v.get(w, 0.0) * t.idf[w] for v in t.vectors])}" for w in vocabulary) + ")")
    idf = F.expr("map(" + ", ".join(f"'{w}', {t.idf[w]!r}D" for w in vocabulary) + ")")
    run = lambda a: F.pow(a["run"] * F.coalesce(idf[a["word"]], F.lit(t.other)), F.lit(2.0))

    def one(ordered: Column) -> Column:
        # every occurrence of a word adds its weight to the products; equal words stand together, so their counts are runs
        start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("norm"), F.expr(numbers([0.0] * len(t.vectors))).alias("dots"))

        def add(a: Column, w: Column) -> Column:
            same = a["word"] == w
            dots = F.coalesce(F.zip_with(a["dots"], table[w], lambda x, y: x + y), a["dots"])
            return F.struct(w.alias("word"), F.when(same, a["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, a["norm"]).otherwise(a["norm"] + run(a)).alias("norm"), dots.alias("dots"))

        total = F.aggregate(ordered, start, add, lambda a: F.struct(F.sqrt(a["norm"] + run(a)).alias("norm"), a["dots"].alias("dots")))
        labels = F.array(*(F.lit(x) for x in t.labels))
        return F.transform(F.array(total), lambda u: F.zip_with(u["dots"], labels, lambda d, x: F.struct(F.when(u["norm"] > 0, F.round(d / u["norm"], 9)).otherwise(0.0).alias("cosine"), x.alias("label"))))[0]

    # through an array of one, so that the sorting is done once
    return F.transform(F.array(F.sort_array(words)), one)[0]


def _best(found: Column) -> Column:
    """The greatest cosine, then the first label."""
    return F.reduce(found, F.lit(None).cast("struct<cosine:double,label:string>"), lambda a, x: F.when(a.isNull() | (x["cosine"] > a["cosine"]) | ((x["cosine"] == a["cosine"]) & (x["label"] < a["label"])), F.struct(x["cosine"].alias("cosine"), x["label"].alias("label"))).otherwise(a))


def own_licenses(files: DataFrame, text: str = "text", cosine: float = COSINE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The files with own (cosine, label; null if none) and license_share (of their words, in license lines)."""
    t = Templates(templates, cosine)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has_cue = lambda c: c.rlike(t.cue_pattern)
    words = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    split = F.split(low, r"\r?\n")
    numbered = F.filter(F.transform(split, lambda x, i: F.struct(F.when(has_cue(x), x).alias("text"), i.alias("line"))), lambda x: x["text"].isNotNull())
    marked = files.withColumn("_lines", F.when(has_cue(low), numbered).otherwise(none("struct<text:string,line:int>")))
    marked = marked.withColumn("_words", F.when(F.size("_lines") > 0, words(low)).otherwise(none("string")))
    marked = marked.withColumn("_n", F.size("_words"))
    unit = "struct<words:array<string>,line:int,start:int>"
    lines = F.transform("_lines", lambda x: F.struct(words(x["text"]).alias("words"), x["line"].alias("line"), F.lit(0).alias("start")))
    whole = F.when(F.col("_n") > 0, F.array(F.struct(F.col("_words").alias("words"), F.lit(-1).alias("line"), F.lit(0).alias("start"))))
    windows = F.transform(_windows(F.col("_words"), t), lambda x: F.struct(F.slice("_words", x["start"] + 1, x["len"]).alias("words"), F.lit(-1).alias("line"), x["start"].alias("start")))
    units = F.concat(lines.cast(f"array<{unit}>"), F.coalesce(whole.cast(f"array<{unit}>"), none(unit)), windows.cast(f"array<{unit}>"))
    judged = marked.withColumn("_units", F.transform(units, lambda u: F.struct(F.size(u["words"]).alias("n"), u["line"].alias("line"), u["start"].alias("start"), _best(_scores(u["words"], t)).alias("best"))))
    hits = F.filter(F.col("_units"), lambda u: u["best"]["cosine"] >= cosine)
    # a line begins after the words of the lines before it: one running sum over all lines, not one for each hit
    sums = F.aggregate(F.transform(split, lambda x: F.size(words(x))), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    before = lambda u: F.when(u["line"] >= 0, F.get(F.col("_until"), u["line"])).otherwise(u["start"])
    places = F.transform("_hits", lambda u: F.transform(F.array(before(u)), lambda at: F.sequence(at, at + u["n"] - 1))[0])
    judged = judged.withColumn("_hits", hits).withColumn("_until", F.when(F.size("_hits") > 0, sums))
    counted = judged.withColumn("license_share", F.when(F.size("_hits") > 0, F.size(F.array_distinct(F.flatten(places))) / F.col("_n")).otherwise(0.0))
    first = F.array_min(F.transform("_hits", lambda u: F.struct((u["best"]["label"] == RESERVED).alias("reserved"), (-u["best"]["cosine"]).alias("c"), u["best"]["label"].alias("label"))))
    own = F.transform(F.array(first), lambda x: F.when(x.isNotNull(), F.struct((-x["c"]).alias("cosine"), x["label"].alias("label"))))[0]
    return counted.withColumn("own", own).drop("_lines", "_words", "_n", "_units", "_hits", "_until")


def _windows(words: Column, t: Templates) -> Column:
    """Array of (start, len): where templates would lie among the words by their anchors."""
    places = lambda xs: "array(" + ", ".join(f"named_struct('at', {at}, 'len', {n})" for at, n in sorted(xs)) + ")"
    anchors = F.expr("map(" + ", ".join(f"'{w}', {places(t.anchors[w])}" for w in sorted(t.anchors)) + ")")
    found = F.transform(words, lambda w, i: F.transform(anchors[w], lambda a: F.struct(F.greatest(i - a["at"], F.lit(0)).alias("start"), a["len"].alias("len"))))
    return F.array_distinct(F.flatten(F.filter(found, lambda x: x.isNotNull())))


def directories(path: Column) -> Column:
    """The directories above a path, nearest first, `` the root."""
    steps = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def scan(files: DataFrame, path: str = "path", text: str = "text", cosine: float = COSINE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The files, without their text, with license, cosine, origin (own, inherited or null) and from_dir (if inherited)."""
    rest = [c for c in files.columns if c != text]
    judged = own_licenses(files.select(F.struct(*(files[c] for c in rest)).alias("row"), files[path].cast("string").alias("path"), files[text].cast("string").alias("text")), "text", cosine, templates)
    found = cut(judged.select("row", "path", "own", "license_share"))  # texts are read once
    above = directories(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    with_dir = found.withColumn("dir", above[0])
    speaks = with_dir.where(F.col("own").isNotNull() & F.col("dir").isNotNull() & (name.rlike(FILE_NAME) | (F.col("license_share") >= FILE_SHARE)))
    order = F.struct((-F.col("own.cosine")).alias("c"), F.col("own.label").alias("l"))
    licensed = speaks.groupBy("dir").agg(F.min_by("own", order).alias("given"))
    # directories, not files, look for their ancestors
    bare = with_dir.where(F.col("own").isNull()).select("path", "dir").where("dir is not null").groupBy("dir").agg(F.first("path").alias("path"))
    steps = bare.select("dir", F.posexplode(above).alias("up", "over"))
    near = cut(steps.join(licensed.withColumnRenamed("dir", "over"), "over").groupBy("dir").agg(F.min_by(F.struct("over", "given"), "up").alias("from")))
    # a row for each directory; if they are too many to be sent, a directory of very many files is still one key
    both = with_dir.join(sent_by_width(near), "dir", "left")
    label = F.coalesce(F.col("own.label"), F.col("from.given.label"))
    origin = F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("from").isNotNull(), F.lit("inherited"))
    extra = {"license": label, "cosine": F.coalesce(F.col("own.cosine"), F.col("from.given.cosine")), "origin": origin, "from_dir": F.when(F.col("own").isNull(), F.col("from.over"))}
    return both.select(*(F.col("row")[c].alias(c) for c in rest if c not in extra), *(v.alias(k) for k, v in extra.items()))
