"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are one-line notices, the standard headers and the full licence texts in
``license_texts``. Candidate texts of a file are its sentences with a licence marker and
windows of its terms, of several lengths and overlapping by half, that hold a marker; the
terms run over line ends and comment signs, so a wrapped header is met as a whole. A file
that is itself a licence file is scored as a whole, too. Only these are counted, weighted
and compared with the template table.

Document frequencies are counted over all scanned documents. The few terms that one in
``COMMON`` documents has are broadcast; the others meet their frequencies by an equi-join.
A file without a licence of its own takes that of the nearest ancestor directory with a
licence file, found by an equi-join on exploded ancestor paths. All steps are built-in
DataFrame functions.

Defined results: a null or empty text has no licence of its own. A null path has no
directory and inherits nothing. Scores below ``min_score`` are no match. Of equal scores
the licence first in alphabetical order wins. Of several licence files in a directory the
one with the highest score speaks, then the first licence by name.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standscan.session import materialise

#: The notice of the Free Software Foundation and its first sentence.
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details. You should have received a copy of the GNU {n} along with this program. If not, see https://www.gnu.org/licenses/.",
)
GNU_NAMES = (("agpl-3.0", "Affero General Public License", "3"), ("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3.0", "Lesser General Public License", "3"))

#: (licence, text) of one-line notices.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "Copyright. All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: (licence, text) of standard headers of source files.
HEADERS = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(lic, text.format(n=name, v=v)) for lic, name, v in GNU_NAMES for text in (GNU[0], " ".join(GNU))],
)
#: (licence, text) of whole licence files.
FULL_TEXTS = tuple((p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
TEMPLATES = (*NOTICES, *HEADERS, *FULL_TEXTS)
WINDOWS = (16, 32, 64, 128, 256)  # lengths in terms; a template between two of them still covers most of one window
COMMON = 1000
MARKER = r"(?i)licen[sc]|copyright|spdx|public domain|hereby granted|redistribution and use|all rights reserved"
MARKER_ACROSS_LINES = MARKER.replace(" ", "[^a-z0-9]+")
MARKER_OF_TERMS = "(?=[achlprs])(?:" + MARKER.removeprefix("(?i)") + ")"  # terms are in lower case
MARKER_PARTS = ("licen", "copyright", "spdx", "public", "hereby", "redistribution", "rights")  # each match of a marker has one
SENTENCE = r"\n|(?<=[.!?])\s+"
BETWEEN_TERMS = "[^abcdefghijklmnopqrstuvwxyz0123456789.+-]+"  # Java tests listed characters at once, but ranges one by one
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$"


def _terms(text: str) -> list[str]:
    return [t for t in (re.sub(r"^[.+-]+|[.+-]+$", "", t) for t in re.split(BETWEEN_TERMS, text.lower())) if t]


def _idf(n_docs: Column, n_with: Column) -> Column:
    return F.log((n_docs + 1) / (n_with + 1)) + 1


def _template_weights(idf: dict[str, float], unseen: float) -> dict[str, list[float]]:
    """Per term its unit weight in each template."""
    texts = [Counter(_terms(t)) for _, t in TEMPLATES]
    norms = [math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in words.items())) for words in texts]
    return {t: [words[t] * idf.get(t, unseen) / norm for words, norm in zip(texts, norms, strict=True)] for t in sorted(set().union(*texts))}


def _split_terms(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(F.lower(text), BETWEEN_TERMS), lambda t: F.btrim(t, F.lit(".+-"))), "")


def _may_have_marker(text: Column) -> Column:
    """Whether a text has a part of a marker: false for most texts, which regular expressions need not search then."""
    return functools.reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in MARKER_PARTS])


def _marked_windows(terms: Column) -> Column:
    """Windows of each length with a marker; a text that one window holds needs no longer ones."""
    found = []
    for size in WINDOWS:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(terms) - size // 2), F.lit(size // 2))
        fits = F.when(F.size(terms) > (size // 2 if size > WINDOWS[0] else 0), starts).otherwise(F.array().cast("array<int>"))
        found.append(F.filter(F.transform(fits, lambda s, size=size: F.slice(terms, s, size)), lambda w: F.array_join(w, " ").rlike(MARKER_OF_TERMS)))
    return F.concat(*found)


def _counts(run: Column) -> Column:
    """Distinct terms with their counts: the lengths of the runs in sorted terms.

    ``run`` must be a column of the input, as lambdas evaluate an expression once an element.
    """
    firsts = F.filter(F.sequence(F.lit(0), F.size(run) - 1), lambda i: (i == 0) | (F.get(run, i) != F.get(run, i - 1)))
    ends = F.concat(F.slice(firsts, F.lit(2), F.size(firsts)), F.array(F.size(run)))
    return F.zip_with(firsts, ends, lambda a, b: F.struct(F.get(run, a).alias("term"), (b - a).alias("tf")))


def document_frequencies(texts: DataFrame, text: Column) -> tuple[DataFrame, int]:
    """``(term, df)`` over all rows, and the number of rows."""
    terms = texts.select(F.explode(F.array_distinct(_split_terms(text))).alias("term"))
    return materialise(terms.groupBy("term").agg(F.count("*").alias("df")), "license-terms"), texts.count()


def score_texts(candidates: DataFrame, frequencies: DataFrame, n_docs: int, min_score: float) -> DataFrame:
    """``(ss_row, license, score, o)`` from ``(ss_row, ss_part, ss_terms)``: each row's best match."""
    spark: SparkSession = candidates.sparkSession
    names = [f"t{i}" for i in range(len(TEMPLATES))]
    unseen = math.log(1 + n_docs) + 1
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for _, text in TEMPLATES for t in _terms(text)})], "term string")
    known = frequencies.withColumn("idf", _idf(F.lit(n_docs), F.col("df")))
    idf = {r["term"]: r["idf"] for r in known.join(F.broadcast(vocabulary), "term").select("term", "idf").collect()}
    weights = _template_weights(idf, unseen)
    table = spark.createDataFrame([(t, idf.get(t, unseen), *w) for t, w in weights.items()], "term string, t_idf double, " + ", ".join(f"{n} double" for n in names))
    outside = known.join(F.broadcast(vocabulary), "term", "left_anti")
    common = outside.where(F.col("df") > n_docs // COMMON).select("term", F.col("idf").alias("c_idf"))
    rare = outside.where(F.col("df") <= n_docs // COMMON).select("term", F.col("idf").alias("r_idf"))
    counted = candidates.where(F.size("ss_terms") > 0).select("ss_row", "ss_part", F.sort_array("ss_terms").alias("ss_run")).select("ss_row", "ss_part", F.explode(_counts(F.col("ss_run"))).alias("c")).select("ss_row", "ss_part", "c.term", "c.tf")
    counted = materialise(counted, "license-counts")  # read twice
    counted = counted.join(F.broadcast(table), "term", "left").join(F.broadcast(common), "term", "left").withColumn("near_idf", F.coalesce("t_idf", "c_idf"))
    square = lambda idf: F.sum(F.pow(F.col("tf") * F.col(idf), F.lit(2.0)))
    dots = counted.groupBy("ss_row", "ss_part").agg(F.coalesce(square("near_idf"), F.lit(0.0)).alias("near"), *[F.coalesce(F.sum(F.col("tf") * F.col("near_idf") * F.col(n)), F.lit(0.0)).alias(n) for n in names])
    far = counted.where("near_idf is null").select("ss_row", "ss_part", "term", "tf").join(rare, "term").groupBy("ss_row", "ss_part").agg(square("r_idf").alias("far"))
    dots = dots.join(far, ["ss_row", "ss_part"], "left").withColumn("norm", F.sqrt(F.col("near") + F.coalesce("far", F.lit(0.0))))
    order = {lic: i for i, lic in enumerate(sorted({lic for lic, _ in TEMPLATES}))}
    best = F.array_max(F.array(*[F.struct(F.round(F.col(n) / F.col("norm"), 9).alias("score"), F.lit(-order[lic]).alias("o"), F.lit(lic).alias("license")) for n, (lic, _) in zip(names, TEMPLATES, strict=True)]))
    return dots.select("ss_row", best.alias("b")).groupBy("ss_row").agg(F.max("b").alias("b")).where(F.col("b.score") >= min_score).select("ss_row", "b.license", "b.score", "b.o")


def scan(files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text", min_score: float = 0.6) -> DataFrame:
    """``(id, path, own_license, own_score, license, inherited_from)`` for every row of ``files``."""
    t = F.coalesce(F.col(text), F.lit(""))
    is_file = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    maybe = _may_have_marker(t)
    marked = F.when(maybe & t.rlike(MARKER), F.filter(F.split(t, SENTENCE), lambda s: s.rlike(MARKER))).otherwise(F.array().cast("array<string>"))
    nothing = F.array().cast("array<array<string>>")
    base = materialise(
        files.select(
            F.monotonically_increasing_id().alias("ss_row"),
            F.col(id_col).alias("ss_id"),
            F.col(path).alias("ss_path"),
            F.when(F.instr(F.col(path), "/") > 0, F.regexp_replace(F.col(path), r"/[^/]*$", "")).when(F.col(path).isNotNull(), "").alias("ss_dir"),
            is_file.alias("ss_is_file"),
            marked.alias("ss_marked"),
            F.when(is_file | (maybe & t.rlike(MARKER_ACROSS_LINES)), t).alias("ss_text"),
        ),
        "license-files",
    )
    frequencies, n_docs = document_frequencies(files, t)
    split = base.where("ss_text is not null or size(ss_marked) > 0").select("ss_row", "ss_is_file", F.transform("ss_marked", _split_terms).alias("ss_sentences"), _split_terms(F.coalesce("ss_text", F.lit(""))).alias("ss_whole"))
    whole = F.col("ss_whole")
    parts = F.concat("ss_sentences", _marked_windows(whole), F.when(F.col("ss_is_file"), F.array(whole)).otherwise(nothing))
    found = score_texts(split.select("ss_row", F.posexplode(parts).alias("ss_part", "ss_terms")), frequencies, n_docs, min_score)
    own = materialise(base.select("ss_row", "ss_id", "ss_path", "ss_dir", "ss_is_file").join(found, "ss_row", "left"), "license-own")
    order = F.struct("score", "o", "license")
    spoken = own.where("ss_is_file and license is not null and ss_dir is not null").groupBy(F.col("ss_dir").alias("ss_up")).agg(F.max(order).alias("b")).select("ss_up", F.col("b.license").alias("up_license"))
    dirs = own.where("license is null and ss_dir is not null").select("ss_dir").distinct()
    parts = F.split("ss_dir", "/")
    ups = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))
    climbed = dirs.select("ss_dir", F.explode(F.array_distinct(ups)).alias("ss_up")).join(spoken, "ss_up")
    nearest = materialise(climbed.groupBy("ss_dir").agg(F.max(F.struct(F.char_length("ss_up").alias("n"), "ss_up", "up_license")).alias("b")).select("ss_dir", "b.ss_up", "b.up_license"), "license-dirs")
    return own.join(nearest, "ss_dir", "left").select(
        F.col("ss_id").alias(id_col),
        F.col("ss_path").alias(path),
        F.col("license").alias("own_license"),
        F.col("score").alias("own_score"),
        F.coalesce("license", "up_license").alias("license"),
        F.when(F.col("license").isNull(), F.col("ss_up")).alias("inherited_from"),
    )


def corpus_paths(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lay the flat table out as a tree: shelves of 10,000 ids, boxes of 100, folders by source.

    The first document of a shelf or box is its licence file. A null id has no path.
    """
    n = F.col(id_col)
    shelf = F.concat(F.lit("c"), F.expr(f"`{id_col}` div 10000"))
    box = F.concat(shelf, F.lit("/b"), F.expr(f"`{id_col}` div 100"))
    path = (
        F.when(n % 10000 == 0, F.concat(shelf, F.lit("/LICENSE")))
        .when(n % 100 == 0, F.concat(box, F.lit("/LICENSE")))
        .otherwise(F.concat(box, F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), n.cast("string"), F.lit(".txt")))
    )
    return docs.select(n.alias(id_col), path.alias("path"), "text")
