"""Licence detection by sparse TF-IDF cosine, and inheritance along directories.

Of a document with a licence cue the passages that hold one are compared: its lines, its
paragraphs and comment blocks (wrapped lines joined, comment marks taken off), their
sentences, words around a cue in a sentence that is too long, and the whole text. Passages and
licence templates become sparse term vectors (term counts times inverse document frequency
over all distinct passages of the corpus and all templates); a passage has the licence of its
most similar template when their cosine reaches ``threshold``, and the document has that of
its best passage. A document is a licence file if it has a licence and is named like one
(``FILE_NAME``), or if its whole text is one, however long: it stands for its directory, and
every document without a licence of its own inherits from the nearest ancestor directory
that has one.

Scale: whole texts are scanned in place; only documents with a cue go on, and their passages
collapse to distinct ones map-side, so one that a third of all documents carry is compared
once. Similarity is an equi-join on terms with the templates' few terms. Inheritance is
resolved per directory, each emitting its ancestors into an equi-join; documents then look up
their directory in a left join that AQE may split.

Defined results: NULL and blank texts have no notice; a passage below the threshold is none;
equal cosines go to the first passage (lines, then paragraphs, sentences, words around a cue,
the whole text), then to the alphabetically first licence; of a directory's licence files the
most similar decides, then the alphabetically first licence; a NULL path has no ancestors;
repeated rows are judged alike; with no templates nothing is licensed; an empty table gives no
rows; results replace columns of their name, others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.binding import let
from pulseframe.llm.common import lower_ascii, written

# Public notices and short full texts of well-known licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES = [
    ("MIT", MIT), ("BSD-3-Clause", BSD), ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
CUE = r"(?i)licen[cs]e|permission is hereby granted|permission to use, copy|redistribution and use|spdx-"
CUE_WORD = r"(?i)licen[cs]e|permission|redistribution|spdx-"
FILE_NAME = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[._-].*)?$"
THRESHOLD = 0.7
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)?[ \t]*"  # what opens a line of a comment
LONG_SENTENCE = 30  # words, beyond which the words around a cue are looked at too
AROUND = ((4, 0), (0, 8), (5, 5), (15, 15))  # words before and after


def terms(text: Column) -> Column:
    """Lower-case terms of letters, digits and inner points (``2.0``)."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def template_table(spark) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def passages(text: Column) -> Column:
    """The passages with a cue, as (rank, text, whole); none of a text without one."""
    has_cue = lambda x: F.rlike(x, F.lit(CUE))
    joined = lambda x: F.trim(F.regexp_replace(x, r"[\n\r\t ]+", " "))

    def around(sentence: Column) -> Column:
        def windows(words: Column) -> Column:
            place = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.rlike(F.get(words, i - 1), F.lit(CUE_WORD)))
            window = lambda b, a: lambda i: F.array_join(F.slice(words, F.greatest(i - b, F.lit(1)), F.least(i, F.lit(b + 1)) + a), " ")
            parts = [F.transform(place, window(before, after)) for before, after in AROUND]
            return F.when(F.size(words) > LONG_SENTENCE, F.concat(*parts)).otherwise(F.array().cast("array<string>"))

        return let(F.split(sentence, " "), windows)

    def of_blocks(blocks: Column) -> Column:
        sentences = F.flatten(F.transform(blocks, lambda p: F.filter(F.split(F.regexp_replace(p, "([.!?;:]) ", "$1\n"), "\n"), has_cue)))
        return let(sentences, lambda s: F.concat(blocks, s, F.flatten(F.transform(s, around))))

    def of_clean(clean: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), F.trim), has_cue)
        blocks = F.filter(F.transform(F.split(clean, r"\n[ \t\r]*\n"), joined), has_cue)
        return F.concat(lines, let(blocks, of_blocks), F.array(joined(clean)))

    found = let(F.regexp_replace(text, MARKS, "$1"), of_clean)
    ranked = let(found, lambda f: F.transform(f, lambda t, i: F.struct(i.alias("rank"), t.alias("text"), (i == F.size(f) - 1).alias("whole"))))
    return F.when(has_cue(text), ranked).otherwise(F.array().cast("array<struct<rank:int,text:string,whole:boolean>>"))


def _vectors(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, weight) with weights of unit length."""
    counts = rows.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").count()
    weighted = counts.join(idf, "term").select(key, "term", (F.col("count") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def classify(notices: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, cosine) of the distinct ``notices`` (key, text) that have a licence."""
    models = templates.select(F.md5(F.concat_ws("|", "license", "text")).alias("t"), "license", "text").dropDuplicates(["t"])
    distinct = written(notices.groupBy("key").agg(F.first("text").alias("text")), "notices")
    both = distinct.select(F.col("key").alias("d"), "text").union(models.select(F.col("t").alias("d"), "text"))
    size = F.lit(both.count())
    idf = both.select("d", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").count()
    idf = written(idf.select("term", (F.log((1 + size) / (1 + F.col("count"))) + 1).alias("idf")), "idf")
    left, right = _vectors(distinct, "key", idf), _vectors(models, "t", idf).withColumnRenamed("weight", "t_weight")
    cosines = left.join(right, "term").groupBy("key", "t").agg(F.sum(F.col("weight") * F.col("t_weight")).alias("cosine"))
    cosines = cosines.where(F.col("cosine") >= threshold).join(models.select("t", "license"), "t")
    rounded = F.round("cosine", 6)  # sums of a task-dependent order differ in the last bits
    best = cosines.groupBy("key").agg(F.min(F.struct((-rounded).alias("far"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.far")).alias("cosine"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as (depth, directory)."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))


def inherit(directories: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, license, origin) of the directories with a licence file in or above them.

    ``files`` has (directory, license, cosine) of licence files.
    """
    own = files.groupBy(F.col("directory").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("far"), "license")).alias("b"))
    own = own.select("above", F.col("b.license").alias("license"))
    rows = directories.select("directory").distinct().where("directory IS NOT NULL")
    rows = rows.select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.*")
    nearest = rows.join(own, "above").groupBy("directory").agg(F.max(F.struct("depth", F.col("above").alias("origin"), "license")).alias("n"))
    return nearest.select("directory", "n.license", "n.origin")


def scan(docs: DataFrame, path: Column, templates: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without their text, each with ``path``, ``license``, ``cosine``, ``scope`` and ``origin``.

    ``scope`` is ``file``, ``header`` or ``directory``; ``origin`` the directory inherited from.
    """
    results = ["path", "license", "cosine", "scope", "origin"]
    kept = [c for c in docs.columns if c not in (text, *results)]
    rows = docs.select(F.struct(*kept).alias("_doc"), path.alias("path"), let(F.coalesce(F.col(text), F.lit("")), passages).alias("_passages"))
    rows = rows.withColumn("_dir", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "passages")
    named = F.rlike(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(FILE_NAME))
    found = rows.where(F.size("_passages") > 0).select("_row", "_dir", F.coalesce(named, F.lit(False)).alias("named"), F.explode("_passages").alias("p"))
    found = found.select("_row", "_dir", "named", "p.rank", "p.whole", F.md5("p.text").alias("key"), "p.text")
    known = classify(found.select("key", "text"), templates, threshold)
    headers = found.drop("text").join(known, "key").groupBy("_row").agg(
        F.min(F.struct((-F.col("cosine")).alias("far"), "rank", "license")).alias("b"), F.first("_dir").alias("_dir"), F.max(F.col("whole") | F.col("named")).alias("h_file"))
    headers = written(headers.select("_row", "_dir", F.col("b.license").alias("h_license"), (-F.col("b.far")).alias("h_cosine"), "h_file"), "headers")
    files = headers.where("h_file AND _dir IS NOT NULL").select(F.col("_dir").alias("directory"), F.col("h_license").alias("license"), F.col("h_cosine").alias("cosine"))
    above = written(inherit(rows.select(F.col("_dir").alias("directory")), files), "directories")
    out = rows.select("_doc", "path", "_dir", "_row").join(headers.drop("_dir"), "_row", "left")
    out = out.join(above.withColumnsRenamed({"directory": "_dir", "license": "d_license"}), "_dir", "left")
    scope = F.when(F.col("h_file"), "file").when(F.col("h_license").isNotNull(), "header").when(F.col("d_license").isNotNull(), "directory")
    return out.select(
        "_doc.*", "path", F.coalesce("h_license", "d_license").alias("license"), F.col("h_cosine").alias("cosine"), scope.alias("scope"),
        F.when(F.col("h_license").isNull(), F.col("origin")).alias("origin"),
    )


def document_path() -> Column:
    """The place given to a row of documents: ``source[/lang[/thousand]]/id``, as deep as its id's residue says; every fourth is a ``LICENSE``."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    full = F.array(known("source"), known("lang"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("unknown")))
    depth = F.coalesce(F.pmod(F.floor(F.col("doc_id") / 3), F.lit(3)), F.lit(0)).cast("int") + 1
    return F.array_join(F.concat(F.slice(full, F.lit(1), depth), F.array(F.when(F.col("doc_id") % 4 == 0, "LICENSE").otherwise(known("doc_id")))), "/")
