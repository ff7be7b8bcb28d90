"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Terms are weighted by how rare they are among all lines of the corpus.  Each template has
probe terms, without which its cosine to anything stays below the threshold.  Wherever a
line, of any length, has one, the window of the template's length that puts the term in its
place in the template is a possible header, so what else stands on the line
doesn't count; a window ends where the line does.  The whole file is a possible licence file.
The cosine of a window to its template, and of a file to each, is summed over the terms both
have; terms that no template has only lengthen it.  A template of fewer than ``SHORT`` terms is
found only with all of them.  A file's own licence is that of its best window or
whole.  A file whose whole reaches the threshold is a licence file: it speaks for its directory
and all below that have no nearer one, and files without an own licence inherit from the nearest.

Only DataFrame functions are used; what is broadcast is the templates' terms.  Templates are
a parameter: (licence, text), a statement or a whole licence; the long licences' full
texts are the caller's to give.

Defined results: a null or empty text has no licence of its own but may inherit;
of equally similar templates, and of equally good licence files of a directory,
the first by name stands; rows of one path are one file, whose licence is the best of its
texts; a null path stays with no licence; repeated rows each get their row; an empty table
gives no rows; texts are scanned whole, whatever their length.  The columns of the input but
text pass through under any name; license, via, cosine and from_dir are the result's own
and replace others of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted, written

THRESHOLD = 0.6
#: Templates of fewer terms are found only whole.
SHORT = 5
#: Terms of a line that are kept together; windows that begin there have theirs as well.
PLACE = 512

# The statements and opening words by which public licences are given, and
# the short licences whole.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Whole licences.
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _AS_IS),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]

_TERM = "[a-z0-9]+"


Templates = list[tuple[str, str]]


def template_terms(templates: Templates = TEMPLATES) -> list[tuple[int, str, Counter]]:
    return [(i, name, Counter(re.findall(_TERM, text.lower()))) for i, (name, text) in enumerate(templates)]


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TERM), F.lit(0))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, th, pos, terms) for each line of each file; th tells texts of a path apart."""
    lines = files.select("path", F.xxhash64(_text()).alias("th"), F.posexplode(F.split(_text(), "\n", -1)).alias("pos", "line"))
    return lines.select("path", "th", "pos", _terms(F.col("line")).alias("terms"))


def term_weights(lines: DataFrame, templates: Templates = TEMPLATES) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms among all lines, and that
    of a term never seen: as many numbers as the templates have terms."""
    vocabulary = sorted({t for _, _, terms in template_terms(templates) for t in terms})
    known = F.array(*map(F.lit, vocabulary))
    # The empty term counts the lines themselves.
    seen = lines.select(F.explode(F.concat(F.array_intersect(F.col("terms"), known), F.array(F.lit("")))).alias("t")).groupBy("t").count()
    count = {r[0]: r[1] for r in seen.collect()}
    n = count.get("", 0)
    return {t: math.log((n + 1) / (count.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def anchors(weights: dict[str, float], threshold: float, templates: Templates = TEMPLATES) -> dict[int, set[str]]:
    """For each template, the terms of which a text needs one to reach the threshold:
    the rest together weigh less than that share of the template's length."""
    out: dict[int, set[str]] = {}
    for i, _, terms in template_terms(templates):
        square = {t: (n * weights[t]) ** 2 for t, n in terms.items()}
        total, rest = sum(square.values()), 0.0
        for t in sorted(square, key=lambda t: (weights[t], t)):
            rest += square[t]
            if math.sqrt(rest / total) >= threshold - 1e-9:
                out.setdefault(i, set()).add(t)
    return out


def probes(weights: dict[str, float], threshold: float, templates: Templates = TEMPLATES) -> set[str]:
    return set().union(*anchors(weights, threshold, templates).values())


_UNIT = ["path", "th", "pos", "part"]


def windows_of(likely: DataFrame, asked: dict[int, set[str]], templates: Templates = TEMPLATES) -> DataFrame:
    """(path, th, pos, part, terms, only): the windows of each template around its probe terms;
    part numbers them, only is the template."""
    table = []
    for i, (_, text) in enumerate(templates):
        words = re.findall(_TERM, text.lower())
        table += [(t, i, at, len(words)) for at, t in enumerate(words) if t in asked.get(i, ())]
    longest = max((n for _, _, _, n in table), default=1)
    spark = likely.sparkSession
    at = spark.createDataFrame(table, "term string, only int, place int, n int").groupBy("term").agg(F.collect_list(F.struct("only", "place", "n")).alias("at"))
    # Cuts of a line overlap by the longest template on either side, and own the terms between.
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("terms") - 1) / PLACE).cast("int")), lambda c: F.struct(c.alias("cut"), F.greatest(c * PLACE - longest, F.lit(0)).alias("from"), F.slice("terms", F.greatest(c * PLACE - longest, F.lit(0)) + 1, F.lit(PLACE + 2 * longest)).alias("terms")))
    cut = written(likely.where(F.size("terms") > 0).select("path", "th", "pos", F.inline(cuts)), "license-cuts")
    term = cut.select("path", "th", "pos", "cut", "from", F.posexplode("terms").alias("i", "term")).withColumn("i", F.col("i") + F.col("from")).where(F.floor(F.col("i") / PLACE) == F.col("cut"))
    begin = term.join(F.broadcast(at), "term").select("path", "th", "pos", "cut", "i", F.inline("at"))
    begin = begin.select("path", "th", "pos", "cut", "only", "n", (F.col("i") - F.col("place")).alias("start")).distinct()
    found = begin.join(cut, ["path", "th", "pos", "cut"])
    low = F.greatest("start", F.lit(0))
    inside = F.slice("terms", (low - F.col("from") + 1).cast("int"), (F.col("start") + F.col("n") - low).cast("int"))
    # Windows of two cuts may be one; the number tells those of a line apart.
    part = (F.col("start") + longest).cast("long") * len(templates) + F.col("only") + 1
    return found.select("path", "th", "pos", part.alias("part"), inside.alias("terms"), "only").dropDuplicates(_UNIT)


def matches(files: DataFrame, threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> DataFrame:
    """(path, th, pos, part, license, cosine) for what reaches the threshold."""
    spark = files.sparkSession
    lines = lines_of(files)
    weights, unseen = term_weights(lines, templates)
    asked = anchors(weights, threshold, templates)
    chosen = F.array(*map(F.lit, sorted(set().union(*asked.values()))))
    likely = lines.where(F.arrays_overlap(F.col("terms"), chosen)).dropDuplicates(["path", "th", "pos"])
    # A whole file holds a probe term only if one of its lines does.
    whole = files.select("path", F.xxhash64(_text()).alias("th"), _terms(_text()).alias("terms")).where(F.arrays_overlap(F.col("terms"), chosen)).dropDuplicates(["path", "th"])
    units = windows_of(likely, asked, templates).unionByName(whole.select("path", "th", F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("part"), "terms", F.lit(None).cast("int").alias("only")))
    tf = units.select(*_UNIT, "only", F.explode("terms").alias("term")).groupBy(*_UNIT, "only", "term").agg(F.count("*").alias("tf"))
    table = []
    for i, name, terms in template_terms(templates):
        norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in terms.items()))
        # What a sum needs of the template's terms: all of a short one.
        least = len(terms) if sum(terms.values()) < SHORT else 1
        table += [(t, i, name, n * weights[t] / norm, least) for t, n in terms.items()]
    idf = spark.createDataFrame(list(weights.items()), "term string, idf double")
    of = spark.createDataFrame(table, "term string, template int, license string, share double, least int").groupBy("term").agg(F.collect_list(F.struct("template", "license", "share", "least")).alias("of"))
    own = F.filter(F.coalesce("of", F.expr("array()").cast("array<struct<template:int,license:string,share:double,least:int>>")), lambda x: F.col("only").isNull() | (x["template"] == F.col("only")))
    w = tf.join(F.broadcast(idf), "term", "left").join(F.broadcast(of), "term", "left").select(*_UNIT, own.alias("of"), (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    # Rows with a template add to its product, and all rows to the norm (template -1).
    norm = F.array(F.struct(F.lit(-1).alias("template"), F.lit("").alias("license"), F.col("w").alias("share"), F.lit(0).alias("least")))
    parts = w.select(*_UNIT, "w", F.inline(F.concat(norm, "of")))
    sums = parts.groupBy(*_UNIT, "template", "license", "least").agg(F.sum(F.col("w") * F.col("share")).alias("sum"), F.count("*").alias("n"))
    sums = written(sums.where("n >= least"), "license-sums")
    norm = sums.where("template = -1").select(*_UNIT, F.sqrt("sum").alias("norm"))
    scored = sums.where("template >= 0").join(norm, _UNIT).select(*_UNIT, "license", F.round(F.col("sum") / F.col("norm"), 6).alias("cosine"))
    return scored.where(F.col("cosine") >= threshold)


def scan(files: DataFrame, threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> DataFrame:
    """files: (path, text, ...), directories before the last '/'.  A row per input row: its
    columns but text, license, via (own, inherited or null), cosine and from_dir."""
    kept = [c for c in files.columns if c not in ("text", "license", "via", "cosine", "from_dir")]
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    named = rows.where("path is not null")
    found = written(matches(named.select("path", "text"), threshold, templates), "license-matches")
    best = F.min(F.struct((-F.col("cosine")).alias("less"), F.col("license"))).alias("b")  # the highest, then the first by name
    own = written(found.groupBy("path").agg(best).select("path", F.col("b.license").alias("own"), (-F.col("b.less")).alias("cosine")), "license-own")
    up = F.regexp_replace(F.col("path"), "/[^/]*$", "")
    speakers = found.where("pos = -1").groupBy("path").agg(best).select(up.alias("dir"), F.struct(F.col("b.less").alias("c"), F.col("b.license").alias("license"), F.col("path")).alias("s")).groupBy("dir").agg(F.min("s").alias("s"))
    speakers = written(speakers.select(F.col("dir").alias("from_dir"), F.col("s.license").alias("given")), "license-dirs")
    # Distinct directories climb to their ancestors; the deepest that has a licence stands.
    # One directory may hold most files, or be above most others.
    dirs = written(named.groupBy(up.alias("dir")).agg(F.count("*").alias("n")), "license-all-dirs")
    parts = F.split("dir", "/", -1)
    climb = written(dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("from_dir")), "license-climb")
    above = written(climb.groupBy("from_dir").agg(F.count("*").alias("n")), "license-above")
    near = salted(climb, speakers, above, ["from_dir"], climb.count(), by=["dir"]).groupBy("dir").agg(F.max_by(F.struct("from_dir", "given"), F.length("from_dir")).alias("near"))
    total = dirs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = named.select("__row", "path", up.alias("dir")).join(own, "path", "left")
    each = salted(each, near, dirs, ["dir"], total, by=["path"], how="left")
    by_own = F.col("own").isNotNull()
    done = each.select(
        "__row.*", F.coalesce("own", "near.given").alias("license"), F.when(by_own, "own").when(F.col("near").isNotNull(), "inherited").alias("via"),
        F.when(by_own, F.col("cosine")).alias("cosine"), F.when(~by_own, F.col("near.from_dir")).alias("from_dir"),
    )
    nothing = F.lit(None).cast("string")
    return done.unionByName(rows.where("path is null").select("__row.*", nothing.alias("license"), nothing.alias("via"), F.lit(None).cast("double").alias("cosine"), nothing.alias("from_dir")))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: by turns of the id in the folder of the source, of the
    language below it, or of a thousand ids below that."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    top, lang = F.concat(F.lit("/"), name("source")), name("lang")
    folder = F.when(F.col("doc_id") % 3 == 0, top).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", top, lang)).otherwise(F.concat_ws("/", top, lang, F.floor(F.col("doc_id") / 1000)))
    return docs.select("doc_id", F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), "text")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(document_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "path", "license", "via", "cosine", "from_dir")


def _oracle() -> str:
    every = template_terms()
    values = ", ".join(f"({i}, '{name}', '{t}', {n}, {len(terms) if sum(terms.values()) < SHORT else 1})" for i, name, terms in every for t, n in terms.items())
    places = ", ".join(f"({i}, {at}, '{t}', {len(words)})" for i, words in ((i, re.findall(_TERM, text.lower())) for i, (_, text) in enumerate(TEMPLATES)) for at, t in enumerate(words))
    return rf"""
WITH files AS (SELECT doc_id, '/' || coalesce(source, 'none') || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '/' || coalesce(lang, 'none') ELSE '/' || coalesce(lang, 'none') || '/' || CAST(doc_id // 1000 AS VARCHAR) END AS dir, coalesce(text, '') AS text FROM documents),
tt AS (SELECT * FROM (VALUES {values}) v(template, license, term, n, least)),
tp AS (SELECT * FROM (VALUES {places}) v(template, place, term, m)),
lines AS MATERIALIZED (SELECT doc_id, pos, regexp_extract_all(lower(line), '[a-z0-9]+') AS terms FROM (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM files))),
lt AS MATERIALIZED (SELECT doc_id, pos, unnest(terms) AS term, unnest(generate_series(0, len(terms) - 1)) AS i FROM lines),
n AS (SELECT count(*) AS n FROM lines),
idf AS (SELECT term, ln((n + 1) / (coalesce(c, 0) + 1.0)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN (SELECT term, count(*) AS c FROM (SELECT DISTINCT doc_id, pos, term FROM lt) GROUP BY term) USING (term), n),
tw AS (SELECT template, license, term, least, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS share, sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template ORDER BY idf, term) / sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS reach FROM tt JOIN idf USING (term)),
wins AS MATERIALIZED (SELECT DISTINCT doc_id, pos, template, i - place AS start, m FROM lt JOIN tp USING (term) JOIN (SELECT template, term FROM tw WHERE reach >= {THRESHOLD - 1e-9}) USING (template, term)),
wt AS (SELECT wins.*, term FROM wins JOIN lt ON lt.doc_id = wins.doc_id AND lt.pos = wins.pos AND i >= start AND i < start + m),
tf AS (SELECT doc_id, pos, start, template AS asked, term, count(*) AS tf FROM wt GROUP BY ALL UNION ALL SELECT doc_id, -1, 0, NULL, term, count(*) FROM lt GROUP BY doc_id, term),
w AS (SELECT doc_id, pos, start, asked, tf.term, tf * coalesce(idf, ln(n.n + 1.0) + 1) AS w FROM tf LEFT JOIN idf USING (term), n),
norm AS (SELECT doc_id, pos, start, asked, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
scored AS (SELECT w.doc_id, w.pos, license, round(sum(w * share) / any_value(norm), 6) AS cosine FROM w JOIN tw ON w.term = tw.term AND (asked IS NULL OR asked = template) JOIN norm ON norm.doc_id = w.doc_id AND norm.pos = w.pos AND norm.start = w.start AND norm.asked IS NOT DISTINCT FROM w.asked GROUP BY w.doc_id, w.pos, w.start, w.asked, template, license, least HAVING count(*) >= least AND cosine >= {THRESHOLD}),
own AS (SELECT doc_id, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM scored GROUP BY doc_id),
lic AS (SELECT doc_id, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM scored WHERE pos = -1 GROUP BY doc_id),
sp AS (SELECT dir AS from_dir, arg_min(license, (-cosine, license, CAST(doc_id AS VARCHAR))) AS given FROM lic JOIN files USING (doc_id) GROUP BY dir),
near AS (SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir, arg_max(given, length(from_dir)) AS given FROM (SELECT DISTINCT dir FROM files) d JOIN sp ON d.dir = from_dir OR starts_with(d.dir, from_dir || '/') GROUP BY dir)
SELECT doc_id, files.dir || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(license, given) AS license,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS via, cosine, CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = files.dir
"""


ORACLE = _oracle()
