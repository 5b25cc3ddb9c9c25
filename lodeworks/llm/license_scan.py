"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

A sparse TF-IDF vector is made of every line of every text, of every three lines in a row, of the text's header (its
first lines up to an empty one) and, of licence files (LICENSE, COPYING, NOTICE), of the whole file. Each is compared by
cosine with licence notices, titles, source headers and licence texts. A path's own licence is that of its best part. A
licence file also gives its licence to its directory; paths without one of their own inherit from the nearest
directory above that has one.

Document frequencies are counted over all texts: first those of the templates' terms, and later those of the terms of the
parts that are compared. By Cauchy-Schwarz, a part's cosine to a template is at most the length of the template's unit
vector in the terms that the part holds. So texts, and then lines, that hold too few of every template's terms are left
out before any vector is made, and no part that would count is. Only DataFrame functions are used, and texts are never
shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, small, stored

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. {} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published
by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of
the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."""
# Fixed values by SPDX id: notices as their licences ask for them to be put on files, titles, source headers, and the
# texts of short licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        _GNU.format("program", "Affero General Public License", "3"),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD.format("")),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD.format(_BSD3)),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _GNU.format("program", "General Public License", "2"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GNU.format("program", "General Public License", "3"),
    ),
    "ISC": (
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GNU.format("library", "Lesser General Public License", "3"),
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ),
}
TERM = "[a-z0-9]+"
BLANK = r"^[ \t\r]*$"
#: Cosines are rounded to six places, so a square may be under the threshold's by so much.
_SLACK = 2e-6
#: The square of the length of a template's vector that its lightest terms make up: they count as held by every part.
_LIGHT = 0.02
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _terms(text: Column) -> Column:
    """Terms in order; the split leaves an empty string at an end."""
    return F.filter(_split(text), lambda t: t != "")


def _split(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def weights(idf: dict[str, float], templates=TEMPLATES) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, number of its notice, unit TF-IDF weights by term) for each notice."""
    out = []
    for name, notices in sorted(templates.items()):
        for k, notice in enumerate(notices):
            v = {t: n * idf[t] for t, n in Counter(terms(notice)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            out.append((name, k, {t: x / norm for t, x in v.items()}))
    return out


def heavy(vector: dict[str, float]) -> tuple[float, dict[str, float]]:
    """(square of the length in the lightest terms, squares of the weights of the others)."""
    light, out = 0.0, {}
    for t, x in sorted(vector.items(), key=lambda p: (p[1], p[0])):
        if out or light + x * x > _LIGHT:
            out[t] = x * x
        else:
            light += x * x
    return light, out


def frequencies(docs: DataFrame, wanted: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """(t, df): how many texts hold each of the wanted terms (t), over all rows; null texts count as empty."""
    held = docs.select(F.explode(F.array_distinct(_split(F.col(quoted(text))))).alias("t"))
    return held.join(small(wanted, rows, 48), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def _bounded(held: Column, tables: list[tuple[float, dict[str, float]]], threshold: float) -> Column:
    """Can a part that holds these heavy terms reach the threshold? ``held`` is an expression that is read once, as a
    filter is pushed to where it would be worked out anew for each of its uses."""
    none = [0.0] * len(tables)
    rows = {t: list(none) for _, squares in tables for t in squares}
    for k, (_, squares) in enumerate(tables):
        for t, x in squares.items():
            rows[t][k] = x
    array = lambda values: F.array(*map(F.lit, values))
    known = F.create_map(*[x for t, r in sorted(rows.items()) for x in (F.lit(t), array(r))])
    start = array([light for light, _ in tables])
    total = F.aggregate(held, start, lambda a, t: F.zip_with(a, F.coalesce(F.try_element_at(known, t), array(none)), lambda x, y: x + y))
    return F.exists(total, lambda x: x >= threshold * threshold * (1 - _SLACK))


def _notices(docs: DataFrame, threshold: float, path: str, text: str, templates) -> DataFrame:
    """(rid, license, score, line): the best part of each text with one that reaches the threshold."""
    spark = docs.sparkSession
    vocab = sorted({t for notices in templates.values() for n in notices for t in terms(n)})
    n = docs.count()
    df = {r.t: r.df for r in docs.select(F.explode(F.array_intersect(_split(F.col(quoted(text))), F.array(*map(F.lit, vocab)))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    vectors = weights({t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocab}, templates)
    tables = [heavy(v) for _, _, v in vectors]
    telling = F.array(*map(F.lit, sorted({t for _, squares in tables for t in squares})))
    held = lambda x: F.array_intersect(_split(x), telling)

    slim = docs.select(F.col(quoted(path)).alias("path"), F.col(quoted(text)).alias("text"))
    found = slim.withColumn("held", held(F.col("text"))).where(_bounded(F.col("held"), tables, threshold))
    hit = found.select(rid("path", "text").alias("rid"), F.split("text", "\n", -1).alias("l"), F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False)).alias("gives"))
    hit = stored(hit.dropDuplicates(["rid"]), "hits")
    lines = hit.select("rid", "l", F.posexplode("l").alias("line", "x"))
    three = F.array_join(F.slice("l", F.greatest(F.col("line"), F.lit(1)), F.when(F.col("line") > 0, 3).otherwise(2)), " ")
    windows = lines.select("rid", "line", "x", three.alias("y")).withColumn("held", held(F.col("y"))).where(_bounded(F.col("held"), tables, threshold))
    part = lambda wide, x: F.struct(F.lit(wide).alias("wide"), _terms(x).alias("ts"))
    parts = windows.select("rid", "line", F.explode(F.array(part(0, F.col("x")), part(1, F.col("y")))).alias("p")).select("rid", "line", "p.*")
    first = F.array_position(F.transform("l", lambda x: ~x.rlike(BLANK)), True).cast("int")
    top = hit.where(first > 0).select("rid", "l", "gives", F.slice("l", first, F.size("l")).alias("body"))
    end = F.array_position(F.transform("body", lambda x: x.rlike(BLANK)), True).cast("int")
    header = F.array_join(F.when(end > 0, F.slice("body", F.lit(1), end - 1)).otherwise(F.col("body")), " ")
    whole = top.select("rid", F.lit(0).alias("line"), F.explode(F.when(F.col("gives"), F.array(part(2, header), part(3, F.array_join("l", " ")))).otherwise(F.array(part(2, header)))).alias("p")).select("rid", "line", "p.*")
    parts = parts.unionByName(whole).withColumn("held", F.array_intersect("ts", telling)).where(_bounded(F.col("held"), tables, threshold)).drop("held")
    tf = stored(parts.select("rid", "line", "wide", F.explode("ts").alias("t")).groupBy("rid", "line", "wide", "t").agg(F.count(F.lit(1)).alias("tf")), "parts")
    wanted = stored(tf.select("t").distinct(), "wanted")
    rows = wanted.count()
    idf = frequencies(docs, wanted, rows, text).select("t", (F.log((F.lit(1.0 + n)) / (1 + F.col("df"))) + 1).alias("idf"))
    v = tf.join(small(idf, rows, 48), "t").withColumn("w", F.col("tf") * F.col("idf"))
    long = F.broadcast(spark.createDataFrame([(name, k, t, x) for name, k, w in vectors for t, x in w.items()], "license string, k int, t string, u double"))
    norm = v.groupBy("rid", "line", "wide").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = v.join(long, "t").groupBy("rid", "line", "wide", "license", "k").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    cos = dot.join(norm, ["rid", "line", "wide"]).select("rid", "line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = cos.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "line")).alias("b"))
    return best.select("rid", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.line").cast("int").alias("line"))


def rid(path: str, text: str) -> Column:
    """Rows of equal path and text are alike."""
    return F.xxhash64(F.col(quoted(path)), F.col(quoted(text)))


def folder(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def above(directory: Column) -> Column:
    """The directory and all above it, as an array, nearest first."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = 0.75, templates=TEMPLATES) -> DataFrame:
    """(key, path, license, score, line, how, from_dir) for each row of docs.

    how is ``own`` (a part of the text reached the threshold: license, cosine and line number from 0, that of the
    middle one of three lines, and 0 for header and file; ties go to the first licence by name, then the first line), ``inherited`` (from_dir is the directory) or ``none``. A directory
    with several licence files has that of highest score, ties by name. Null and empty texts have no licence of their
    own; a null path neither gives nor inherits. Rows of equal path and text are alike; other columns aren't looked at.
    """
    own = stored(_notices(docs, threshold, path, text, templates), "licenses")
    p = F.col(quoted(path))
    slim = docs.select(F.col(quoted(key)), p.alias("path"), rid(path, text).alias("rid"), folder(p).alias("dir"))
    found = slim.join(small(own, own.count(), 64), "rid", "left")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    givers = found.where(F.col("license").isNotNull() & name.rlike(LICENSE_FILE)).groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("g")).select("from_dir", F.col("g.license").alias("given"))
    ways = slim.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(above(F.col("dir"))).alias("up", "from_dir"))
    nearest = ways.join(givers, "from_dir").groupBy("dir").agg(F.min(F.struct("up", "from_dir", "given")).alias("n")).select("dir", "n.from_dir", "n.given")
    out = found.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        key,
        "path",
        F.coalesce("license", "given").alias("license"),
        "score",
        "line",
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"),
    )
