"""Licences in texts by sentence and rule. DataFrame operations only.

A text is cut into sentences at line ends and after ``.``, ``!``, ``?``,
``:`` and ``;`` before white space; known sentences have none of these inside.
A single line end, with comment marks after it, may also stand inside a
sentence, so that wrapped texts are read; a blank line may not, but before an
address. A sentence in lower case, with every run of other characters than a-z
and 0-9 as one space, is looked up among the known licence sentences, a table
of fixed size, the longest first. The identifiers found, in order, are one
sequence; unknown sentences between them do not count. Rules are sequences of
identifiers under a licence's name, the longest first; what a rule matches is
used up.

Defined results: a null or empty text has no sentences and no licence; rows
that repeat each have a result; a licence is named once however often it
stands; names come in the order of the rules; null ids and columns of other
names do not matter; an empty table gives no rows. Time is linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and sentence.
SENTENCES = (
    ("apache-2-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-long", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("apache-2-asf", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License").'),
    ("apache-2-use", "You may not use this file except in compliance with the License."),
    ("apache-2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("apache-2-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-line", "Released under the MIT License."),
    ("mit-line-2", "Licensed under the MIT License."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-program", "This program is free software:"),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    ("gpl-2-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl-3-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("lgpl-library", "This library is free software;"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    ("lgpl-3-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("either-2", "either version 2 of the License, or (at your option) any later version."),
    ("either-2-1", "either version 2.1 of the License, or (at your option) any later version."),
    ("either-3", "either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-fitness", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-4-long", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-4-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0-line", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd-line", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-line", "Licensed under the BSD 2-Clause License."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("mpl-2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2-copy-http", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-1-line", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
)
#: Licence and the identifiers that show it, in order.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Apache-2.0", ("apache-2-long", "apache-2-use", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-asf", "apache-2-use", "apache-2-copy", "apache-2-basis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl-terms", "either-2")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-terms", "either-3")),
    ("LGPL-2.1-or-later", ("lgpl-library", "lgpl-terms", "either-2-1")),
    ("LGPL-3.0-or-later", ("lgpl-library", "lgpl-terms", "either-3")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-3-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl-2-later", "gpl-hope")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("GPL-2.0-only", ("gpl-program", "gpl-2-terms")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl-2-later")),
    ("LGPL-3.0-or-later", ("gpl-program", "lgpl-3-later")),
    ("LGPL-3.0-or-later", ("lgpl-library", "lgpl-3-later")),
    ("AGPL-3.0-or-later", ("gpl-program", "agpl-3-later")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy-http")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-2-line",)),
    ("Apache-2.0", ("apache-2-long",)),
    ("Apache-2.0", ("apache-2-asf",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-long",)),
    ("CC0-1.0", ("cc0-line",)),
    ("BSD", ("bsd-grant",)),
    ("BSD-3-Clause", ("bsd-line",)),
    ("BSD-2-Clause", ("bsd-2-line",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-2-copy",)),
    ("EPL-2.0", ("epl-2-terms",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("bsl-1-line",)),
    ("BSL-1.0", ("bsl-1-grant",)),
)
#: Words of which every known sentence holds one.
HINTS = ("licen", "permission", "warrant", "copyright", "redistribut", "software", "mpl")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def normalise(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known_pattern() -> str:
    """Known sentences between two marks, the longest first."""
    each = sorted((normalise(s) for _, s in SENTENCES), key=len, reverse=True)
    gaps = ("[ L]+http".join(part.replace(" ", "(?: | ?L ?)") for part in s.split(" http")) for s in each)
    return f"(?<=[SL]|[SL] )(?:{'|'.join(gaps)})(?= ?[SL])"


def sentence_ids(text: Column) -> Column:
    """Numbers (from 1) of the known sentences of a text, in order."""
    low = _lower(F.coalesce(text.cast("string"), F.lit("")))
    may = reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in HINTS))
    known = F.create_map(*(F.lit(x) for i, (_, s) in enumerate(SENTENCES, 1) for x in (normalise(s), i)))
    # Capitals are free as marks: S after a sentence, L for a line end.
    marked = F.translate(F.regexp_replace(low, r"(?<=[.!?:;])[\x20\x09-\x0D]+", "S"), "\n", "L")
    line = F.concat(F.lit("S"), F.regexp_replace(marked, "[^a-z0-9SL]+", " "), F.lit("S"))
    ids = F.transform(F.regexp_extract_all(line, F.lit(_known_pattern()), F.lit(0)), lambda s: F.element_at(known, F.regexp_replace(s, "[ L]+", " ")))
    return F.when(may, ids).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_ids and licenses, for every row."""
    number = {name: i for i, (name, _) in enumerate(SENTENCES, 1)}
    out = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("ids"))
    left: Column = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ""))
    found = []
    out = out.withColumn("_seq", left)
    for i, (name, rule) in enumerate(RULES):
        want = "".join(f"<{number[s]}>" for s in rule)
        out = out.withColumn(f"_r{i}", F.when(F.contains(F.col("_seq"), F.lit(want)), F.lit(name))).withColumn("_seq", F.replace(F.col("_seq"), F.lit(want), F.lit(".")))
        found.append(F.col(f"_r{i}"))
    names = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"), names.alias("licenses"))


def op6_license_rules(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    number = {name: i for i, (name, _) in enumerate(SENTENCES, 1)}
    known = ", ".join(f"({i}, '{normalise(s)}')" for i, (_, s) in enumerate(SENTENCES, 1))
    # Every mark is written twice, as a match uses up the mark on either side.
    gap, link = "(?: | ?LL ?)", "[ L]+http"
    each = sorted((normalise(s) for _, s in SENTENCES), key=len, reverse=True)
    pattern = "[SL] ?(" + "|".join(link.join(part.replace(" ", gap) for part in s.split(" http")) for s in each) + ") ?[SL]"
    steps = []
    for i, (name, rule) in enumerate(RULES):
        want = "".join(f"<{number[s]}>" for s in rule)
        steps.append(f"r{i} AS (SELECT *, CASE WHEN contains(q{i}, '{want}') THEN '{name}' END AS n{i}, replace(q{i}, '{want}', '.') AS q{i + 1} FROM {f'r{i - 1}' if i else 'r'})")
    last = len(RULES)
    names = ", ".join(f"n{i}" for i in range(last))
    hints = " OR ".join(f"contains(t, '{h}')" for h in HINTS)
    return rf"""
WITH k(id, s) AS (VALUES {known}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT doc_id, 'S' || regexp_replace(replace(regexp_replace(t, '([.!?:;])[\x20\x09-\x0D]+', '\1SS', 'g'), chr(10), 'LL'), '[^a-z0-9SL]+', ' ', 'g') || 'S' AS line FROM d WHERE {hints}),
f AS (SELECT doc_id, regexp_extract_all(line, '{pattern}', 1) AS parts FROM e),
x AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM f),
m AS (SELECT doc_id, i, k.id FROM x JOIN k ON regexp_replace(p, '[ L]+', ' ', 'g') = k.s),
a AS (SELECT doc_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids, string_agg('<' || id::VARCHAR || '>', '' ORDER BY i) AS seq FROM m GROUP BY doc_id),
r AS (SELECT doc_id, n, ids, seq AS q0 FROM a),
{", ".join(steps)},
l AS (SELECT doc_id, list_filter([{names}], lambda v: v IS NOT NULL) AS l FROM r{last - 1}),
u AS (SELECT doc_id, v, min(i) AS i FROM (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM l) GROUP BY 1, 2),
g AS (SELECT doc_id, string_agg(v, ',' ORDER BY i) AS licenses FROM u GROUP BY doc_id)
SELECT documents.doc_id, coalesce(a.n, 0)::BIGINT AS n_known, coalesce(a.ids, '') AS sentence_ids, coalesce(g.licenses, '') AS licenses
FROM documents LEFT JOIN a ON a.doc_id = documents.doc_id LEFT JOIN g ON g.doc_id = documents.doc_id
"""


OP6_SQL = _sql()
