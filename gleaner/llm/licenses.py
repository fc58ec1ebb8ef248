"""License scans by sentence rules, in DataFrame functions only.

A text becomes a stream of normalised words with a mark wherever a sentence may end: at . ! ? ; : before
white space, at line breaks and after list numbers.  A known license sentence is recognised from one mark
to another, over marks inside it, so that wrapped lines, comment signs and list numbers don't hide it.  The
ordered identifiers found are matched against rules, each an ordered run of identifiers that names a
license.  All of it is text and array work inside one projection: no join, no shuffle and no Python,
whatever the size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table

#: Identifier -> the sentences it stands for.  Fixed values: sentences of published licenses and their usual notices.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "json-good": ["The Software shall be used for Good, not Evil"],
    "x11-name": ["Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium"],
    "mit-as-is": [
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "The software is provided as is, without warranty of any kind",
    ],
    "mit-liability": [
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ],
    "apache-2-title": ["Apache License Version 2.0, January 2004"],
    "apache-2-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License, Version 2.0"],
    "apache-2-condition": ["You may not use this file except in compliance with the License"],
    "apache-2-notice-condition": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2-disclaimer": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-2-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl-2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl-3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "lgpl-2.1-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl-3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl-3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "gpl-copies": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl-3-notice": ["This work is licensed under the GNU General Public License version 3", "Licensed under the GNU General Public License version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2-notice": ["Licensed under the GNU General Public License version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "gpl-2-plus-notice": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3-plus-notice": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2-plus-grant": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "gpl-3-plus-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "lgpl-2.1-plus-grant": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "lgpl-3-plus-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "agpl-3-plus-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions of source code must retain the above copyright notice"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Redistributions in binary form must reproduce the above copyright notice",
    ],
    "bsd-endorsement": [
        f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for holder in ("the copyright holder", "the organization", "the author", "the university", "the project", "Google Inc.")
    ],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-as-is": [
        f"This software is provided by the {who} as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        for who in ("copyright holders and contributors", "authors and contributors", "regents and contributors", "author")
    ],
    "bsd-liability": [
        f"In no event shall the {who} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"
        for who in ("copyright holder or contributors", "copyright owner or contributors", "authors or contributors", "regents or contributors", "author")
    ],
    "bsd-3-notice": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "bsd-2-notice": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ["The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-notice": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "mpl-2-title": ["Mozilla Public License Version 2.0"],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "epl-2-title": ["Eclipse Public License - v 2.0"],
    "epl-2-notice": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "boost-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "zlib-as-is": ["This software is provided as-is, without any express or implied warranty"],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense-notice": ["This is free and unencumbered software released into the public domain"],
    "unlicense-grant": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ],
    "cc0-notice": ["SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by-4-notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Except where otherwise noted, this work is licensed under CC BY 4.0"],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4-notice": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4-notice": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-4-notice": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}

#: Ordered rules: (license, run of sentence identifiers).  The longest run that starts at a sentence wins, then the first named.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("JSON", ["mit-grant", "mit-condition", "json-good", "mit-as-is", "mit-liability"]),
    ("JSON", ["mit-grant", "mit-condition", "json-good"]),
    ("X11", ["mit-grant", "mit-condition", "mit-as-is", "mit-liability", "x11-name"]),
    ("X11", ["mit-grant", "mit-condition", "mit-as-is", "x11-name"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-condition", "apache-2-copy", "apache-2-disclaimer", "apache-2-limits"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-condition", "apache-2-disclaimer"]),
    ("Apache-2.0", ["apache-2-notice-condition"]),
    ("Apache-2.0", ["apache-2-notice-condition", "apache-2-copy", "apache-2-disclaimer", "apache-2-limits"]),
    ("Apache-2.0", ["apache-2-notice-condition", "apache-2-disclaimer"]),
    ("GPL-2.0", ["gpl-2-title", "gpl-copies"]),
    ("GPL-3.0", ["gpl-3-title", "gpl-copies"]),
    ("LGPL-2.1", ["lgpl-2.1-title", "gpl-copies"]),
    ("LGPL-3.0", ["lgpl-3-title", "gpl-copies"]),
    ("AGPL-3.0", ["agpl-3-title", "gpl-copies"]),
    ("GPL-3.0", ["gpl-3-notice"]),
    ("GPL-2.0", ["gpl-2-notice"]),
    ("GPL-2.0-or-later", ["gpl-2-plus-notice"]),
    ("GPL-3.0-or-later", ["gpl-3-plus-notice"]),
    ("GPL-2.0-or-later", ["gpl-2-plus-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-plus-grant", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-3-plus-grant"]),
    ("GPL-3.0-or-later", ["gpl-3-plus-grant", "gpl-hope", "gpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-plus-grant"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-plus-grant", "lgpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl-3-plus-grant"]),
    ("LGPL-3.0-or-later", ["lgpl-3-plus-grant", "gpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl-3-plus-grant", "lgpl-hope", "lgpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-3-plus-grant"]),
    ("AGPL-3.0-or-later", ["agpl-3-plus-grant", "gpl-hope", "agpl-details"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorsement"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-3-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-2-notice"]),
    ("ISC", ["isc-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("MPL-2.0", ["mpl-2-notice", "mpl-2-copy"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("Unlicense", ["unlicense-notice", "unlicense-grant"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4-notice"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4-notice"]),
]

#: The steps from a lower-case text to words and marks: (pattern, what replaces it).
STEPS = (
    (r"[\n\r][^a-z0-9\n\r]*([0-9]{1,2}|[a-z])[.)]\s", "\n"),
    (r"~", " "),
    (r"[\n\r]|[.!?;:]+(\s|$)", "~"),
    (r"[^a-z0-9~]+", " "),
    (r"[ ~]*~[ ~]*", " ~ ~ "),
)

#: A word that is not `this`, where the software itself is named.
_NAME = "(?:[a-su-z0-9][a-z0-9]*|t|t[a-gi-z0-9][a-z0-9]*|th|th[a-hj-z0-9][a-z0-9]*|thi|thi[a-rt-z0-9][a-z0-9]*|this[a-z0-9]+) (?:[a-z0-9]+ ){0,5}?"


def _phrase(words: str, who: str = "(?:[a-z0-9~]+ ){1,24}?") -> str:
    """Words in the stream, with or without marks between them; <> stands for whoever is named there."""
    before, after = words.split("<>")
    join = lambda w: "(?: ~ ~)? ".join(w.split())
    return (join(before) + "(?: ~ ~)? " if before.strip() else "~ ") + who + join(after)


#: Sentences that name a holder or a program read as if they named the one that is known.
HOLDERS = tuple(
    (_phrase(words), words.replace("<>", known))
    for words, known in (
        ("neither the name of <> nor the names of its contributors", "the copyright holder"),
        ("this software is provided by <> as is and any express or implied warranties", "the copyright holders and contributors"),
        ("in no event shall <> be liable for any direct indirect incidental special exemplary", "the copyright holder or contributors"),
        ("in no event shall <> be liable for any claim damages or other liability", "the authors or copyright holders"),
        ("except as contained in this notice the name of <> shall not be used", "the x consortium"),
    )
) + ((_phrase("<> is free software you can redistribute it", _NAME), "~ this program is free software you can redistribute it"),)


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known(sentences: dict[str, list[str]]) -> dict[str, str]:
    return {_normal(s): i for i, of in sentences.items() for s in of}


def _pattern(known: dict[str, str]) -> str:
    """A known sentence between two marks, with or without marks inside it."""
    return "~ (" + "|".join(s.replace(" ", "(?: ~ ~)? ") for s in sorted(known, key=lambda s: (-len(s), s))) + ") ~"


def _runs(rules: list[tuple[str, list[str]]]) -> dict[str, str]:
    """Rules as text, each identifier with a space on both sides, the longest first: run -> license."""
    runs: dict[str, str] = {}
    for name, run in sorted(rules, key=lambda r: -len(r[1])):
        runs.setdefault("".join(f" {i} " for i in run), name)
    return runs


def scan_licenses(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, sentence_ids (known sentences in text order), licenses (distinct, in
    order of first match), n_matches (rule matches, non-overlapping from the left, longest first).

    A null, empty or unlicensed text has empty lists and 0 matches.  Rows are kept as they are, repeated
    ids included; other columns are ignored.  Very long texts cost time in proportion to their length and
    a few copies of the text in memory.
    """
    known, runs = _known(sentences), _runs(rules)
    table_of = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    stream = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # only texts that hold some known sentence's first words are gone through
    heads = sorted({" ".join(s.split()[:3]) for s in known} | {"is free software"})
    maybe = F.regexp_replace(stream, "[^a-z0-9]+", " ").rlike("|".join(heads))
    for pattern, by in STEPS:
        stream = F.regexp_replace(stream, pattern, by)
    stream = F.concat(F.lit("~ ~ "), F.trim(stream), F.lit(" ~ ~"))
    for pattern, by in HOLDERS:
        stream = F.regexp_replace(stream, pattern, by)
    hits = F.regexp_extract_all(stream, F.lit(_pattern(known)), F.lit(1))
    ids = F.transform(hits, lambda s: F.element_at(table_of(known), F.replace(s, F.lit(" ~ ~"), F.lit(""))))
    found = docs.select(F.col(id_col), F.when(maybe, ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    line = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit(" "), s, F.lit(" "))), "")
    matched = F.regexp_extract_all(line, F.lit("(" + "|".join(map(re.escape, runs)) + ")"), F.lit(1))
    named = found.withColumn("names", F.when(F.size("sentence_ids") > 0, F.transform(matched, lambda r: F.element_at(table_of(runs), r))).otherwise(F.array().cast("array<string>")))
    return named.select(id_col, "sentence_ids", F.array_distinct("names").alias("licenses"), F.size("names").cast("long").alias("n_matches"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document; lists are joined with commas so that rows compare as text."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches")


def _sql() -> str:
    """The same rows by exploding sentences; rules are matched one by one from each place on."""
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = _known(SENTENCES)
    known = ", ".join(f"({literal(s)}, {literal(i)})" for s, i in sentences.items())
    rules = ", ".join(f"({literal(n)}, {literal(' '.join(r))}, {k}, {len(r)})" for k, (n, r) in enumerate(sorted(RULES, key=lambda r: -len(r[1]))))
    stream = "lower(coalesce(text, ''))"
    for pattern, by in STEPS:
        stream = f"regexp_replace({stream}, {literal(pattern)}, {literal(by)}, 'g')"
    stream = f"'~ ~ ' || trim({stream}, ' ') || ' ~ ~'"
    for pattern, by in HOLDERS:
        stream = f"regexp_replace({stream}, {literal(pattern)}, {literal(by)}, 'g')"
    return f"""
WITH RECURSIVE known(s, id) AS (VALUES {known}), rules(name, run, rank, size) AS (VALUES {rules}),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM (
  SELECT doc_id, regexp_extract_all({stream}, {literal(_pattern(sentences))}, 1) AS l FROM documents)),
i AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM p JOIN known ON known.s = replace(p.s, ' ~ ~', '') GROUP BY doc_id),
m AS (
  SELECT doc_id, ids, 1 AS pos, CAST([] AS VARCHAR[]) AS names FROM i
  UNION ALL
  SELECT m.doc_id, ids, pos + coalesce(hit.size, 1), CASE WHEN hit.name IS NULL THEN names ELSE list_append(names, hit.name) END
  FROM (SELECT *, (SELECT arg_min({{'name': name, 'size': size}}, rank) FROM rules
                   WHERE array_to_string(ids[pos:pos + size - 1], ' ') = run AND len(ids) >= pos + size - 1) AS hit FROM m WHERE pos <= len(ids)) m),
f AS (SELECT doc_id, arg_max(names, pos) AS names, any_value(ids) AS ids FROM m GROUP BY doc_id),
u AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS licenses FROM (SELECT doc_id, name, min(k) AS k FROM (
  SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM f) GROUP BY doc_id, name) GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids, coalesce(u.licenses, '') AS licenses, CAST(coalesce(len(f.names), 0) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN u USING (doc_id)"""


QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": _sql()}
