"""Licence scans by sentences: known licence sentences become identifiers, ordered rules read their sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.common import sql_list, table, text_or_empty

# Sentences of public licences and notices.
SENTENCES = {
    "MIT_name": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License", "The MIT License (MIT)", "MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "Distributed under the MIT License"],
    "MIT_permission": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "asis_MIT": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "liable_MIT": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "ISC_permission": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "ISC_name": ["ISC License", "Licensed under the ISC License"],
    "Apache2_name": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "Released under the Apache License, Version 2.0", "Apache License, Version 2.0"],
    "Apache2_grant": ['Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License");'],
    "Apache2_use": ["you may not use this file except in compliance with the License"],
    "Apache2_copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "Apache2_asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "Apache2_see": ["See the License for the specific language governing permissions and limitations under the License"],
    "GPL3_name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "GPL2_name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "GPL3+_grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GPL2+_grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GPL_see": ["See the GNU General Public License for more details"],
    "GPL_copy": ["You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"],
    "LGPL3_name": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL3_name": ["Licensed under the GNU Affero General Public License, version 3"],
    "MPL2_name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "MPL2_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "BSD_permission": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSD_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSD_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD3_name": ["Licensed under the BSD 3-Clause License"],
    "BSD2_name": ["Licensed under the BSD 2-Clause License"],
    "CC0_name": ["This work is dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0"],
    "CCBY4_name": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CCBYSA4_name": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CCBYNC4_name": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CCBYND4_name": ["Licensed under CC BY-ND 4.0"],
    "asis_ISC": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "liable_ISC": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"],
    "asis_BSD": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "liable_BSD": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"],
    "LGPL21+_grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "AGPL3+_grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "EPL2_name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL1_name": ["Distributed under the Boost Software License, Version 1.0"],
    "Zlib_asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "Zlib_liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "Zlib_permission": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense_grant": ["This is free and unencumbered software released into the public domain"],
}

# Licence names that SPDX lines use.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"SPDX_{name}": [f"SPDX-License-Identifier: {name}"] for name in SPDX}

#: In order: a rule takes its identifiers out of the sequence before later rules see it.
RULES = [
    ("MIT", "MIT_name MIT_permission MIT_notice asis_MIT liable_MIT"),
    ("MIT", "MIT_permission MIT_notice asis_MIT liable_MIT"),
    ("MIT", "MIT_permission MIT_notice asis_MIT"),
    ("MIT", "MIT_permission MIT_notice"),
    ("Apache-2.0", "Apache2_grant Apache2_use Apache2_copy Apache2_asis Apache2_see"),
    ("Apache-2.0", "Apache2_grant Apache2_use Apache2_copy"),
    ("Apache-2.0", "Apache2_grant"),
    ("GPL-3.0-or-later", "GPL3+_grant GPL_hope GPL_see GPL_copy"),
    ("GPL-3.0-or-later", "GPL3+_grant"),
    ("GPL-2.0-or-later", "GPL2+_grant GPL_hope GPL_see GPL_copy"),
    ("GPL-2.0-or-later", "GPL2+_grant"),
    ("LGPL-2.1-or-later", "LGPL21+_grant"),
    ("AGPL-3.0-or-later", "AGPL3+_grant"),
    ("BSD-3-Clause", "BSD_permission BSD_source BSD_binary BSD_endorse asis_BSD liable_BSD"),
    ("BSD-3-Clause", "BSD_permission BSD_source BSD_binary BSD_endorse"),
    ("BSD-2-Clause", "BSD_permission BSD_source BSD_binary asis_BSD liable_BSD"),
    ("BSD-2-Clause", "BSD_permission BSD_source BSD_binary"),
    ("Zlib", "Zlib_asis Zlib_liable Zlib_permission"),
    ("EPL-2.0", "EPL2_name"),
    ("BSL-1.0", "BSL1_name"),
    ("MPL-2.0", "MPL2_name MPL2_copy"),
    ("ISC", "ISC_name ISC_permission asis_ISC liable_ISC"),
    ("ISC", "ISC_permission asis_ISC liable_ISC"),
    ("ISC", "ISC_permission"),
    ("MIT", "MIT_name"),
    ("ISC", "ISC_name"),
    ("Apache-2.0", "Apache2_name"),
    ("GPL-3.0", "GPL3_name"),
    ("GPL-2.0", "GPL2_name"),
    ("LGPL-3.0", "LGPL3_name"),
    ("AGPL-3.0", "AGPL3_name"),
    ("MPL-2.0", "MPL2_name"),
    ("BSD-3-Clause", "BSD3_name"),
    ("BSD-2-Clause", "BSD2_name"),
    ("CC0-1.0", "CC0_name"),
    ("CC-BY-4.0", "CCBY4_name"),
    ("CC-BY-SA-4.0", "CCBYSA4_name"),
    ("CC-BY-NC-4.0", "CCBYNC4_name"),
    ("CC-BY-ND-4.0", "CCBYND4_name"),
    ("Unlicense", "Unlicense_grant"),
] + [(name.removesuffix("-only"), f"SPDX_{name}") for name in SPDX]

#: Every known sentence holds one of these inside a word, so a text without them has none, however it is wrapped.
ANCHORS = ("licen", "permission", "permitted", "redistribut", "warrant", "liable", "software", "domain", "mpl", "cc0")
#: Units are lines, cut once more after sentence marks, and after quotes or brackets that follow those.
MARKS = r"""([.!?;:]["')\]]{0,2})[ \t\r\x0B\x0C]+"""
WORD = "A-Za-z0-9.+/-"
EDGES = r"(?<![a-z0-9.+/-])[./-]++|(?<![./-])[./-]++(?![a-z0-9.+/-])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """A sentence in lower case, its punctuation dropped but for dots and signs inside words."""
    s = re.sub(f"[^{WORD}]+", " ", sentence).lower()
    return re.sub(r" +", " ", re.sub(EDGES, "", s)).strip(" ").replace("licence", "license")


#: (normal form, identifier) of every known sentence: a list of fixed length.
KNOWN = sorted({(normal(s), i) for i, group in SENTENCES.items() for s in group})


#: No character but a line end may stand before a sentence, or after it; words stand a space or a line end apart.
START, END, GAP = r"(?<![^\n])", r"(?![^\n])", r"[ \n]"


def _longest(forms: list[list[str]], gap: str = GAP) -> str:
    """A pattern for the longest of ``forms``, lists of words, that ends where a unit does; what forms begin with alike is tried once."""
    if len(forms) == 1:
        return "".join(gap + re.escape(word) for word in forms[0]) + END
    heads = sorted({form[0] for form in forms if form})
    branches = [gap + re.escape(w) + _longest([form[1:] for form in forms if form[:1] == [w]]) for w in heads]
    return f"(?:{'|'.join(branches + [END] * ([] in forms))})"


SENTENCE = START + _longest([n.split(" ") for n, _ in KNOWN], "")


def _units(text: Column) -> Column:
    """The units of a text in normal form, one a line, without empty ones."""
    s = F.regexp_replace(text, MARKS, "$1\n")
    s = F.lower(F.regexp_replace(s, rf"[^\n{WORD}]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, EDGES, ""), " +", " ")
    return F.replace(F.trim(F.regexp_replace(s, r" ?\n[ \n]*", "\n")), F.lit("licence"), F.lit("license"))


def _identifiers(units: Column) -> Column:
    """The identifiers of the known sentences that fill runs of ``units``, in order and apart."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN for x in pair])
    found = F.regexp_extract_all(units, F.lit(SENTENCE), F.lit(0))
    return F.transform(found, lambda x: F.try_element_at(known, F.translate(x, "\n", " ")))


def _hopeful(low: Column) -> Column:
    found = low.contains(ANCHORS[0])
    for word in ANCHORS[1:]:
        found = found | low.contains(word)
    return found


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``licences``, ``sentence_ids``, ``unread_ids``.

    A text is cut into units at line ends and sentence marks; units without a letter or digit,
    such as the bare marks of a comment, are left out. A known sentence is
    found where its words fill a run of whole units, so it may be wrapped, stand in a comment or
    hold such marks itself; of several from one place the longest counts, and what begins inside
    a sentence taken before does not. ``sentence_ids`` is their sequence, ``licences`` the
    licences of the rules that match it, in the rules' order and separated by
    commas, ``unread_ids`` what no rule took; all are empty where there is nothing.
    Null and empty texts have no sentences. Equal rows are scanned each for
    itself; columns of these names are replaced. Each row is worked on where it
    was read, and texts without any word of a licence are not cut.
    """
    docs = docs.drop("licences", "sentence_ids", "unread_ids")
    low = "lower"
    while low in {c.lower() for c in docs.columns}:
        low += "_"
    rows = docs.withColumn(low, F.lower(text_or_empty()))
    ids = F.when(_hopeful(F.col(low)), _identifiers(_units(text_or_empty())))
    rows = rows.withColumn("sentence_ids", F.concat_ws(" ", ids)).withColumn(
        "unread_ids", F.concat(F.lit(" "), F.replace(F.col("sentence_ids"), F.lit(" "), F.lit("  ")), F.lit(" "))
    )
    taken = []
    for k, (licence, rule) in enumerate(RULES):
        sequence = F.lit(padded(rule))
        rows = rows.withColumn(f"rule{k}", F.when(F.contains("unread_ids", sequence), F.lit(licence)))
        rows = rows.withColumn("unread_ids", F.replace(F.col("unread_ids"), sequence, F.lit(" | ")))
        taken.append(f"rule{k}")
    return rows.select(
        *docs.columns,
        F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*taken)))).alias("licences"),
        "sentence_ids",
        unpadded(F.col("unread_ids")).alias("unread_ids"),
    )


def padded(rule: str) -> str:
    """Each identifier between two spaces, so that neighbours do not share one and no part of a name matches."""
    return f" {rule.replace(' ', '  ')} "


def unpadded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit(" ")), " +", " "))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text")


def _sql() -> str:
    known = ", ".join(f"({sql_list([n])}, {sql_list([i])})" for n, i in KNOWN)
    steps, last = [], "padded"
    for k, (licence, rule) in enumerate(RULES):
        steps.append(
            f"r{k} AS (SELECT doc_id, sentence_ids, replace(seq, '{padded(rule)}', ' | ') AS seq, "
            f"CASE WHEN contains(seq, '{padded(rule)}') AND NOT list_contains(licences, '{licence}') "
            f"THEN list_append(licences, '{licence}') ELSE licences END AS licences FROM {last})"
        )
        last = f"r{k}"
    words = "[w FOR w IN [trim(x, './-') FOR x IN regexp_extract_all(line, '[a-z0-9.+/-]+')] IF w <> '']"
    marks = "([.!?;:][\"'')\\]]?[\"'')\\]]?)[ \\t\\r\\x0B\\x0C]+"
    return f"""
WITH RECURSIVE known(form, id) AS (VALUES {known}), first AS (
  SELECT string_split(form, ' ')[1] AS word, max(len(string_split(form, ' '))) AS most FROM known GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS line_at
  FROM (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{marks}', '\\1' || chr(10), 'g'), chr(10)) AS list FROM documents)
), units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_at) AS pos, replace(array_to_string(list, ' '), 'licence', 'license') AS unit
  FROM (SELECT doc_id, line_at, {words} AS list FROM lines) WHERE len(list) > 0
), starts AS (
  SELECT doc_id, pos, most FROM units JOIN first ON word = string_split(unit, ' ')[1]
), runs AS (
  SELECT doc_id, pos, n, array_to_string(list(unit ORDER BY upos), ' ') AS form
  FROM (
    SELECT s.doc_id, s.pos, s.n, u.pos AS upos, u.unit
    FROM (SELECT doc_id, pos, unnest(range(1, most + 1)) AS n FROM starts) s JOIN units u ON u.doc_id = s.doc_id AND u.pos >= s.pos AND u.pos < s.pos + s.n
  ) GROUP BY ALL HAVING count(*) = n
), hits AS MATERIALIZED (
  SELECT doc_id, pos, max(n) AS n, arg_max(id, n) AS id FROM runs JOIN known USING (form) GROUP BY doc_id, pos
), found AS (
  SELECT doc_id, pos, n, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM hits) WHERE k = 1
  UNION ALL
  SELECT doc_id, pos, n, id FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.pos) AS k FROM found f JOIN hits h ON h.doc_id = f.doc_id AND h.pos >= f.pos + f.n
  ) WHERE k = 1
), padded AS (
  SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY pos), '') AS sentence_ids,
    ' ' || coalesce(string_agg(id, '  ' ORDER BY pos), '') || ' ' AS seq, CAST([] AS VARCHAR[]) AS licences
  FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id
), {', '.join(steps)}
SELECT doc_id, array_to_string(licences, ',') AS licences, sentence_ids,
  trim(regexp_replace(replace(seq, '|', ' '), ' +', ' ', 'g'), ' ') AS unread_ids
FROM {last}
"""


OP2_SQL = _sql()
