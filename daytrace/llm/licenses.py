"""License scans by sentence rules.

A text is brought to a normal form (words, and marks where a line or a sentence ends) and searched for known licence sentences,
which begin and end at such marks but may be wrapped over any lines, with comment signs before them; the identifiers of
consecutive sentences form a sequence, and an ordered list of rules claims parts of it, longer evidence before shorter.
A part that one rule has claimed is closed to the rules after it; other text between two sentences breaks a sequence, list
labels do not. ``SENTENCES`` and ``RULES`` are the part that the SQL knows, for one-line notices.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from daytrace.llm.common import text_or_empty

# Known sentences in normal form (lower case, letters and digits, single spaces) by identifier.
SENTENCES = {
    "ApacheBy": ["licensed under the apache license version 2 0"],
    "ApacheCompliance": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "AsIsBasis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "BsdAllowed": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdNoEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CcByBy": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CcByNcBy": ["licensed under cc by nc 4 0"],
    "CcBySaBy": ["licensed under cc by sa 4 0"],
    "Gpl2By": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"],
    "Gpl3By": ["licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3"],
    "LaterVersion": ["or at your option any later version"],
    "MitBy": ["released under the mit license", "licensed under the mit license"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": ["the software is provided as is without warranty of any kind express or implied"],
    "AllRights": ["all rights reserved"],
}
# A licence and the sequence of identifiers that shows it, in the order in which rules claim sentences.
RULES = [
    ("Apache-2.0", ["ApacheBy", "ApacheCompliance", "ApacheCopy", "AsIsBasis"]),
    ("BSD-3-Clause", ["BsdAllowed", "BsdSource", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdAllowed", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitBy", "MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("GPL-3.0-or-later", ["Gpl3By", "LaterVersion"]),
    ("GPL-2.0-or-later", ["Gpl2By", "LaterVersion"]),
    ("Apache-2.0", ["ApacheBy"]),
    ("CC-BY-4.0", ["CcByBy"]),
    ("CC-BY-NC-4.0", ["CcByNcBy"]),
    ("CC-BY-SA-4.0", ["CcBySaBy"]),
    ("GPL-2.0-only", ["Gpl2By"]),
    ("GPL-3.0-only", ["Gpl3By"]),
    ("MIT", ["MitBy"]),
    ("MIT", ["MitGrant"]),
    ("Proprietary", ["AllRights"]),
]
# Whole sentences of the licence texts themselves; * stands for a name of some words.
_GPL, _FSF = "is free software you can redistribute it and or modify it under the terms of the", "as published by the free software foundation"
_KINDS = {"Gpl": "general", "Lgpl": "lesser general", "Agpl": "affero general"}
_DAMAGES = "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_UNDER = [f"{start}{verb} under the" for start in ("", "this * is ", "the * is ") for verb in ("licensed", "released", "distributed")]
WHOLE = {
    "ApacheBy": [f"{u} apache license version 2 0" for u in _UNDER] + [f"{u} apache license 2 0" for u in _UNDER],
    "ApacheHeader": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed to * under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "ApacheTitle": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "MitBy": [f"{u} mit license" for u in _UNDER] + ["mit license", "the mit license", "the mit license mit"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "MitAsIs": [f"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {n}" for n in ("noninfringement", "non infringement")],
    "MitLiability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "IscGrant": [f"permission to use copy modify {a} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for a in ("and or", "and")],
    "IscAsIs": ["the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "IscLiability": ["in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "BsdNoEndorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdAsIs": ["this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BsdLiability": [f"in no event shall * {_DAMAGES}"],
    **{f"BsdTitle{k}": [f"bsd {k} clause license"] for k in (2, 3)},
    "GplWithout": ["* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplSee": [f"see the gnu {k} public license for more details" for k in _KINDS.values()],
    "GplReceived": [f"you should have received a copy of the gnu {k} public license along with *{www}" for k in _KINDS.values() for www in ("", " if not see http www gnu org licenses", " if not see https www gnu org licenses")],
    **{f"{n}{v[0]}{v[2:]}Terms{end}": [f"* {_GPL} gnu {k} public license " + (f"{_FSF} either version {v} of the license or at your option any later version" if end else f"version {v} {_FSF}")] for n, k in _KINDS.items() for v in {"Gpl": ("2", "3"), "Lgpl": ("2 1", "3"), "Agpl": ("3",)}[n] for end in ("Later", "")},
    "MplTerms": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "MplCopy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {www} mozilla org mpl 2 0" for www in ("http", "https")],
    "Cc0By": ["cc0 1 0 universal", "licensed under cc0 1 0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"],
    "CcByBy": ["this work is licensed under the creative commons attribution 4 0 international license"],
    "CcByNcBy": [f"this work is licensed under {a} creative commons attribution noncommercial 4 0 international license" for a in ("a", "the")],
    "CcBySaBy": [f"this work is licensed under {a} creative commons attribution sharealike 4 0 international license" for a in ("a", "the")],
    "Gpl2By": [f"{u} gnu general public license version 2" for u in _UNDER],
    "Gpl3By": [f"{u} gnu general public license version 3" for u in _UNDER],
}
_BSD, _MIT, _ISC = ["BsdAllowed", "BsdSource", "BsdBinary"], ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"], ["IscGrant", "IscAsIs", "IscLiability"]
_APACHE = [["ApacheHeader", "ApacheCopy", "AsIsBasis", "ApacheSee"], ["ApacheHeader", "ApacheCopy", "AsIsBasis"], ["ApacheHeader"], ["ApacheTitle"]]
_TERMS = [(f"{k.upper()}-{v}", f"{k}{v[0]}{v[2:] if v[2:] != '0' else ''}Terms") for k, v in (("Gpl", "2.0"), ("Gpl", "3.0"), ("Lgpl", "2.1"), ("Lgpl", "3.0"), ("Agpl", "3.0"))]
# Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = "Apache-2.0 MIT ISC BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0".split()
_SAYS = "spdx license identifier"
_OLD = {f"{k} {v}{p}": f"{k.upper()}-{v.replace(' ', '.')}-{e}" for k, v in (("gpl", "2 0"), ("gpl", "3 0"), ("lgpl", "2 1"), ("lgpl", "3 0"), ("agpl", "3 0")) for p, e in (("", "only"), (" or later", "or-later"))}
_NAMED = {re.sub("[-.]", " ", n.lower()): n for n in SPDX} | _OLD
_WITH_RIGHTS = [
    *[("BSD-3-Clause", [*_BSD, "BsdNoEndorse", *e]) for e in (["BsdAsIs", "BsdLiability"], ["BsdAsIs"], [])],
    *[("BSD-2-Clause", [*_BSD, *e]) for e in (["BsdAsIs", "BsdLiability"], ["BsdAsIs"], [])],
    ("MIT", _MIT), ("ISC", _ISC), ("ISC", _ISC[:1]), *[(f"BSD-{k}-Clause", [f"BsdTitle{k}"]) for k in (2, 3)],
    *[("Apache-2.0", seq) for seq in _APACHE],
]
WHOLE_RULES = [
    *[(n, ["AllRights", *seq]) for n, seq in _WITH_RIGHTS],
    *_WITH_RIGHTS,
    *[(f"{n}-{end}", [t + mark, *rest]) for n, t in _TERMS for end, mark in (("or-later", "Later"), ("only", "")) for rest in (["GplWithout", "GplSee", "GplReceived"], ["GplWithout", "GplSee"], [])],
    ("MPL-2.0", ["MplTerms", "MplCopy"]), ("MPL-2.0", ["MplTerms"]), ("CC0-1.0", ["Cc0By"]),
    *[(n, [f"Spdx{n}"]) for n in SPDX],
]
ALL_SENTENCES = {n: [*SENTENCES.get(n, []), *WHOLE.get(n, [])] for n in {**SENTENCES, **WHOLE}}
ALL_SENTENCES |= {f"Spdx{n}": [f"{_SAYS} {k}" for k, m in _NAMED.items() if m == n] for n in SPDX}
ALL_RULES = [*WHOLE_RULES, *RULES]
# Every known sentence has one of these words.
CUES = ["licen", "permi", "redistribut", "warrant", "any later version", "all rights reserved"]
# Every sentence of the whole texts has one of these or of the cues above.
WHOLE_CUES = [*CUES, "in no event", "disclaims all", "contributors", "mozilla", "mpl", "cc0", "waived"]
END, OTHER, CLAIMED = "|", "-", "="
FOUND = "\u0001"


def normal(text: Column) -> Column:
    """Lower-case words with one space, or one line end where a line, sentence or lead-in (a colon) ends, between two of them."""
    lines = F.regexp_replace(F.lower(text), r"([.!?:])[ \t]+", "$1\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(lines, r"[^\p{L}\p{N}\n]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n"))


def _pattern(forms: list[str]) -> str:
    """Any of the forms between two marks, wrapped at will, with a list label before it at most."""
    word, gap = r"[\p{L}\p{N}]+", "[ \n]"
    one = lambda form: gap.join(f"{word}(?:{gap}{word}){{0,11}}?" if w == "*" and k else f"{word}(?: {word}){{0,7}}?" if w == "*" else w for k, w in enumerate(form.split(" ")))
    return rf"(?<![^\n])(?:(?:\d{{1,2}}|[a-z]){gap})?(?:{'|'.join(map(one, sorted(forms, key=len, reverse=True)))})(?![^\n])"


def identifiers(text: Column) -> Column:
    """The sequence of a text as one string: each identifier or other stretch closed by a bar. Empty sentences (blank lines,
    lone marks) and list labels neither count nor break a sequence."""

    def named(words: Column) -> Column:
        out, ids = words, "|".join(sorted(_NAMED, key=len, reverse=True))
        for _ in range(3):  # SPDX expressions: one line for each licence
            out = F.regexp_replace(out, rf"({_SAYS}[ \n](?:{ids})) (?:or|and) (?=(?:{ids})(?: or | and |\n|$))", f"$1\n{_SAYS} ")
        for name in sorted(ALL_SENTENCES, key=lambda n: -max(map(len, ALL_SENTENCES[n]))):
            out = F.regexp_replace(out, _pattern(ALL_SENTENCES[name]), f"{FOUND}@{name}{FOUND}")
        parts = F.filter(F.split(out, FOUND), lambda s: ~s.rlike(r"^[ \n]*(?:(?:\d{1,2}|[a-z])[ \n]*)?$"))
        names = F.transform(parts, lambda s: F.when(s.startswith("@"), F.substring(s, 2, 100)).otherwise(F.lit(OTHER)))
        return F.when(has_cue(words), F.concat(F.lit(END), F.array_join(names, END), F.lit(END))).otherwise(F.lit(END))

    return F.element_at(F.transform(F.array(normal(text)), named), 1)


def has_cue(words: Column) -> Column:
    return F.translate(words, "\n", " ").rlike("|".join(WHOLE_CUES))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, licences (names in the order of ``RULES``, then the others, once each, joined with commas),
    n_sentences (known licence sentences) and unclaimed (identifiers that no rule has claimed, in order, joined with commas).
    Null and empty texts have none."""
    left = docs.select(F.col(f"`{id_col}`").alias("id"), identifiers(text_or_empty(text_col)).alias("ids"))
    known = F.size(F.filter(F.split("ids", r"\|"), lambda s: ~s.isin("", OTHER)))
    # what a rule claims becomes its name; twice, as two neighbours share the bar between them
    rules = F.array(*[F.struct(F.lit(f"{END}{END.join(seq)}{END}").alias("seq"), F.lit(f"{END}{CLAIMED}{name}{END}").alias("to")) for name, seq in ALL_RULES])
    claim = lambda ids, r: F.replace(F.replace(ids, r["seq"], r["to"]), r["seq"], r["to"])
    state = left.select("id", known.alias("n_sentences"), F.split(F.aggregate(rules, F.col("ids"), claim), r"\|").alias("parts"))
    rest = F.filter("parts", lambda s: ~s.isin("", OTHER) & ~s.startswith(CLAIMED))
    order = dict.fromkeys(name for name, _ in [*RULES, *WHOLE_RULES])
    names = F.filter(F.array(*map(F.lit, order)), lambda n: F.array_contains("parts", F.concat(F.lit(CLAIMED), n)))
    return state.select(F.col("id").alias(id_col), F.array_join(names, ",").alias("licences"), "n_sentences", F.array_join(rest, ",").alias("unclaimed"))


def oracle_sql() -> str:
    """The same for DuckDB, over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(f)}, {quote(n)})" for n, forms in SENTENCES.items() for f in forms)
    steps, last = [], "seqs"
    for k, (_, sequence) in enumerate(RULES):
        wanted, to = quote(f"|{'|'.join(sequence)}|"), quote("|=|")
        steps.append(f"r{k} AS (SELECT *, replace(replace({'ids' if k == 0 else f'ids{k}'}, {wanted}, {to}), {wanted}, {to}) AS ids{k + 1} FROM {last})")
        last = f"r{k}"
    names = ", ".join(f"CASE WHEN ids{k + 1} <> {'ids' if k == 0 else f'ids{k}'} THEN {quote(name)} END" for k, (name, _) in enumerate(RULES))
    order = ", ".join(quote(n) for n in dict.fromkeys(name for name, _ in RULES))
    return f"""
WITH known(form, name) AS (VALUES {rows}),
lines AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1\n', 'g'), '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g'), '\n')) AS s,
  unnest(range(len(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1\n', 'g'), '\n')))) AS pos FROM documents),
named AS (SELECT l.doc_id, l.pos, coalesce(k.name, '-') AS name FROM lines l LEFT JOIN known k ON k.form = trim(l.s) WHERE trim(l.s) <> ''),
per_doc AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS s, count(*) FILTER (WHERE name <> '-') AS n FROM named GROUP BY doc_id),
seqs AS (SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN '|' || s || '|' ELSE '|' END AS ids FROM documents d LEFT JOIN per_doc USING (doc_id)),
{', '.join(steps)},
said AS (SELECT *, [x FOR x IN [{names}] IF x IS NOT NULL] AS found FROM {last})
SELECT doc_id, array_to_string([x FOR x IN [{order}] IF list_contains(found, x)], ',') AS licences, n AS n_sentences,
  array_to_string([x FOR x IN string_split(ids{len(RULES)}, '|') IF x NOT IN ('', '-', '=')], ',') AS unclaimed FROM said
"""
