"""Licence scan by sentence rules.

Texts are split into sentences (at newlines, and after . ! ? before white space) and normalised to lower-case
words.  A known sentence may be wrapped over several lines, with comment marks before each: it begins where a part
begins and ends where one ends, and the line ends between are blanks.  A sentence end inside it counts only where the known text
has one (``v. 2.0``).  A notice may go on with a clause that begins with a word of ``TRAIL`` ("..., see LICENSE"), and
after ``SPDX-License-Identifier:`` every licence of an expression counts.  A sentence that is known carries an identifier;
a document's identifiers, in order, are matched against ordered rules, each a sequence of identifiers between which others
may stand.  Of a licence's rules the longest that matches is reported.  A rule that a longer one of another licence
contains (the two-clause BSD text in the three-clause one) is matched against the identifiers which that one leaves.

Every known sentence holds one of ``ANCHORS`` inside a word, so only texts with an anchor are split.  The dictionary is a trie
of words, made once in each worker, where the rules are matched too, in one pass over the identifiers for each rule whose
identifiers are all there.  ``ORACLE`` knows sentences on one line only.

Defined cases: null and empty texts have no licence; of rows that are equal in doc_id and text one is reported; a
null doc_id is carried through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = r"[.!?]+(\s+|$)|\n"
ANCHORS = ("licen", "permission", "warrant", "redistribut", "domain", "spdx", "gnu", "cc", "commons")

_NAMES = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license version 3 0", "gnu gpl version 3", "gplv3 license", "gpl 3 0 license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license version 2 0", "gplv2 license", "gpl 2 0 license"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3 0 license"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl 3 0 license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "ISC": ["isc license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "CC-BY-4.0": ["cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal license"],
}
_SHORT = {
    "MIT": ["mit x11 license", "expat license"], "Apache-2.0": ["apache license v2 0", "apache license v2", "apache 2 license", "apache v2"],
    "GPL-3.0": ["gplv3", "gpl v3", "gpl version 3", "gnu gpl v3", "gnu general public license v3", "gnu general public license v3 0"],
    "GPL-2.0": ["gplv2", "gpl v2", "gpl version 2", "gnu gpl v2", "gnu gpl version 2", "gnu general public license v2", "gnu general public license v2 0"],
    "LGPL-3.0": ["lgplv3", "lgpl v3"], "AGPL-3.0": ["agplv3", "agpl v3"], "MPL-2.0": ["mpl v2 0"], "BSL-1.0": ["boost license"],
}
_SUBJECTS = ["", "this work is ", "this software is ", "this project is ", "this program is ", "this code is ", "this file is ", "this document is ", "this library is ", "the code is ", "source code is ", "content is "]
_VERBS = ["licensed", "released", "distributed", "available", "published", "made available", "provided"]
_LONG = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "See the GNU General Public License for more details",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "See the GNU General Public License for more details",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def normal(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def _tables() -> tuple[dict[str, str], dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """(known sentence -> identifier, SPDX name -> identifier, rules (licence, rule, identifiers)).

    A sentence that several licences share has one identifier, which the rules of all of them name.
    """
    known: dict[str, str] = {}
    spdx: dict[str, str] = {}
    rules = []
    for name, texts in _LONG.items():
        ids = [known.setdefault(normal(t), f"{normal(name).replace(' ', '_')}_{k}") for k, t in enumerate(texts)]
        rules.append((name, "full", tuple(ids)))
        if len(ids) > 2:
            # the first two sentences, and what tells the text from a shorter one that begins alike
            alike = [len(o) for n, k, o in rules if k == "full" and n != name and o[:2] == tuple(ids[:2]) and len(o) < len(ids)]
            rules.append((name, "partial", tuple(ids[:2] + (ids[max(alike) :] if alike else []))))
    for name, forms in _NAMES.items():
        code = f"{normal(name).replace(' ', '_')}_notice"
        for form in [*forms, *_SHORT.get(name, []), normal(name)]:
            for the in ("the ", "a ", ""):
                for subject in _SUBJECTS:
                    for verb in _VERBS:
                        if any(a in verb + form for a in ANCHORS):  # a bare "released under mit" is found by no anchor
                            known.setdefault(f"{subject}{verb} under {the}{form}", code)
                            known.setdefault(f"{subject}{verb} under the terms of {the}{form}", code)
        spdx[normal(name)] = code
        rules.append((name, "notice", (code,)))
    return known, spdx, rules


KNOWN, SPDX, RULES = _tables()
TRAIL = frozenset("see for as in which please unless with and or refer".split())
_TAG = "spdx license identifier "
_JOIN = "( (or|and|with|only|later))+( |$)"


def _inside(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    it = iter(long)
    return all(x in it for x in short)


#: for each rule, those of other licences that contain it, the longest first
CONTAINERS = [sorted((o[2] for o in RULES if o[0] != name and len(o[2]) > len(ids) and _inside(ids, o[2])), key=len, reverse=True) for name, _, ids in RULES]
_CUT = re.compile(f"({SPLIT.replace('(', '(?:')})", re.ASCII)
_WORD = re.compile("[a-z0-9]+")
_CODE, _STOP = "", "."  # keys of a trie node beside words: the sentence's code, a sentence end inside it


def _trie() -> dict:
    root: dict = {}

    def add(path: list[str], code: str) -> None:
        node = root
        for word in path:
            node = node.setdefault(word, {})
        node[_CODE] = code

    for sentence, code in KNOWN.items():
        add(sentence.split(), code)
    for texts in _LONG.values():
        for t in texts:
            parts = [_WORD.findall(p) for p in _CUT.split(t.lower().rstrip(".:"))[::2]]
            add([w for k, p in enumerate(parts) for w in ([_STOP, *p] if k else p)], KNOWN[normal(t)])
    return root


TRIE = _trie()


def sentences(low: str) -> list[tuple[int, str]]:
    """(number of the part it begins in, code) of the known sentences of a lower-case text, ordered."""
    cut = _CUT.split(low)
    out = set()
    for i in range(0, len(cut), 2):
        if "spdx" in cut[i] and _TAG in (s := " ".join(_WORD.findall(cut[i])) + " "):
            names = re.split(_JOIN.replace("(", "(?:"), s[s.index(_TAG) + len(_TAG) :].rstrip())
            out.update((i // 2, SPDX[x]) for x in names if x in SPDX)
        first = _WORD.search(cut[i])
        if first is None or first.group() not in TRIE:
            continue
        node = TRIE
        for k in range(i, len(cut), 2):
            words = _WORD.findall(cut[k])
            if k > i and cut[k - 1] != "\n":
                node = node.get(_STOP)
            for w in words:
                if node is None:
                    break
                if w in TRAIL and (code := node.get(_CODE, "")).endswith("_notice"):
                    out.add((i // 2, code))
                node = node.get(w)
            if node is None:
                break
            if words and _CODE in node:
                out.add((i // 2, node[_CODE]))
    return sorted(out)


def _next(seq: list[str], ids: tuple[str, ...], at: int) -> list[int]:
    """Places of the first occurrence of ``ids``, in order, from ``at`` on; empty if there is none."""
    places = []
    for x in ids:
        try:
            at = seq.index(x, at)
        except ValueError:
            return []
        places.append(at)
        at += 1
    return places


def _without(seq: list[str], ids: tuple[str, ...]) -> list[str]:
    """What the occurrences of ``ids``, one after the other, leave."""
    used: set[int] = set()
    at = 0
    while places := _next(seq, ids, at):
        used.update(places)
        at = places[-1] + 1
    return [x for i, x in enumerate(seq) if i not in used]


def matched(seq: list[str]) -> list[tuple[str, str, int]]:
    """(licence, rule, sentences of the rule) of a document's identifiers in order."""
    have, best = set(seq), {}
    for (name, kind, ids), longer in zip(RULES, CONTAINERS):
        if not have.issuperset(ids):
            continue
        rest = seq
        for other in longer:
            if have.issuperset(other):
                rest = _without(rest, other)
        if _next(rest, ids, 0):
            best[name] = max(best.get(name, (0, "")), (len(ids), kind))
    return [(name, kind, n) for name, (n, kind) in best.items()]


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r, low in enumerate(batch.column(2).to_pylist()):
            if hits := sentences(low):
                rows += [(r, *found, hits[0][0]) for found in matched([code for _, code in hits])]
        if rows:
            r, name, kind, n, first = zip(*rows)
            at = pa.array(r, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(name), pa.array(kind), pa.array(n, pa.int32()), pa.array(first, pa.int32())], names=["doc_id", "tie", "license", "rule", "n_sentences", "first_sentence"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, rule, n_sentences (of the rule), first_sentence (number of the first known sentence)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("low"))
    texts = texts.where(" OR ".join(f"contains(low, '{a}')" for a in ANCHORS))
    found = texts.select("doc_id", F.xxhash64("low").alias("tie"), "low").mapInArrow(_finder, "doc_id bigint, tie bigint, license string, rule string, n_sentences int, first_sentence int")
    return found.distinct().drop("tie")


def _values(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _pattern(ids: tuple[str, ...], between: str = "(<[^>]*>)*") -> str:
    return between.join(f"<{i}>" for i in ids)


def _duck_rule(rule: tuple[str, str, tuple[str, ...]], longer: list[tuple[str, ...]]) -> str:
    rest = "ids"
    for other in longer:
        rest = f"regexp_replace({rest}, '{_pattern(other, '((?:<[^>]*>)*?)')}', '{''.join(f'{chr(92)}{k}' for k in range(1, len(other)))}', 'g')"
    return f"SELECT doc_id, text, first_sentence, '{rule[0]}' AS license, '{rule[1]}' AS rule, {len(rule[2])} AS n_sentences FROM seqs WHERE regexp_matches({rest}, '{_pattern(rule[2])}')"


ORACLE = f"""WITH known(sentence, code) AS (VALUES {_values(sorted(KNOWN.items()))}), spdx(name, code) AS (VALUES {_values(sorted(SPDX.items()))}),
rules(license, rule, n_sentences, pattern) AS (VALUES {_values([(n, k, len(i), _pattern(i)) for (n, k, i), longer in zip(RULES, CONTAINERS) if not longer])}),
parts AS (SELECT doc_id, text, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT DISTINCT doc_id, text, regexp_split_to_array(lower(text), '{SPLIT}') AS p FROM documents)),
normal AS (SELECT doc_id, text, pos, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
hits AS (SELECT doc_id, text, pos, code FROM normal JOIN known ON sentence = s
  UNION SELECT doc_id, text, pos, code FROM (SELECT *, regexp_replace(s, ' ({"|".join(sorted(TRAIL))})( .*)?$', '') AS head FROM normal) JOIN known ON sentence = head AND ends_with(code, '_notice')
  UNION SELECT doc_id, text, pos, code FROM (SELECT doc_id, text, pos, unnest(string_split_regex(regexp_extract(s, '{_TAG}(.*)$', 1), '{_JOIN}')) AS name FROM normal WHERE contains(s, '{_TAG}')) JOIN spdx USING (name)),
seqs AS (SELECT doc_id, text, string_agg('<' || code || '>', '' ORDER BY pos, code) AS ids, min(pos) AS first_sentence FROM hits GROUP BY doc_id, text),
found AS (SELECT doc_id, text, first_sentence, license, rule, n_sentences FROM seqs JOIN rules ON regexp_matches(ids, pattern)
  {" ".join("UNION ALL " + _duck_rule(x, longer) for x, longer in zip(RULES, CONTAINERS) if longer)}),
best AS (SELECT doc_id, text, license, max({{'n': n_sentences, 'rule': rule}}) AS b, any_value(first_sentence) AS first_sentence FROM found GROUP BY 1, 2, 3)
SELECT doc_id::BIGINT AS doc_id, license, b.rule AS rule, b.n::INT AS n_sentences, first_sentence::INT AS first_sentence FROM best"""
