"""License scans: license texts as templates with markup, compiled to automata over tokens.

A template is a text. ``[ ... ]`` is a region that may be missing; ``<<a..b>>`` is a place for a to b words of any kind (a
year, a holder). All other words are mandatory: a text is accepted where it has them exactly, in order, with nothing
else between. Letters A-Z are folded; words are runs of letters, digits and non-ASCII characters, so punctuation and line
breaks of texts and templates don't matter. An automaton is started only where the mandatory words that a template
begins with stand in a row (``LEAD`` of them at most).

``scan`` returns a row for each document, from its whole text. Nulls and empty texts have no words, no labels and score 0.
Of several runs that begin at one word the shortest counts. Repeated rows are scanned row by row; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import lean
from ._words import WORD_HASH, hashed_words

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that a template's beginning is looked for by.
LEAD = 6
_WARRANTY = """is provided {by} as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall the {who} be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: [1] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [2]
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
_DISCLAIMED = "This software " + _WARRANTY.format(by="by the <<1..12>>", who="<<1..12>>")
_MIT_END = """The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. In no event shall [the] <<1..12>> be liable for any claim, damages or other liability,
whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""
_ISC_END = """The software is provided "as is" and <<1..12>> disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness. In no event shall <<1..12>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever
resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with
the use or performance of this software."""
_GNU = """This program is free software[:] you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as
published by the Free Software Foundation[,] either version {version} of the License, or (at your option) any later version."""

#: Label and template: the public wording of licenses, their notices, and short references to them.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [(the
      "Software")], to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
      distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
      following conditions: The above copyright notice and this permission notice [(including the next paragraph)] shall be included in all copies
      or substantial portions of the Software. """ + _MIT_END),
    ("mit-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
      "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
      distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. """ + _MIT_END),
    ("isc", """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided that
      the above copyright notice and this permission notice appear in all copies. """ + _ISC_END),
    ("0bsd", """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted. """ + _ISC_END),
    ("bsd-2-clause", _BSD + _DISCLAIMED),
    ("bsd-3-clause", _BSD + """[3] Neither the name of [the] <<1..12>> nor the names of its contributors may be used to endorse or promote products
      derived from this software without specific prior written permission. """ + _DISCLAIMED),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
      arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
      and to alter it and redistribute it freely, subject to the following restrictions: [1] The origin of this software must not be
      misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
      documentation would be appreciated but is not required. [2] Altered source versions must be plainly marked as such, and must not be
      misrepresented as being the original software. [3] This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
      documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
      prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
      The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
      disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
      derivative works are solely in the form of machine-executable object code generated by a source language processor. The Software is provided
      "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a
      particular purpose, title and non-infringement. In no event shall the copyright holders or anyone distributing the Software be liable for any
      damages or other liability, whether in contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other
      dealings in the Software."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
      sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
      means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
      software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
      We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
      law. """ + _MIT_END),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 [(the "License")]; you may not use this file except in compliance with the
      License. You may obtain a copy of the License at <<1..10>> Unless required by applicable law or agreed to in writing, software distributed
      under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
      for the specific language governing permissions and limitations under the License."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
      this file, You can obtain one at <<1..1>> mozilla org MPL 2 0"""),
    *((f"{label}-{version}.0-or-later", _GNU.format(name=name, version=version).replace("[:]", "").replace("[,]", "")) for label, name in (("gpl", ""), ("agpl", "Affero"), ("lgpl", "Lesser")) for version in (2, 3)),
    # References of a line or two.
    ("apache-2.0", "licensed under the apache license [software foundation] version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the [terms of the] mit license"),
    ("mit", "licensed under the [terms of the] mit license"),
    ("gpl-3.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("lgpl", "licensed under the [terms of the] gnu lesser general public license"),
    ("agpl", "licensed under the [terms of the] gnu affero general public license"),
    ("cc-by-nc", "licensed under [a] [the] cc by nc <<1..2>>"),
    ("cc-by-sa", "licensed under [a] [the] cc by sa <<1..2>>"),
    ("cc-by", "licensed under [a] [the] creative commons attribution <<1..2>> [international] license"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution noncommercial <<1..2>> [international] license"),
    ("cc-by-sa", "licensed under [a] [the] creative commons attribution sharealike <<1..2>> [international] license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("copyright-notice", "copyright [c] <<1..8>> all rights reserved"),
    ("spdx", "spdx license identifier <<1..1>>"),
]
_PART = re.compile(r"<<\d+\.\.\d+>>|[\[\]]|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def parts(template: str) -> list[str]:
    """Words, ``[``, ``]`` and ``<<a..b>>`` of a template."""
    return _PART.findall(template.translate({c: c + 32 for c in range(0x41, 0x5B)}))


class Automaton:
    """States of a template. ``step``: word hash to next state; ``wild``: next state for any word; ``skip``: free moves."""

    def __init__(self, template: str):
        self.step: list[dict[int, int]] = [{}]
        self.wild: list[int | None] = [None]
        self.skip: list[set[int]] = [set()]
        self.lead: list[int] = []  # the mandatory words that stand first
        self.longest = 0
        opened: list[int] = []
        plain = True
        for part in parts(template):
            here = len(self.step) - 1
            if part == "[":
                opened.append(here)
            elif part == "]":
                self.skip[opened.pop()].add(here)
            elif part.startswith("<<"):
                low, high = (int(x) for x in part[2:-2].split(".."))
                self.longest += high
                made = [here]
                for _ in range(high):
                    self.wild[-1] = len(self.step)
                    self._state()
                    made.append(len(self.step) - 1)
                for s in made[low:-1]:
                    self.skip[s].add(made[-1])
            else:
                word = int(WORD_HASH.words([part])[0])
                self.longest += 1
                if plain and len(self.lead) < LEAD:
                    self.lead.append(word)
                self.step[here][word] = here + 1
                self._state()
            plain = plain and part not in "[]" and part[0] != "<"
        if opened or not self.lead or self.skip[0]:
            raise ValueError(f"a template starts with a mandatory word and closes its regions: {template}")
        self.end = len(self.step) - 1

    def _state(self) -> None:
        self.step.append({})
        self.wild.append(None)
        self.skip.append(set())

    def _free(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def accepts(self, words: list[int], at: int) -> int:
        """The end (exclusive) of the shortest accepted run of words that begins at ``at``; -1 if there is none."""
        states = self._free({0})
        while states:
            if self.end in states:
                return at
            if at >= len(words):
                return -1
            w, new = words[at], set()
            for s in states:
                if (n := self.step[s].get(w)) is not None:
                    new.add(n)
                if (n := self.wild[s]) is not None:
                    new.add(n)
            states, at = self._free(new), at + 1
        return -1


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def _places(words: np.ndarray, bounds: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively within one text."""
    at = np.flatnonzero(words[: max(0, len(words) - len(phrase) + 1)] == phrase[0])
    for k, w in enumerate(phrase[1:].tolist(), 1):
        at = at[words[at + k] == np.uint64(w)]
    doc = np.searchsorted(bounds, at, "right") - 1
    return at[at + len(phrase) <= bounds[doc + 1]]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of ``docs`` (doc_id, text).

    base_labels: those of phrases; labels: of phrases and accepted templates; both distinct, sorted, comma-joined.
    spans: label, first and last word of each accepted run. score: 1 with a template, 0.5 with phrases only, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = tuple(TEMPLATES if templates is None else templates)
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(label, WORD_HASH.words(p.split())) for p, label in phrases.items()]
        automata = _compiled(templates)
        for b in batches:
            for i, j, words, at in hashed_words(b.column(1)):
                n = np.diff(at)
                n_base, first, last = np.zeros(j - i, np.int64), np.full(j - i, np.iinfo(np.int64).max), np.full(j - i, -1)
                named: list[set[str]] = [set() for _ in range(j - i)]
                for label, phrase in base:
                    p = _places(words, at, phrase)
                    doc = np.searchsorted(at, p, "right") - 1
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(first, doc, p - at[doc])
                    np.maximum.at(last, doc, p - at[doc])
                    for d in np.unique(doc).tolist():
                        named[d].add(label)
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                for label, a in automata:
                    for p in _places(words, at, np.array(a.lead, np.uint64)).tolist():
                        d = int(np.searchsorted(at, p, "right")) - 1
                        end = a.accepts(words[p : min(int(at[d + 1]), p + a.longest)].tolist(), 0)
                        if end >= 0:
                            spans[d].append({"label": label, "first": int(p - at[d]), "last": int(p - at[d] + end - 1)})
                for own in spans:
                    own.sort(key=lambda x: (x["first"], x["last"], x["label"]))
                yes = n_base > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(n),
                        pa.array(n_base),
                        pa.array(first, mask=~yes),
                        pa.array(last, mask=~yes),
                        pa.array([",".join(sorted(x)) for x in named]),
                        pa.array([",".join(sorted(x | {s["label"] for s in y})) for x, y in zip(named, spans, strict=True)]),
                        pa.array([1.0 if y else 0.5 if x else 0.0 for x, y in zip(named, spans, strict=True)]),
                        pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
                    ],
                    schema.names,
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(lean(run), schema)
