"""License scans: notice templates with optional and replaceable regions, compiled into token automata.

A template is wording with marks: `<<opt>> ... <</opt>>` may be left out, `<<any:N>>` stands for up to N words of any kind, and
all other words are mandatory. A notice is found where a run of a text's words takes an automaton from its first word, which is
mandatory, to its end, so the mandatory wording stands there exactly and in order. Beside these notices, places of base phrases are
counted.

Defined results: words are runs of ASCII letters and digits and of all non-ASCII bytes, after A-Z is lower-cased; a null text
is empty, has no words, no labels and score 0; repeated rows get the same result each; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WARRANTY = "including but not limited to <<opt>>the<</opt>> implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = f"this software is provided by <<any:8>> as is and any express or implied warranties {_WARRANTY} in no event shall <<any:8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL = "you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version <<any:2>> of the license or at your option any later version <<any:3>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
#: Texts and notices by label; each begins with a mandatory word.
TEMPLATES = {
    "apache-header": "licensed under the apache license version 2 0 <<opt>>the license<</opt>> you may not use this <<any:1>> except in compliance with the license you may obtain a copy of the license at <<any:1>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-notice": "licensed under the apache license <<opt>>version <<any:2>> <</opt>>",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} <<any:1>> neither the name of <<any:12>> may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-attribution": "work is licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<any:4>> international license",
    "cc-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by <<opt>>nc<</opt>> <<opt>>nd<</opt>> <<opt>>sa<</opt>> <<opt>><<any:2>><</opt>>",
    "gpl-header": _GPL.format("general public license"),
    "gpl-notice": "licensed under the gnu <<opt>>lesser<</opt>> general public license <<opt>>version <<any:1>><</opt>>",
    "gpl-redistribution": "you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> general public license as published by the free software foundation",
    "isc": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl-header": _GPL.format("lesser general public license"),
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any:6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software <<opt>>and associated documentation files<</opt>> <<any:4>> to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "mpl-header": "source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<any:1>> mozilla org mpl 2 0",
    "public-domain": "free and unencumbered software released into the public domain",
    "spdx-tag": "spdx license identifier <<any:1>>",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]))


@dataclass
class Automaton:
    """States are positions in the wording. `step` leads from a state by a word, `other` by any word, `free` by none."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=list)
    other: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    must: list[int] = field(default_factory=list)  # mandatory words before each state

    def state(self, must: int) -> int:
        self.step.append({})
        self.other.append(None)
        self.free.append([])
        self.must.append(must)
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def heads(self) -> set[bytes]:
        """Words that a match can begin with."""
        return {w for s in self.closed({0}) for w in self.step[s]}

    def match(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """The end of the longest match from word `at` on, if any, and how many mandatory words were met on the way."""
        end, final, far = None, len(self.step) - 1, 0
        states = self.closed({0})
        for i in range(at, len(words)):
            word = words[i]
            states = self.closed({t for s in states if (t := self.step[s].get(word)) is not None} | {t for s in states if (t := self.other[s]) is not None})
            if not states:
                break
            far = max(far, max(self.must[s] for s in states))
            if final in states:
                end = i + 1
        return end, far


def automaton(label: str, template: str) -> Automaton:
    """The automaton of a template."""
    out = Automaton(label)
    now, opened, must = out.state(0), [], 0
    for mark in re.findall(r"<<[^>]*>>|[^\s<]+", template):
        if mark == "<<opt>>":
            opened.append((now, must))
        elif mark == "<</opt>>":
            was, must = opened.pop()
            end = out.state(must)
            out.free[now].append(end)
            out.free[was].append(end)
            now = end
        elif mark.startswith("<<any:"):
            stops = [now]
            for _ in range(int(mark[6:-2])):
                after = out.state(must)
                out.other[now] = after
                now = after
                stops.append(now)
            end = out.state(must)
            for s in stops:
                out.free[s].append(end)
            now = end
        else:
            must += not opened
            after = out.state(must)
            out.step[now][mark.encode()] = after
            now = after
    out.must = [min(m, must) for m in out.must]
    final = out.state(must)
    out.free[now].append(final)
    return out


def scan(documents: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """`doc_id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score` and `notices` of every row.

    `notices` are the places where a template's whole wording stands. `score` is the largest share of a template's mandatory
    words that the text meets in order, 1 where a notice or a base phrase stands.
    """
    automata = [automaton(label, t) for label, t in (templates or TEMPLATES).items()]
    starts: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for word in a.heads():
            starts.setdefault(word, []).append(a)
    base = [(label, p.encode().split()) for p, label in (phrases or PHRASES).items()]
    anchors = [*starts, *(p[0] for _, p in base)]
    some = re.compile(b"|".join(map(re.escape, sorted(anchors, key=len, reverse=True))))

    def one(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
        low = text.lower()  # bytes: A-Z alone
        words = WORD.findall(low)
        if not some.search(low):
            return len(words), 0, None, None, "", "", 0.0, []
        places: list[int] = []
        found: set[str] = set()
        labels: set[str] = set()
        notices: list[dict] = []
        best = 0.0
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in watched:
                where.setdefault(w, []).append(i)
        for label, phrase in base:
            hits = [i for i in where.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            if hits:
                places += hits
                found.add(label)
        for word, own in starts.items():
            for i in where.get(word, ()):
                for a in own:
                    end, far = a.match(words, i)
                    best = max(best, far / max(1, a.must[-1]))
                    if end is not None and far == a.must[-1]:
                        labels.add(a.label)
                        notices.append({"label": a.label, "first_word": i, "last_word": end - 1})
        best = 1.0 if places else best
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | labels)), best, notices

    watched = set(anchors)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), SPANS]

    def work(part: pa.RecordBatch) -> dict[str, object]:
        data, offsets = tx.utf8(part.column(part.schema.get_field_index("text")))
        data = np.ascontiguousarray(data).tobytes()
        rows = [one(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return tx.map_text(documents, "text", work, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], ["doc_id"])
