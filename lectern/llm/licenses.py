"""Licence scans: matching statistics of files against licence templates, chained into covered spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Phrases that name a licence, with the label each gives.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Whole texts and notices of public licences, with the label each gives.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""),
    ("mit", """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at"""),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl", """You should have received a copy of the GNU General Public License along with this program."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""),
    ("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("isc", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "All rights reserved."),
)

# runs of digits, ASCII letters and any character beyond ASCII
_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """The words of a whole text with A-Z lower-cased; none for null and empty texts."""
    return _WORDS.findall((text or "").translate(_FOLD))


@dataclass
class Automaton:
    """A suffix automaton of several token sequences: states by number, 0 is the root.

    go: transitions of each state; longest: length of its longest string; link: its suffix link;
    ends: phrases that are a suffix of its longest string; places: (template, index) of all ends of its strings.
    """

    go: list[dict[str, int]]
    longest: list[int]
    link: list[int]
    ends: list[tuple[tuple[int, int], ...]]
    places: list[tuple[tuple[int, int], ...]]


def build(sequences: list[list[str]], phrases: list[list[str]]) -> Automaton:
    """The generalised suffix automaton of the sequences and the phrases, one state chain for each.

    Each sequence starts again at the root, so no string spans two of them. A phrase is known at the
    state of its string, and every state whose suffix links reach that state inherits it.
    """
    go, longest, link = [{}], [0], [-1]
    at_end: dict[int, list[tuple[int, int]]] = {}

    def state(length, edges, to):
        go.append(edges)
        longest.append(length)
        link.append(to)
        return len(go) - 1

    def split(p, w, q):
        if longest[p] + 1 == longest[q]:
            return q
        twin = state(longest[p] + 1, dict(go[q]), link[q])
        link[q] = twin
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = twin
            p = link[p]
        return twin

    def extend(last, w):
        if w in go[last]:
            return split(last, w, go[last][w])
        own, p = state(longest[last] + 1, {}, 0), last
        while p >= 0 and w not in go[p]:
            go[p][w] = own
            p = link[p]
        if p >= 0:
            link[own] = split(p, w, go[p][w])
        return own

    for number, tokens in enumerate(sequences + phrases):
        last = 0
        for i, w in enumerate(tokens):
            last = extend(last, w)
    # a state's strings end where the prefixes of sequences end whose states inherit from it
    for number, tokens in enumerate(sequences):
        last = 0
        for i, w in enumerate(tokens):
            last, up = go[last][w], go[last][w]
            while up > 0:
                at_end.setdefault(up, []).append((number, i))
                up = link[up]
    at_state: dict[int, list[tuple[int, int]]] = {}
    for number, tokens in enumerate(phrases):
        s = 0
        for w in tokens:
            s = go[s][w]
        at_state.setdefault(s, []).append((number, len(tokens)))
    ends = []
    for s in range(len(go)):
        found, up = list(at_state.get(s, [])), link[s]
        while up > 0:
            found += at_state.get(up, [])
            up = link[up]
        ends.append(tuple(found))
    return Automaton(go, longest, link, ends, [tuple(at_end.get(s, ())) for s in range(len(go))])


class Scanner:
    """Streams the words of a file through the automaton of phrases and templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 3, gap: int = 3, covered: float = 0.6):
        """least: words of a match that counts for a chain; gap: words a chain may leave out on either
        side; covered: part of a template that its chained matches must cover for its label."""
        self.phrases = [(words(p), label) for p, label in phrases]
        self.templates = [(words(t), label) for label, t in templates]
        self.auto = build([t for t, _ in self.templates], [p for p, _ in self.phrases])
        self.least, self.gap, self.covered = least, gap, covered

    def scan(self, found: list[str]) -> dict:
        """What a list of words holds: phrase places and covered template spans.

        The matching statistic of a word is the longest string that ends there and occurs in a
        template. A match of a template is a string of least words or more that goes on in that template on
        neither side; matches that follow each other in file and template, with at most gap words between on
        either side, are chained to a span. Every chain stays open until the gap is passed, so a stray match between
        does not end it. A span's coverage is the part of the template's words that its matches cover. Chains that
        a longer one continues are not spans of their own; of equal spans the earlier stands first.
        """
        go, longest, link, ends = self.auto.go, self.auto.longest, self.auto.link, self.auto.ends
        known, s, length = go[0], 0, 0
        places, matches = [], []
        for j, w in enumerate(found):
            if w in go[s]:
                s, length = go[s][w], length + 1
            elif w not in known:
                s = length = 0
                continue
            else:
                while s and w not in go[s]:
                    s = link[s]
                length = longest[s] + 1
                s = go[s][w]
            for number, size in ends[s]:
                if length >= size:
                    places.append((j - size + 1, number))
            if length >= self.least:
                self._ended(found, j, s, length, matches)
        return {"places": places, "spans": self._chain(matches)}

    def _ended(self, found, j, s, length, matches) -> None:
        """The matches whose last word is j: the state's places, and those of the shorter strings it inherits from."""
        seen, after = set(), found[j + 1] if j + 1 < len(found) else None
        size = length
        while s > 0 and size >= self.least:
            for number, at in self.auto.places[s]:
                if (number, at) not in seen:
                    seen.add((number, at))
                    template = self.templates[number][0]
                    if at + 1 == len(template) or template[at + 1] != after:
                        matches.append((j - size + 1, number, at - size + 1, size))
            s = self.auto.link[s]
            size = self.auto.longest[s]

    def _chain(self, matches):
        open_: dict[int, list[dict]] = {}
        done = []
        for word, number, at, size in sorted(matches):
            still = []
            for c in open_.get(number, ()):
                (still if word - c["end"] <= self.gap else done).append(c)
            best = None
            for c in still:
                # a match may begin inside the one before it: the shared words count once
                skip = max(0, c["end"] - word, c["to"] - at)
                if skip < size and at + skip - c["to"] <= self.gap and c["end"] <= word + skip:
                    hit = c["hit"] + size - skip
                    if best is None or hit > best["hit"]:
                        best = {"number": number, "start": c["start"], "end": word + size, "to": at + size, "hit": hit, "from": c}
            if best is None:
                best = {"number": number, "start": word, "end": word + size, "to": at + size, "hit": size}
            else:
                best.pop("from")["longer"] = True
            open_[number] = [*still, best]
        done += [c for own in open_.values() for c in own]
        return sorted((c["start"], c["end"], c["number"], c["hit"] / len(self.templates[c["number"]][0])) for c in done if "longer" not in c)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scanner: Scanner | None = None) -> DataFrame:
    """For every row of docs: doc_id, n_words, places, spans, labels, score.

    places: (word, phrase, label) for each place where a phrase's words stand consecutively; spans:
    (first_word, end_word, template, label, coverage) of the chained template matches, weak ones
    included. labels: the distinct labels of phrases found and of templates covered enough, sorted;
    score: 1 with a phrase, else the best coverage, 0 with none. Null and empty texts have no words,
    empty lists and score 0. Texts are read whole, one at a time; repeated rows are rows like any
    other; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = work.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, places array<struct<word:long,phrase:string,label:string>>, "
        "spans array<struct<first_word:long,end_word:long,template:int,label:string,coverage:double>>, "
        "labels array<string>, score double"
    )
    place = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("coverage", pa.float64())]))

    def run(batches):
        for b in batches:
            sizes, places, spans, labels, scores = [], [], [], [], []
            for t in b.column(1):
                found = words(t.as_py())
                got = scanner.scan(found)
                sizes.append(len(found))
                places.append([{"word": j, "phrase": " ".join(scanner.phrases[n][0]), "label": scanner.phrases[n][1]} for j, n in got["places"]])
                spans.append([{"first_word": a, "end_word": e, "template": n, "label": scanner.templates[n][1], "coverage": c} for a, e, n, c in got["spans"]])
                labels.append(sorted({p["label"] for p in places[-1]} | {s["label"] for s in spans[-1] if s["coverage"] >= scanner.covered}))
                scores.append(1.0 if places[-1] else max((s["coverage"] for s in spans[-1]), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                ["doc_id", "n_words", "places", "spans", "labels", "score"],
            )

    return work.mapInArrow(run, schema)
