"""License scan by template-markup matching.

A template is license wording with optional regions, <<beginOptional>> ...
<<endOptional>>, and replaceable ones, <<var;name=NAME;words=LOW..HIGH>>, which
stand for any LOW to HIGH words.  It is compiled into an automaton over words;
a text is accepted where the mandatory wording stands word for word.  Besides,
fixed phrases are counted wherever their words stand consecutively.

Words are the runs of letters, digits and non-ASCII characters after A-Z are
lower-cased.  Every template and phrase has a telling word without which it
cannot match; texts without any of these are done after one look at the hashes
of their words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, Block, Words, pieces

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licenses and of the notices that name them, as words.
_HOLDER = "<<var;name=holder;words=1..12>>"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the software"
_ISC = "permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2 <<endOptional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = f"<<beginOptional>>3 <<endOptional>>neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GPL = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation <<beginOptional>>either version <<var;name=version;words=1..2>> of the license or at your option any later version<<endOptional>>"
_NO_WARRANTY = "this <<var;name=what;words=1..3>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {}general public license for more details"
_APACHE = "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this <<var;name=what;words=1..3>> except in compliance with the license<<endOptional>>"
#: Label and template. A `text` is a whole license, a `header` the whole notice that its license proposes, a `notice` a part of one.
TEMPLATES = [
    ("mit-notice", "<<beginOptional>>this <<var;name=what;words=1..2>> is <<endOptional>><<beginOptional>>released <<endOptional>><<beginOptional>>licensed <<endOptional>>under the mit license"),
    ("apache-2.0-notice", _APACHE),
    ("apache-2.0-header", f"{_APACHE} you may obtain a copy of the license at http <<beginOptional>>s <<endOptional>>www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>version <<endOptional>><<var;name=version;words=1..2>>"),
    ("gpl-notice", _GPL.format("")),
    ("gpl-header", f"{_GPL.format('')} {_NO_WARRANTY.format('')}"),
    ("lgpl-notice", _GPL.format("lesser ")),
    ("lgpl-header", f"{_GPL.format('lesser ')} {_NO_WARRANTY.format('lesser ')}"),
    ("agpl-notice", _GPL.format("affero ")),
    ("mpl-2.0-header", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http <<beginOptional>>s <<endOptional>>mozilla org mpl 2 0"),
    ("cc-by-notice", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>creative commons <<endOptional>>cc by <<var;name=terms;words=0..3>> 4 0"),
    ("mit-grant", _MIT),
    ("mit-text", f"{_MIT} the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {_HOLDER} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", _ISC),
    ("isc-text", f"{_ISC} the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause-conditions", _BSD),
    ("bsd-3-clause-condition", _BSD_3),
    ("bsd-text", f"{_BSD} <<beginOptional>>{_BSD_3} <<endOptional>>this software is provided by {_HOLDER} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_HOLDER} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1 <<endOptional>>the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2 <<endOptional>>altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3 <<endOptional>>this notice may not be removed or altered from any source distribution"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
]
MARK = re.compile(r"<<(beginOptional|endOptional|var;name=\w+;words=(\d+)\.\.(\d+))>>")
ANY = "*"


def parsed(template: str) -> list:
    """Nested regions of a template: a word, (low, high) of a replaceable region, or a list for an optional one."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*MARK.finditer(template), None]:
        stack[-1] += template[at : mark.start() if mark else None].split()
        if not mark:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("an optional region ends that didn't begin")
            region = stack.pop()
            stack[-1].append(region)
        else:
            stack[-1].append((int(mark[2]), int(mark[3])))
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    return stack[0]


@dataclass
class Automaton:
    """Steps by word and free steps between numbered states; the last state accepts."""

    label: str
    steps: list[dict[str, int]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])

    def _state(self) -> int:
        self.steps.append({})
        self.free.append([])
        return len(self.steps) - 1

    def _append(self, regions: list, at: int) -> int:
        for region in regions:
            if isinstance(region, str):
                to = self.steps[at][region] = self._state()
            elif isinstance(region, tuple):
                low, high = region
                inner, ends = at, [at] if low == 0 else []
                for k in range(1, high + 1):
                    self.steps[inner][ANY] = inner = self._state()
                    ends += [inner] if k >= low else []
                to = self._state()
                for end in ends:
                    self.free[end].append(to)
            else:
                to = self._append(region, at_inner := self._state())
                self.free[at].append(at_inner)
                self.free[at].append(to)
            at = to
        return at

    @classmethod
    def of(cls, label: str, template: str) -> Automaton:
        out = cls(label)
        out.final = out._append(parsed(template), 0)
        out.closed = [out._closure(s) for s in range(len(out.steps))]
        out.mandatory = mandatory = [r for r in parsed(template) if isinstance(r, str)]
        if not mandatory:
            raise ValueError("a template needs a mandatory word")
        out.telling = max(mandatory, key=len)
        out.first = {w for s in out.closed[0] for w in out.steps[s]}
        return out

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[str], at: int) -> int:
        """The end of the longest match that begins at a word, -1 if there is none."""
        states, end = self.closed[0], -1
        while True:
            if self.final in states:
                end = at
            if at >= len(words) or not states:
                return end
            word, after = words[at], set()
            for s in states:
                step = self.steps[s]
                for key in (word, ANY):
                    if key in step:
                        after |= self.closed[step[key]]
            states, at = after, at + 1

    def matches(self, words: list[str]) -> list[tuple[int, int]]:
        """Leftmost longest matches, none inside another."""
        out, free = [], 0
        for at, word in enumerate(words):
            if at >= free and (word in self.first or ANY in self.first):
                end = self.longest(words, at)
                if end > at:
                    out.append((at, end))
                    free = end
        return out


def places(words: list[str], phrase: list[str]) -> list[int]:
    return [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]


def _scan(phrases: dict[str, str], templates: list[tuple[str, str]]):
    def run(batches):
        automata = [Automaton.of(*t) for t in templates]
        wanted = [(p.split(), label) for p, label in phrases.items()]
        telling = {a.telling for a in automata} | {min(p, key=lambda w: (-len(w), w)) for p, _ in wanted}
        probe = Words(Block(pa.array([" ".join(sorted(telling))])), ALNUM)
        known = np.sort(probe.hashes())
        for batch, column in pieces(batches, "text"):
            words = Words(Block(column), ALNUM)
            hashes, first = words.hashes(), words.first
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes) if len(hashes) else np.zeros(0, np.int64)
            touched = set((np.searchsorted(first, hit, "right") - 1).tolist())
            n = len(column)
            base_counts, ends = np.zeros(n, np.int64), [[None] * n, [None] * n]
            texts, score = [[""] * n for _ in range(3)], np.zeros(n)
            for k in sorted(touched):
                base, labels, found = [], set(), []
                text = words.text(first[k], first[k + 1]).decode().split(" ")
                for phrase, label in wanted:
                    if at_ := places(text, phrase):
                        base += at_
                        labels.add(label)
                for a in automata:
                    found += [(s, e, a.label) for s, e in a.matches(text)]
                base_counts[k], ends[0][k], ends[1][k] = len(base), min(base, default=None), max(base, default=None)
                texts[0][k] = ",".join(sorted(labels))
                texts[1][k] = ",".join(sorted(labels | {x for _, _, x in found}))
                texts[2][k] = ",".join(f"{x}:{s}:{e}" for s, e, x in sorted(found))
                score[k] = 1.0 if found else 0.5 if base else 0.0
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(base_counts), *(pa.array(x, pa.int64()) for x in ends), *(pa.array(x, pa.string()) for x in texts), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score"],
            )

    return run


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches, score) of each whole text.

    matches lists label:start:end of the accepted templates in words, end exclusive. The score is 1 where a
    template is accepted, 0.5 where only a phrase stands, else 0. A null or empty text has no words, null
    positions and empty labels. Rows are independent of each other; other columns change nothing.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scan(phrases, templates), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, matches string, score double")


def pattern(template: str) -> str:
    """A regular expression that finds the template in words that are joined by single spaces, with a space before each and one at the end."""

    def of(regions: list) -> str:
        out = []
        for r in regions:
            out.append(f" {re.escape(r)}" if isinstance(r, str) else f"(?: [^ ]+){{{r[0]},{r[1]}}}" if isinstance(r, tuple) else f"(?:{of(r)})?")
        return "".join(out)

    return of(parsed(template)) + " "


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The columns of the query in DuckDB's SQL, with a regular expression for each template."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    at = " || ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i+{len(p.split()) - 1}] = {p.split()!r}), lambda i: struct_pack(at := i - 1, label := {quoted(label)}))" for p, label in phrases.items())
    accepted = ", ".join(f"CASE WHEN regexp_matches(j, {quoted(pattern(t))}) THEN {quoted(label)} END" for label, t in templates)
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM a),
c AS (SELECT doc_id, w, {at} AS base, list_filter([{accepted}], lambda x: x IS NOT NULL) AS found FROM b),
d AS (SELECT *, list_transform(base, lambda x: x.at) AS starts, list_distinct(list_transform(base, lambda x: x.label)) AS bl FROM c)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(bl || found)), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d"""
