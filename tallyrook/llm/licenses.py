"""License scans by template-markup matching.

A template is wording with markup: <<beginOptional>> ... <<endOptional>> around what may be missing (nesting allowed), and
<<var;max=N>> for up to N words that may stand there. It is compiled to an automaton over words: optional regions are
bypasses, replaceable ones are chains of steps that any word takes. The automaton is made deterministic state by state as
texts reach them. A text is accepted from a word on if every mandatory word follows as written; the longest such
stretch is taken. Documents without all words that a template demands are passed over by one vectorised test. Words are met by
hash, and those that meet are compared letter by letter.

There are templates of whole licence texts (their grade is 1), of grants and notices that name a licence (0.75), and of reservations
(0.25). Beside templates there are base phrases (0.5), found wherever their words stand consecutively. The score is the highest grade.

Null and empty texts have no words and no labels; equal texts have equal results; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import words as w

#: Phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_HOLDERS = "<<beginOptional>>the copyright holder<<endOptional>> <<var;max=8>>"
_DISCLAIMER = f"""this software is provided by {_HOLDERS} as is and any express or implied warranties including but not limited to the implied
 warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_HOLDERS} be liable for any direct
 indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
 loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
 or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
 damage"""
_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
 conditions are met <<var;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the
 following disclaimer <<var;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and
 the following disclaimer in the documentation and or other materials provided with the distribution"""
#: Label, template and grade. The wording of public licences.
WHOLE = {
    "MIT": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
 the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
 distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
 following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>
 shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
 express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
 in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
 tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "ISC": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
 fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
 as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
 fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever
 resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
 connection with the use or performance of this software""",
    "BSD-2-Clause": f"{_CONDITIONS} {_DISCLAIMER}",
    "BSD-3-Clause": f"""{_CONDITIONS} <<var;max=1>> neither the name of <<var;max=8>> nor the names of its contributors may be used to endorse
 or promote products derived from this software without specific prior written permission {_DISCLAIMER}""",
    "Zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
 damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
 applications and to alter it and redistribute it freely subject to the following restrictions <<var;max=1>> the origin of this software
 must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
 acknowledgment in the product documentation would be appreciated but is not required <<var;max=1>> altered source versions must be
 plainly marked as such and must not be misrepresented as being the original software <<var;max=1>> this notice may not be removed or
 altered from any source distribution""",
}
NOTICES = {
    "mit-notice": "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>>",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
 license you may obtain a copy of the license at <<beginOptional>>http www apache org licenses license 2 0<<endOptional>> unless required by
 applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
 conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under
 the license""",
    "gpl-3.0": "<<beginOptional>>this <<var;max=3>> is<<endOptional>> licensed under the gnu <<beginOptional>>lesser<<endOptional>> general public license version 3 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "gpl-notice": """<<var;max=4>> is free software you can redistribute it and or modify it under the terms of the gnu
 <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license as published by the free software
 foundation either version <<var;max=2>> of the license or at your option any later version""",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>the<<endOptional>> CC BY NC 4 0 <<beginOptional>>license<<endOptional>>",
}
RESERVED = {"reserved": "copyright <<var;max=10>> all rights reserved"}
TEMPLATES = WHOLE | NOTICES | RESERVED
GRADES = dict.fromkeys(WHOLE, 1.0) | dict.fromkeys(NOTICES, 0.75) | dict.fromkeys(RESERVED, 0.25)
BASE_GRADE = 0.5
_MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")


def _hashes(text: str) -> list[int]:
    return w.split(pa.array([text]), w.ALNUM, lower=True).hash.tolist()


def _known(*texts: str) -> dict[int, bytes]:
    """The words of texts by their hashes."""
    found = w.split(pa.array(list(texts)), w.ALNUM, lower=True)
    return {h: found.lower(i) for i, h in enumerate(found.hash.tolist())}


class Automaton:
    """Of one template. State 0 is the start; step() gives the next state, or -1."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[int | None, int]]] = [[]]  # word or None for any, target
        self.skips: list[list[int]] = [[]]
        self.mandatory: set[int] = set()
        last, at, opened = 0, 0, []
        for m in [*_MARK.finditer(template), None]:
            for h in _hashes(template[at : m.start() if m else len(template)]):
                last = self._after(last, h)
                if not opened:
                    self.mandatory.add(h)
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(last)
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                end = self._state()
                self.skips[opened.pop()].append(end)
                self.skips[last].append(end)
                last = end
            else:
                chain = [last]
                for _ in range(int(m[2])):
                    chain.append(self._after(chain[-1], None))
                last = self._state()
                for s in chain:
                    self.skips[s].append(last)
        if opened:
            raise ValueError("beginOptional without endOptional")
        if not self.mandatory:
            raise ValueError("a template needs mandatory words")
        self.end = last
        start = self._closure({0})
        self.sets, self.known, self.moves = [start], {start: 0}, [{}]
        self.accepts = [self.end in start]
        self.starts = None if any(x is None for s in start for x, _ in self.edges[s]) else {x for s in start for x, _ in self.edges[s]}
        self.words = {x for e in self.edges for x, _ in e if x is not None}

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _after(self, state: int, word: int | None) -> int:
        new = self._state()
        self.edges[state].append((word, new))
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, state: int, word: int) -> int:
        word = word if word in self.words else -1
        if (found := self.moves[state].get(word)) is not None:
            return found
        to = self._closure({t for s in self.sets[state] for x, t in self.edges[s] if x is None or x == word})
        if not to:
            found = -1
        elif (found := self.known.get(to)) is None:
            found = self.known[to] = len(self.sets)
            self.sets.append(to)
            self.moves.append({})
            self.accepts.append(self.end in to)
        self.moves[state][word] = found
        return found

    def match(self, words: list[int], at: int) -> int:
        """The end of the longest accepted stretch from at, or -1."""
        state, end = 0, -1
        while at < len(words) and (state := self.step(state, words[at])) >= 0:
            at += 1
            if self.accepts[state]:
                end = at
        return end


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in templates}


def base_places(found: w.Words, phrases=BASE) -> tuple[np.ndarray, np.ndarray]:
    """First words of all places of the phrases, in the whole column, and which phrase."""
    at, which = [], []
    for k, (phrase, _) in enumerate(phrases):
        own = _hashes(phrase)
        n = len(found.hash) - len(own) + 1
        if n <= 0:
            continue
        hit = np.flatnonzero(found.hash[:n] == np.uint64(own[0]))
        for j, h in enumerate(own[1:], 1):
            hit = hit[found.hash[hit + j] == np.uint64(h)]
        row = np.searchsorted(found.first, hit, "right")
        hit = hit[hit + len(own) <= found.first[row]]
        at.append(hit)
        which.append(np.full(len(hit), k))
    return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64),) * 2


def template_matches(found: w.Words, automata: dict[str, Automaton]) -> Iterator[tuple[int, str, int, int]]:
    """Row, label, first word and end of every accepted stretch."""
    rows = found.rows()
    for label, automaton in automata.items():
        has = np.ones(len(found.first) - 1, bool)
        for h in automaton.mandatory:
            own = np.zeros(len(has), bool)
            own[rows[found.hash == np.uint64(h)]] = True
            has &= own
        for r in np.flatnonzero(has).tolist():
            own = found.hash[found.first[r] : found.first[r + 1]]
            starts = np.arange(len(own)) if automaton.starts is None else np.flatnonzero(np.isin(own, np.array(list(automaton.starts), np.uint64)))
            listed, last = own.tolist(), -1
            for at in starts.tolist():
                end = automaton.match(listed, at)
                if end > last:  # not within the one before
                    yield r, label, at, end
                    last = end


SPANS = "array<struct<label:string,first:long,end:long>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base (places of phrases), matches (stretches that templates accept), as labelled spans of words."""
    held = tuple((TEMPLATES if templates is None else templates).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(held)
        known = _known(*(p for p, _ in BASE), *(_MARK.sub(" ", t) for _, t in held))
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in w.slices(batches):
            found = w.without_impostors(w.split(batch.column("text"), w.ALNUM, lower=True), known)
            base: list[list] = [[] for _ in range(batch.num_rows)]
            for at, k in sorted(zip(*(x.tolist() for x in base_places(found)), strict=True)):
                r = int(np.searchsorted(found.first, at, "right")) - 1
                first = at - int(found.first[r])
                base[r].append({"label": BASE[k][1], "first": first, "end": first + len(BASE[k][0].split())})
            own: list[list] = [[] for _ in range(batch.num_rows)]
            for r, label, first, end in template_matches(found, automata):
                own[r].append({"label": label, "first": first, "end": end})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(found.first), pa.int64()), pa.array(base, kind), pa.array(own, kind)], ["doc_id", "n_words", "base", "matches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, base {SPANS}, matches {SPANS}")


def license_digests(docs: DataFrame) -> DataFrame:
    """What scan_licenses() finds, as counts, labels and the highest grade."""
    found = scan_licenses(docs)
    grades = F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair))
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(f"{s}.label") for s in spans)))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "matches").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: grades[m["label"]])), F.lit(0.0)), F.when(F.size("base") > 0, BASE_GRADE).otherwise(0.0)).alias("score"),
    )


def _pattern(template: str) -> str:
    """A regular expression for the template, over words that each have one blank after them."""
    found, at = "", 0
    for m in [*_MARK.finditer(template), None]:
        words = template[at : m.start() if m else len(template)].lower().split()
        found += "".join(f"{x} " for x in words)
        if m is None:
            return found
        at = m.end()
        found += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else f"(?:[^ ]+ ){{0,{m[2]}}}"
    return found


def _base_sql() -> str:
    rows = []
    for phrase, label in BASE:
        test = " AND ".join(f"ws[i + {j}] = '{x}'" for j, x in enumerate(phrase.split()))
        rows.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {test}), lambda i: {{'s': i - 1, 'label': '{label}'}})")
    return f"list_concat({rows[0]}, list_concat({rows[1]}, {rows[2]}))"


LICENSE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), f AS (
  SELECT doc_id, ws, {_base_sql()} AS base, ' ' || array_to_string(ws, ' ') || ' ' AS flat FROM d
), m AS (
  SELECT *, list_transform(base, lambda x: x.label) AS bl, list_transform(base, lambda x: x.s) AS places,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(flat, ' {_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())}], lambda x: x IS NOT NULL) AS own FROM f
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, own))), ',') AS labels,
  greatest({" , ".join(f"CASE WHEN list_contains(own, '{label}') THEN {grade} ELSE 0 END" for label, grade in GRADES.items())}, CASE WHEN len(base) > 0 THEN {BASE_GRADE} ELSE 0 END)::DOUBLE AS score FROM m
"""
