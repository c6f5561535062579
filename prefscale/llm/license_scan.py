"""Licence scans by a generalised suffix automaton over the words of licence templates.

A file's words stream through the automaton, which at each word knows the longest run of words, ending there, that
occurs in some template (matching statistics). Runs that cannot be longer and have at least ``min_run`` words are
anchored at their places in the templates and chained, in order in the file and in the template and without long gaps;
a template's span is reported if its best chain covers enough of it. A licence has several templates, each covered for
itself: the head, further parts and the warranty. Notices of six and more words are templates too, with an automaton of
their own and shorter runs and gaps: all matches of each notice that cannot be longer are chained, and one word in six may
be missing from the best chain, but none of those that no other licence's notices have. Shorter notices, and templates of
fewer than ``min_run`` words, are found whole or not at all; they and the base phrases have a third automaton: where the
run that ends at a word is as long as one of them that ends the same way, it stands there. The score is 1 where a base
phrase stands, else the largest share that a chain covers of its template or notice.

Defined results: a null or empty text has no words, no labels and the score 0; every row of the input gives one row; the
text is scanned whole, in one pass, whatever its length. Labels name the wordings that a text has, not which of them
prevails: a BSD licence with the line "All rights reserved." has both labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.session import ship, table

#: Words of lower-cased UTF-8: no ASCII character but digits and letters.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The wording of public licences.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "proprietary": "copyright all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
# Further parts of the same licences.
PARTS = {
    "mit": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apache-2": (
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "gpl": (
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the gnu general public license is a free copyleft license for software and other kinds of works",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    "cc-by-nc": ("adapt remix transform and build upon the material noncommercial you may not use the material for commercial purposes",),
    "cc-by": ("adapt remix transform and build upon the material for any purpose even commercially",),
}
WORDINGS = {label: (text, *PARTS.get(label, ())) for label, text in TEMPLATES.items()}
# Short notices, of which every word must be there.
NOTICES = {
    "mit": ("under the mit license", "under mit license", "spdx license identifier mit"),
    "apache-2": ("under the apache license version 2 0", "apache license 2 0", "spdx license identifier apache 2 0"),
    "bsd": ("under the bsd license", "bsd 2 clause license", "bsd 3 clause license", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 3 clause"),
    "gpl": ("under the gnu general public license", "under the terms of the gnu general public license", "gnu general public license version 2", "gnu general public license version 3", "gnu general public license v2", "gnu general public license v3", "spdx license identifier gpl 2 0", "spdx license identifier gpl 3 0"),
    "cc-by-nc": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution non commercial 4 0"),
    "cc-by": ("cc by 4 0", "creative commons attribution 4 0"),
    "proprietary": ("all rights reserved",),
}
#: The base phrases that the contract of op7_license_scan names; "the mit license" alone is a notice beside them.
CONTRACT_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
CONTRACT_NOTICES = NOTICES | {"mit": (*NOTICES["mit"], "the mit license")}
#: Notices of so many words are chained; one word in so many may be missing, and so many words may stand between two runs.
NOTICE_WORDS, NOTICE_GAP = 6, 3
MIN_RUN = 5
MAX_GAP = 12
COVERAGE = 0.6
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>"


class SuffixAutomaton:
    """All runs of words of several templates; each state keeps the places (template, end) where its runs end."""

    def __init__(self, templates: list[list[int]]):
        self.next, self.link, self.long, self.ends = [{}], [-1], [0], [set()]
        for number, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, long: int, link: int, moves: dict) -> int:
        self.long.append(long)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.long) - 1

    def _split(self, source: int, word: int) -> int:
        """The state for the run source + word, cut out of a longer one if that is needed."""
        there = self.next[source][word]
        if self.long[there] == self.long[source] + 1:
            return there
        twin = self._state(self.long[source] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = twin
        while source >= 0 and self.next[source].get(word) == there:
            self.next[source][word] = twin
            source = self.link[source]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier template goes on the same way
            return self._split(last, word)
        new = self._state(self.long[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def state_of(self, words: list[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and the length of the longest run that ends at the next word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.long[state]
        there = self.next[state].get(word)
        return (0, 0) if there is None else (there, length + 1)

    def runs(self, words: list[int], offset: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(first word, words, state) of each longest run of at least ``least`` words that doesn't lie in a longer one."""
        state = length = 0
        for at, word in enumerate(words):
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
                continue
            if length >= least:
                yield offset + at - length, length, state
            state, length = self.step(state, length, word)
        if length >= least:
            yield offset + len(words) - length, length, state


class ShortWordings:
    """Phrases and notices in an automaton: each state knows which of them its runs end with."""

    def __init__(self, wordings: list[list[int]]):
        self.sizes = [len(w) for w in wordings]
        self.least = min(self.sizes, default=1)
        self.automaton = SuffixAutomaton(wordings)
        links, own = self.automaton.link, {}
        for number, words in enumerate(wordings):
            own.setdefault(self.automaton.state_of(words), []).append(number)
        self.ending: list[list[int]] = [[] for _ in links]
        for state in sorted(range(1, len(links)), key=self.automaton.long.__getitem__):
            self.ending[state] = own.get(state, []) + self.ending[links[state]]

    def places(self, words: list[int], offset: int) -> Iterator[tuple[int, int]]:
        """(number of the wording, first word) of each place where one stands."""
        step, ending, sizes = self.automaton.step, self.ending, self.sizes
        state = length = 0
        for at, word in enumerate(words):
            state, length = step(state, length, word)
            for number in ending[state]:
                if sizes[number] <= length:
                    yield number, offset + at + 1 - sizes[number]


class NoticeChains:
    """Longer notices in an automaton. Each state knows every place in every notice that a run ending there ends at, and how
    much of the run the notice shares, so that no notice's matches are lost where another one has longer ones."""

    def __init__(self, notices: list[tuple[str, list[int]]]):
        long = [x for x in notices if len(x[1]) >= NOTICE_WORDS]
        self.names, self.texts = [k for k, _ in long], [t for _, t in long]
        self.least = [max(2, len(t) // 3) for t in self.texts]
        self.longest = max(map(len, self.texts), default=0)
        self.shortest_run = min(self.least, default=self.longest + 1)
        elsewhere = {k: {w for other, t in notices if other != k for w in t} for k in self.names}
        self.needed = [{i for i, w in enumerate(t) if w not in elsewhere[k]} for k, t in long]
        self.automaton = a = SuffixAutomaton(self.texts)
        self.ways: list[dict[tuple[int, int], int | None]] = [{} for _ in a.long]  # None: as much as the run has
        for state in sorted(range(1, len(a.long)), key=a.long.__getitem__):
            up = a.link[state]
            shared = {place: a.long[up] if cap is None else cap for place, cap in self.ways[up].items()}
            self.ways[state] = shared | {place: None for place in a.ends[state]}

    def matches(self, words: list[int], offset: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(number of the notice, (first word, first word in the notice, words)) of matches that go on to neither side."""
        step, state, length = self.automaton.step, 0, 0
        for at, word in enumerate(words):
            state, length = step(state, length, word)
            after = words[at + 1] if at + 1 < len(words) else 0
            for (number, end), cap in self.ways[state].items():
                n, text = length if cap is None else min(cap, length), self.texts[number]
                if n >= self.least[number] and (end + 1 == len(text) or text[end + 1] != after):
                    yield number, (offset + at + 1 - n, end + 1 - n, n)

    def spans(self, segments: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share) of the notices whose best chain has all that is needed."""
        anchors: dict[int, list] = {}
        for at, part in segments:
            if len(part) >= self.shortest_run:
                for number, match in self.matches(part, at):
                    anchors.setdefault(number, []).append(match)
        out = []
        for number, found in sorted(anchors.items()):
            chain, size = best_chain(sorted(found), NOTICE_GAP, self.longest), len(self.texts[number])
            covered = {i for _, there, n in chain for i in range(there, there + n)}
            if size - len(covered) <= size // NOTICE_WORDS and self.needed[number] <= covered:
                out.append((self.names[number], chain[0][0], chain[-1][0] + chain[-1][2] - 1, len(covered) / size))
        return out


def best_chain(matches: list[tuple[int, int, int]], max_gap: int, longest: int) -> list[tuple[int, int, int]]:
    """Of sorted (text start, template start, words), those of the chain with most words; of several the first to begin."""
    best: list[tuple[int, int, int]] = []  # words up to here, first word, the match before
    for i, (at, there, n) in enumerate(matches):
        total, first, before = n, at, -1
        for j in range(i - 1, -1, -1):
            p_at, p_there, p_n = matches[j]
            if at - p_at > max_gap + longest:
                break  # no match is as long as that
            if 0 <= at - p_at - p_n <= max_gap and there >= p_there + p_n and best[j][0] + n > total:
                total, first, before = best[j][0] + n, best[j][1], j
        best.append((total, first, before))
    at = max(range(len(best)), key=lambda i: (best[i][0], -best[i][1]))
    out = []
    while at >= 0:
        out.append(matches[at])
        at = best[at][2]
    return out[::-1]


class Scanner:
    """Phrases and templates made ready for scanning."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], phrases: Mapping[str, str], min_run: int, max_gap: int, coverage: float, notices: Mapping[str, Sequence[str]] | None = None):
        self.vocab: dict[bytes, int] = {}
        every = [(k, self._numbers(t)) for k in sorted(templates) for t in ([templates[k]] if isinstance(templates[k], str) else templates[k])]
        long = [x for x in every if len(x[1]) >= min_run]
        self.names = [k for k, _ in long]
        texts = [t for _, t in long]
        self.sizes = [len(t) for t in texts]
        self.longest = max(self.sizes, default=0)
        self.automaton = SuffixAutomaton(texts)
        whole = [x for x in every if 0 < len(x[1]) < min_run]
        notes = [(k, n) for k in sorted(notices or {}) for t in notices[k] if (n := self._numbers(t))]
        self.notes = NoticeChains(notes)
        whole += [x for x in notes if len(x[1]) < NOTICE_WORDS]
        base = [(label, n) for p, label in phrases.items() if (n := self._numbers(p))]
        self.short, self.labels, self.phrases = ShortWordings([n for _, n in base + whole]), [label for label, _ in base + whole], len(base)
        self.min_run, self.max_gap, self.coverage = min_run, max_gap, coverage

    def _numbers(self, text: str) -> list[int]:
        return [self.vocab.setdefault(w, len(self.vocab) + 1) for w in WORDS.findall(text.encode().lower())]

    def scan(self, text: str | None) -> tuple:
        words = WORDS.findall(text.encode().lower()) if text else []
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.r_[False, ids > 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)  # runs of words that are in some wording
        segments = [(int(a), ids[a:b].tolist()) for a, b in edges[(edges[:, 1] - edges[:, 0]) >= min(self.short.least, self.min_run, self.notes.shortest_run)]]
        found = [x for at, part in segments for x in self.short.places(part, at)]
        base = [(number, at) for number, at in found if number < self.phrases]
        labels = {self.labels[number] for number, _ in base}
        spans = self.notice_spans(found, segments) + self.spans(segments)
        score = 1.0 if labels else max((s[3] for s in spans), default=0.0)
        every = labels | {s[0] for s in spans if s[3] >= self.coverage}
        first, last = (min(at for _, at in base), max(at for _, at in base)) if base else (None, None)
        return len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(every)), float(score), [s for s in spans if s[3] >= self.coverage]

    def notice_spans(self, found: list[tuple[int, int]], segments: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Each label's best notice, the first of several: (label, first word, last word, share of the notice)."""
        every = [(self.labels[number], at, at + self.short.sizes[number] - 1, 1.0) for number, at in found if number >= self.phrases]
        best: dict[str, tuple[str, int, int, float]] = {}
        for span in sorted(every + self.notes.spans(segments), key=lambda s: (-s[3], s[1], s[2])):
            best.setdefault(span[0], span)
        return [best[label] for label in sorted(best)]

    def spans(self, segments: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """Per template, the best chain of long matches: (label, first word, last word, share of the template)."""
        anchors: dict[int, list] = {}
        for at, part in segments:
            if len(part) >= self.min_run:
                for start, length, state in self.automaton.runs(part, at, self.min_run):
                    for number, end in self.automaton.ends[state]:
                        anchors.setdefault(number, []).append((start, end - length + 1, length))
        out = []
        for number, matches in sorted(anchors.items()):
            chain = best_chain(sorted(matches), self.max_gap, self.longest)
            covered = sum(n for _, _, n in chain)
            out.append((self.names[number], chain[0][0], chain[-1][0] + chain[-1][2] - 1, covered / self.sizes[number]))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = WORDINGS, phrases: Mapping[str, str] = PHRASES, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, coverage: float = COVERAGE, notices: Mapping[str, Sequence[str]] = NOTICES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, places and labels of phrases, all labels, the score and the spans."""
    ship(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases, min_run, max_gap, coverage, notices)
        for texts in batches:
            got = [scanner.scan(t) for t in texts]
            rows = pd.DataFrame(got, columns=NAMES)
            rows["spans"] = [[dict(zip(("label", "first", "last", "coverage"), s, strict=True)) for s in x[-1]] for x in got]
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    rows = docs.select("doc_id", scan(F.coalesce("text", F.lit(""))).alias("found"))
    return rows.select("doc_id", "found.*")


def op7_license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of a scan: words, and places and labels of the operator's own base phrases, PHRASES."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with the base phrases of the contract."""
    return scan_licenses(table(spark, sf_dir, "documents"), phrases=CONTRACT_PHRASES, notices=CONTRACT_NOTICES).drop("spans")


PLACES = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS spot, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE w[i : i + {len(p.split()) - 1}] = [{', '.join(repr(x) for x in p.split())}]" for p, label in PHRASES.items())
ORACLE_BASE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
h AS ({PLACES}),
g AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
