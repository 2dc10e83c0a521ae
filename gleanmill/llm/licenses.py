"""License scans: documents streamed through a generalised suffix automaton of license templates.

The automaton holds all templates and phrases as word sequences.  Streaming a
text through it gives, word by word, the longest match that ends there (the
matching statistics).  Long matches that cannot be extended are chained where
they follow each other in the text and in one template; a chain that covers
enough of its template is a span of that license.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases of the base count with their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Public license notices as their stewards word them.
TEMPLATES = (
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version."""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "Released under the MIT License."),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
)

#: Words of the shortest match that starts or goes on with a chain, words a chain
#: may skip in the text, and the share of a template that makes a span.
LEAST, GAP, SHARE = 3, 12, 0.75
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Result rows that leave a task together.
ROWS = 2000

# On lower-cased UTF-8: digits, a to z, and every byte of a character beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


def lowered(text: str | bytes | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case; nothing for null."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.lower()  # of bytes: A-Z alone


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, a bounded piece at a time, none cut in two."""
    start = 0
    while start < len(data):
        end = len(data)
        if start + PIECE < end and (gap := BETWEEN.search(data, start + PIECE)):
            end = gap.start()
        yield WORDS.findall(data, start, end)
        start = end


class Automaton:
    """Suffix automaton of several word sequences (state 0 is the empty one)."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extended(state, word)
                ends += [[] for _ in range(len(self.step) - len(ends))]
                ends[state].append((number, place + 1))
        # a state ends wherever those whose suffix it is end
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]].extend(ends[state])
        #: Per state the (sequence, end) at which its words occur.
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, above: int, word: int) -> int:
        """The state of exactly the words of ``above`` and ``word``, parted from longer ones where needed."""
        target = self.step[above][word]
        if self.length[target] == self.length[above] + 1:
            return target
        part = self._state(self.length[above] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = part
        while above >= 0 and self.step[above].get(word) == target:
            self.step[above][word] = part
            above = self.link[above]
        return part

    def _extended(self, last: int, word: int) -> int:
        if word in self.step[last]:  # known from an earlier sequence
            return self._split(last, word)
        fresh = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = fresh
            last = self.link[last]
        if last >= 0:
            self.link[fresh] = self._split(last, word)
        return fresh


class Scanner:
    """Streams one text: its words, phrase places, and the chains of its long matches.

    Kept are the matches a chain may still go on from, the best share, and the
    spans found, so memory does not grow with a text but with its spans.
    """

    def __init__(self, book: Book):
        self.book = book
        self.n_words = self.n_base = 0
        self.first = self.last = None
        self.base: set[str] = set()
        self.share = 0.0
        self.spans: list[tuple[int, int, int, int]] = []  # template, first word, last word, words covered
        self.state = self.matched = 0
        self.at = -1  # place of the last word matched
        self.open: dict[int, list[list]] = {}

    def feed(self, words: list[bytes]) -> None:
        book = self.book
        step, link, length, phrases = book.automaton.step, book.automaton.link, book.automaton.length, book.phrases
        state, matched, at, offset = self.state, self.matched, self.at, self.n_words
        known = list(map(book.ids.get, words))
        for i, word in [x for x in enumerate(known, offset) if x[1] is not None]:
            if matched and i != at + 1:
                if matched >= LEAST:
                    self.long_match(at, matched, state)
                state = matched = 0
            before, came_from = matched, state
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            if matched <= before and before >= LEAST:
                self.long_match(i - 1, before, came_from)
            at = i
            for size, label in phrases[state]:
                if matched >= size:
                    start = i - size + 1
                    self.n_base += 1
                    self.base.add(label)
                    self.first = start if self.first is None else min(self.first, start)
                    self.last = start if self.last is None else max(self.last, start)
        self.state, self.matched, self.at = state, matched, at
        self.n_words += len(words)

    def long_match(self, at: int, size: int, state: int) -> None:
        """A match that ends at word ``at`` and cannot go on: chained in every template it occurs in."""
        for template, end in self.book.automaton.ends[state]:
            if template < self.book.first_template:
                continue
            start, low = at - size + 1, end - size  # in the text, in the template
            covered, begun, from_ = size, start, None
            alive = []
            for link in self.open.get(template, ()):
                doc_end, own_end, own_covered, own_begun, _ = link
                if doc_end + GAP < start:
                    self.close(template, link)
                    continue
                alive.append(link)
                shared = max(0, doc_end + 1 - start, own_end - low)
                if doc_end < at and own_end < end and shared < size:
                    sum_ = own_covered + size - shared
                    if (sum_, own_begun) > (covered, begun) or from_ is None and sum_ > covered:
                        covered, begun, from_ = sum_, own_begun, link
            if from_ is not None:
                from_[4] = True
            alive.append([at, end, covered, begun, False])
            self.open[template] = alive

    def close(self, template: int, link: list) -> None:
        doc_end, _, covered, begun, goes_on = link
        share = covered / self.book.sizes[template]
        self.share = max(self.share, share)
        if not goes_on and share >= SHARE:
            self.spans.append((template, begun, doc_end, covered))

    def finish(self) -> None:
        if self.matched >= LEAST:
            self.long_match(self.at, self.matched, self.state)
        for template, links in self.open.items():
            for link in links:
                self.close(template, link)
        self.spans = apart(self.spans, self.book.sizes)
        if self.n_base:
            self.share = 1.0


def apart(spans: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Spans that do not overlap: those that cover more words go first, then the larger share of a template."""
    kept: list[tuple[int, int, int, int]] = []
    for template, first, last, covered in sorted(spans, key=lambda s: (-s[3], -s[3] / sizes[s[0]], s[1], s[0])):
        k = bisect_left(kept, (last + 1,))
        if k == 0 or kept[k - 1][1] < first:
            insort(kept, (first, last, template, covered))
    return [(template, first, last, covered) for first, last, template, covered in kept]


class Book:
    """Phrases and templates as one automaton."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        sequences = [WORDS.findall(lowered(text)) for _, text in (*phrases, *templates)]
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.sizes = [len(s) for s in sequences]
        self.first_template = len(phrases)
        self.ids: dict[bytes, int] = {}
        for sequence in sequences:
            for word in sequence:
                self.ids.setdefault(word, len(self.ids))
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        whole = {}
        for number in range(len(phrases)):
            state = 0
            for word in sequences[number]:
                state = self.automaton.step[state][self.ids[word]]
            whole.setdefault(state, []).append((self.sizes[number], self.labels[number]))
        #: Per state the phrases (size, label) that its match ends with, if it is long enough.
        self.phrases: list[tuple] = [()] * len(self.automaton.step)
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = (*self.phrases[max(0, self.automaton.link[state])], *whole.get(state, ()))

    def scan(self, text: str | bytes | None) -> Scanner:
        scanner = Scanner(self)
        for words in word_lists(lowered(text)):
            scanner.feed(words)
        scanner.finish()
        return scanner


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    book = Book()
    joined = lambda labels: ",".join(sorted(labels))
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            rows = []
            for text in piece["text"].cast(pa.binary()):
                s = book.scan(text.as_py())
                spans = [(book.labels[t], first, last, n, n / book.sizes[t]) for t, first, last, n in s.spans]
                labels = s.base | {span[0] for span in spans}
                names = ("label", "first_word", "last_word", "covered", "share")
                rows.append((
                    s.n_words, s.n_base, s.first, s.last, joined(s.base), joined(labels), min(1.0, s.share),
                    [dict(zip(names, span)) for span in spans],
                ))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def license_scan(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, base phrases, labels, score and covered template spans.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word``
    are the smallest and largest word such a place starts at (null: none).
    ``spans`` are the non-overlapping parts of the text that cover at least three
    quarters of a license template, in order, with words counted from 0;
    ``labels`` adds theirs to the base labels.  ``score`` is the largest share of
    a template that one chain covers, 1 where a phrase stands whole.

    A text is streamed in bounded pieces, whole texts, no shuffle: one row per
    row of ``docs``, repeated rows and null ids included.  Null, empty and
    wordless texts have 0 words, no labels and score 0; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "struct<label: string, first_word: long, last_word: long, covered: long, share: double>"
    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        f" score double, spans array<{span}>",
    )
