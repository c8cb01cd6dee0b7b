"""Licence scans: a generalised suffix automaton of licence tokens.

The automaton accepts every run of words of every template. A document streams through it once and gets its matching
statistics: at each word, the longest run ending there that occurs in some template. Runs of ``MIN_RUN`` words or more that
cannot be extended are anchors at all places of the templates where they occur; anchors that follow each other in both the
document and a template, within ``MAX_GAP`` words, chain to a span. A template's words weigh the less the more labels have
them, and a span that covers ``MIN_COVER`` of its template's weight and holds the phrase that tells this licence from others
is found. Of found spans that overlap, the one that covers most weight stands, so a passage has one label. The base phrases
are templates as well: a phrase ends where the state lies in the subtree of suffix links under its own state, so all their
places come from the same pass. A template of fewer than ``MIN_RUN`` words is found the same way and only whole, wherever it
stands.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other characters beyond ASCII. Null counts as empty
text: no words, no spans, null first and last word, empty labels, score 0. Repeated rows get equal rows; an empty table gives
no rows; further columns are ignored. A document takes time in proportion to its words and memory for its own words only.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN, MAX_GAP, MIN_COVER = 4, 12, 0.5

#: Base phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Passages of public licences and notices, by label, with the phrase that a document's span must hold.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", "including commercial applications"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "person or organization obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "applicable law or agreed to in writing"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by", "cc by 4 0", "cc by"),
    ("cc-by", "cc by 3 0", "cc by"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by", "creative commons attribution 4 0 international license", "attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "attribution noderivatives"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license", "noncommercial noderivatives"),
    ("reserved", "all rights reserved", "all rights reserved"),
)

#: Bytes that stand in a word, lower-cased; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids; states are rows of parallel lists."""

    def __init__(self, templates, base=BASE):
        self.labels = [label for label, _ in base] + [t[0] for t in templates]
        self.runs = [words_of(text.encode()) for _, text in base] + [words_of(t[1].encode()) for t in templates]
        self.needs = [words_of(text.encode()) for _, text in base] + [words_of(t[2].encode()) for t in templates]
        self.n_base = len(base)
        having: dict[bytes, set[str]] = {}
        for label, run in list(zip(self.labels, self.runs, strict=True))[self.n_base :]:
            for word in run:
                having.setdefault(word, set()).add(label)
        #: Sums of the weights of a template's first words; a word weighs 1 / the number of labels that have it.
        self.weights = [[0.0, *accumulate(1 / len(having.get(w, " ")) for w in run)] for run in self.runs]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, run in enumerate(self.runs):
            state = 0
            for place, word in enumerate(run):
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)))
                ends += [[] for _ in range(len(self.next) - len(ends))]
                ends[state].append((number, place + 1))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for state in order:  # where a run ends, its suffixes end as well
            ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]
        # a phrase starts its template, so it is the longest run of its state: it ends wherever that state's subtree does
        self.phrases: list[tuple[int, ...]] = [()] * len(self.next)
        own = {}
        for number, run in enumerate(self.runs):
            if number >= self.n_base and len(run) >= MIN_RUN:
                continue
            state = 0
            for word in run:
                state = self.next[state][self.ids[word]]
            own.setdefault(state, []).append(number)
        for state in reversed(order):
            self.phrases[state] = self.phrases[self.link[state]] + tuple(own.get(state, ()))

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, child: int, word: int) -> int:
        """The state of the runs of ``child`` that are one word longer than those of ``parent``."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._new(self.length[parent] + 1)
        self.next[copy] = dict(self.next[child])
        self.link[copy] = self.link[child]
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        state = self._new(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, self.next[at][word], word)
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of base phrases and of templates under ``MIN_RUN`` words as (start, number), and maximal runs as (start, length, state)."""
        get, step, link, length, phrases = self.ids.get, self.next, self.link, self.length, self.phrases
        places, runs = [], []
        state = held = 0
        before = -1
        known = [(i, t) for i, t in enumerate(map(get, words)) if t is not None]
        for i, t in known:
            if i != before + 1 and held:
                if held >= MIN_RUN:
                    runs.append((before + 1 - held, held, state))
                state = held = 0
            before = i
            to = step[state].get(t)
            if to is None and held >= MIN_RUN:
                runs.append((i - held, held, state))
            while to is None and state:
                state = link[state]
                held = length[state]
                to = step[state].get(t)
            if to is None:
                continue
            state, held = to, held + 1
            if phrases[state]:
                for p in phrases[state]:
                    n = len(self.runs[p])
                    if held >= n:
                        places.append((i + 1 - n, p))
        if held >= MIN_RUN:
            runs.append((before + 1 - held, held, state))
        return places, runs

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """For every anchor the chain of most weight that ends with it: (template, first word, end, weight)."""
        open_: dict[int, list] = {}
        done = []
        for start, held, state in sorted(runs):
            for number, end in self.ends[state]:
                if number < self.n_base:
                    continue
                sums, before = self.weights[number], open_.setdefault(number, [])
                before[:] = [c for c in before if c[1] + MAX_GAP >= start]  # runs come in order of their start
                fit = [c for c in before if c[1] <= start and c[2] <= end - held]
                best = max(fit, key=lambda c: (c[3], c[0]), default=None)
                chain = (best[0] if best else start, start + held, end, (best[3] if best else 0.0) + sums[end] - sums[end - held])
                before.append(chain)
                done.append((number, chain[0], chain[1], chain[3]))
        return done

    def spans(self, words: list[bytes], runs: list[tuple[int, int, int]], whole: list[tuple[int, int]] = ()) -> list[tuple[str, int, int, float]]:
        """Spans that stand (label, first word, last word, share of the template's weight), in the order of the document: those
        of chains over ``runs``, and of the ``whole`` short templates (start, number)."""
        found = self.chains(runs) + [(number, start, start + len(self.runs[number]), self.weights[number][-1]) for start, number in whole]
        kept: list[tuple[int, int, str, float]] = []
        order = lambda f: (-f[3], f[1], f[2], self.labels[f[0]], f[0])
        for number, first, end, weight in sorted((f for f in found if f[3] >= MIN_COVER * self.weights[f[0]][-1] - 1e-9), key=order):
            cover = weight / self.weights[number][-1]
            at = bisect(kept, (first,))
            if (at and kept[at - 1][1] > first) or (at < len(kept) and kept[at][0] < end):
                continue  # kept spans never overlap, so only the neighbours matter
            need = self.needs[number]
            if any(words[i : i + len(need)] == need for i in range(first, end - len(need) + 1)):
                kept.insert(at, (first, end, self.labels[number], min(1.0, cover)))
        return [(label, first, end - 1, cover) for first, end, label, cover in kept]


def scan_licences(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """``OUT`` for every row of ``docs`` (doc_id, text): first_word and last_word are the smallest and largest start of a base
    phrase, labels are those of base phrases and of reported spans, spans the reported spans by word numbers, and score the
    largest share of a template that is covered, a base phrase counting as 1."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, base)
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names[1:]]
            for data in batch.column("data"):
                words = words_of(data.as_py())
                found, runs = automaton.scan(words)
                places = [f for f in found if f[1] < automaton.n_base]
                whole = [f for f in found if f[1] >= automaton.n_base]
                spans = automaton.spans(words, runs, whole) if runs or whole else []
                starts = [start for start, _ in places]
                said = {automaton.labels[p] for _, p in places}
                values = (
                    len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(said)),
                    ",".join(sorted(said | {s[0] for s in spans})), 1.0 if places else min(1.0, max((s[3] for s in spans), default=0.0)),
                    [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in spans],
                )
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(r, f.type) for r, f in zip(rows, list(schema)[1:], strict=True)]], schema=schema)

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).mapInArrow(scan, OUT)
