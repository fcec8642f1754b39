"""Licence notices found with a generalised suffix automaton of template words.

Each text streams through the automaton, which gives for every word the longest run of template words that
ends there (matching statistics). Runs that cannot grow and are long enough are chained per template, in
text and template order, into the spans they cover.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import LOWER, id_of, out_batch, query, rows, table, text_of

# Phrases that count as base places, and wordings of common notices by label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"],
    "CDDL-1.0": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this "
        "file except in compliance with the License."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Artistic-2.0": ["You may redistribute and modify it under the terms of the Artistic License 2.0"],
    "PostgreSQL": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written "
        "agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}

#: Lower-cases A-Z and makes a space of every byte that is no part of a word.
WORDS = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 32 for b in LOWER)

SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
COLUMNS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "spans array<struct<label:string,start:long,end:long,covered:long,coverage:double>>")


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over words, with the places where each state's words end in the templates."""

    def __init__(self, templates: list[list[bytes]], phrases: list[tuple[list[bytes], str]]):
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*templates, *(p for p, _ in phrases)] for w in t))}
        self.next, self.link, self.len = [{}], [-1], [0]
        own = []
        for t in [*templates, *(p for p, _ in phrases)]:
            last = 0
            for at, w in enumerate(t):
                last = self._extend(last, self.vocab[w])
                own.append((last, at))
            own.append((None, len(t)))
        self.places = [{} for _ in self.link]  # state: template: ends
        k = 0
        for state, at in own:
            if state is None:
                k += 1
            elif k < len(templates):
                while state > 0:
                    self.places[state].setdefault(k, []).append(at + 1)
                    state = self.link[state]
        self.places = [{k: sorted(set(v)) for k, v in p.items()} for p in self.places]
        whole = {}
        for p, label in phrases:
            state = 0
            for w in p:
                state = self.next[state][self.vocab[w]]
            whole.setdefault(state, []).append((len(p), label))
        self.phrases = []  # of a state: the phrases that end where its words end
        for state in range(len(self.link)):
            found, s = [], state
            while s > 0:
                found += whole.get(s, [])
                s = self.link[s]
            self.phrases.append(found)

    def _state(self, length: int, link: int, onward: dict) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the words of p and then c, taken out of a longer one if need be."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def stream(self, text: list[bytes], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Runs (start, length, state) of at least ``least`` words that cannot grow, and (start, label) of every phrase."""
        runs, found = [], []
        onward, link, length, phrases = self.next, self.link, self.len, self.phrases
        get, s, n = self.vocab.get, 0, 0
        for i, c in enumerate([get(w, -1) for w in text]):
            if c < 0:
                if n >= least:
                    runs.append((i - n, n, s))
                s = n = 0
                continue
            if c not in onward[s]:
                if n >= least:
                    runs.append((i - n, n, s))
                while s and c not in onward[s]:
                    s = link[s]
                n = length[s]
            if c in onward[s]:
                s, n = onward[s][c], n + 1
            for size, label in phrases[s]:
                if n >= size:
                    found.append((i - size + 1, label))
        if n >= least:
            runs.append((len(text) - n, n, s))
        return runs, found


def chains(runs: list[tuple[int, int, int]], places: list[dict[int, list[int]]], gap: int) -> list[list[int]]:
    """[template, start, end, covered]: runs joined while they go forward in text and template, at most ``gap`` words apart in each.

    A run may stand at several places of a template; a chain goes on as long as any of them can follow one of the run before.
    """
    done, open_ = [], {}
    for start, n, state in runs:
        for k, ends in places[state].items():
            at = open_.get(k)
            if at:  # at: start, end, covered, possible template ends
                fresh = max(at[1] - start, 0)
                if start - at[1] <= gap and n > fresh and (on := [e for e in ends if any(0 <= e - n + fresh - last <= gap for last in at[3])]):
                    at[1], at[2], at[3] = start + n, at[2] + n - fresh, on
                    continue
                if start < at[1] and n <= at[1] - at[0]:
                    continue  # inside what a longer run has covered
                done.append([k, *at[:3]])
            open_[k] = [start, start + n, n, ends]
    return done + [[k, *at[:3]] for k, at in open_.items()]


@functools.cache
def _automaton() -> tuple[Automaton, list[str], list[int]]:
    flat = [(label, words(t.encode())) for label, ts in TEMPLATES.items() for t in ts]
    return Automaton([t for _, t in flat], [(words(p.encode()), label) for p, label in PHRASES.items()]), [x for x, _ in flat], [len(t) for _, t in flat]


def scan(docs: DataFrame, least: int = 3, gap: int = 8, coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, base places (count, first and last start, labels), all labels, score and template spans.

    ``least`` words make a run, runs at most ``gap`` words apart a chain, and a chain that covers ``coverage`` of
    a template a span. Of spans that overlap the one stays whose share of the template times its covered words is greatest, of equal
    ones the first by label. ``score`` is the best cover of any template by a chain, 0 if there is none. A null
    text is empty: no words, no places, empty labels. Rows may repeat; other columns are ignored.
    """
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, names, sizes = _automaton()
        for ids, texts in rows(batches):
            got = [[] for _ in SCHEMA]
            for doc, text in zip(ids, texts):
                ws = words(text)
                runs, found = auto.stream(ws, least)
                all_ = [(k, a, b, c, c / sizes[k]) for k, a, b, c in chains(runs, auto.places, gap)] if runs else []
                best, spans, taken = max((x[4] for x in all_), default=0.0), [], []
                for k, a, b, c, share in sorted(all_, key=lambda x: (-x[4] * x[3], names[x[0]], x[1])):
                    if share >= coverage:
                        i = bisect.bisect(taken, (a,))
                        if (i == len(taken) or taken[i][0] >= b) and (not i or taken[i - 1][1] <= a):
                            taken.insert(i, (a, b))
                            spans.append({"label": names[k], "start": a, "end": b, "covered": c, "coverage": share})
                base = sorted({x for _, x in found})
                row = (doc, len(ws), len(found), min((x for x, _ in found), default=None), max((x for x, _ in found), default=None), ",".join(base),
                       ",".join(sorted({*base, *(x["label"] for x in spans)})), best, sorted(spans, key=lambda x: x["start"]))
                for c, v in zip(got, row):
                    c.append(v)
            yield out_batch(SCHEMA, got)

    return docs.select(id_of(id_col), text_of(text_col).cast("binary")).mapInArrow(scanned, COLUMNS)


@query("op1_license_scan")
def op1_license_scan(spark, base):
    return scan(table(spark, base, "documents")).withColumn("n_spans", F.size("spans").cast("long"))
