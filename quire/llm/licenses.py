"""Operator 8: license scans by winnowed fingerprints and banded alignment.

Words are lower-cased and stripped of marks. Of the hashes of GRAM words in a row of a template, winnowing keeps the least in
each WINDOW of them (of a short template all are kept), so a text that has any GRAM + WINDOW - 1 words of it in a row, or
GRAM of a short one, hits the inverted index of (template, place). A text with a hit is aligned if it has enough of the
template's words at all, whatever their order: no alignment can match more. Hits give diagonals; local alignments in a band
around them report how much of the template is matched, and where, over inserted or missing words. All matches that don't
overlap are reported, so a notice that is repeated counts each time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import space
from .words import chunks, flat_bytes, mixed, only, rolling, spans, split_words

GRAM, WINDOW = 2, 2
#: Words up to which a template is short: all of its runs are kept.
SHORT = 12
#: Diagonals on either side of a hit that an alignment may use; bands that are less than the template's size apart are one.
BAND = 6
#: Share of a template's words that is reported, at least.
LEAST_COVERAGE = 0.75
#: Words of a text that are aligned at once; longer texts are aligned in overlapping parts.
PART_WORDS = 1 << 22
#: Words of a template at most.
MOST_TEMPLATE = 250_000

# Notices and license texts, as their authors ask for them to be given.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
}

_MARKS = re.compile(rb"[^a-z0-9\x80-\xff]+")


def _word_hash(word: bytes) -> int:
    """The hash of a lower-cased word without its marks; 0 if nothing is left."""
    bare = _MARKS.sub(b"", word)
    return xxhash.xxh3_64_intdigest(bare) or 1 if bare else 0


def winnow(h: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of the runs of ``gram`` values and their places: the last least one in each ``window`` of runs."""
    runs = mixed(rolling(h, gram)) if len(h) >= gram else np.zeros(0, dtype=np.uint64)
    if not len(runs):
        return runs, np.zeros(0, dtype=np.int64)
    if len(runs) <= window:
        at = np.array([len(runs) - 1 - int(np.argmin(runs[::-1]))])
    else:
        rows = np.lib.stride_tricks.sliding_window_view(runs, window)[:, ::-1]
        at = np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows, axis=1))
    return runs[at], at


class Templates:
    """The inverted index over the templates; its size is that of the templates."""

    def __init__(self, texts: dict[str, str], least: float = LEAST_COVERAGE) -> None:
        self.names = sorted(texts)
        words = [np.array([x for w in texts[n].lower().encode().split() if (x := _word_hash(w))], dtype=np.uint64) for n in self.names]
        if any(len(w) > MOST_TEMPLATE for w in words):
            raise ValueError(f"a template has more than {MOST_TEMPLATE} words")
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, dtype=np.uint64)]))
        #: Templates as places in the vocabulary, and how often each has each word.
        self.words = [np.searchsorted(self.vocabulary, h) for h in words]
        self.often = np.array([np.bincount(w, minlength=len(self.vocabulary)) for w in self.words]).reshape(len(words), len(self.vocabulary))
        self.least = np.maximum(1, np.ceil(least * np.array([len(w) for w in words]) - 1e-9)).astype(np.int64)
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, h in enumerate(words):
            for value, at in zip(*winnow(h, window=1 if len(h) <= SHORT else WINDOW), strict=True):
                index[int(value)].append((k, int(at)))
        self.keys = np.array(sorted(index), dtype=np.uint64)
        # For each hash, its templates and places, flat.
        own = [sorted(index[int(x)]) for x in self.keys]
        self.of_key = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64)
        flat = np.array([p for x in own for p in x], dtype=np.int64).reshape(-1, 2)
        self.template, self.place = flat[:, 0], flat[:, 1]

    def coded(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, or -1."""
        at = np.searchsorted(self.vocabulary, h)
        inside = np.minimum(at, max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[inside] == h, inside, -1) if len(self.vocabulary) else np.full(len(h), -1)

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the run, template and place in it, for all hits of the hashes ``runs``."""
        if not len(self.keys):
            return (np.zeros(0, dtype=np.int64),) * 3
        at = np.searchsorted(self.keys, runs)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == runs)
        count = np.diff(self.of_key)[at[hit]]
        flat = spans(self.of_key[at[hit]], count)
        return np.repeat(hit, count), self.template[flat], self.place[flat]

    def enough(self, text: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """Which (text, template) may match: of n texts, those that have so many of a template's words, in any order."""
        found = code >= 0
        size = max(1, len(self.vocabulary))
        have = np.bincount(text[found] * size + code[found], minlength=n * size).reshape(n, size)
        return np.array([np.minimum(have, often).sum(axis=1) >= least for often, least in zip(self.often, self.least, strict=True)]).reshape(len(self.least), n).T


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of the text, the best local alignment that ends there in the band low <= text place - template place <= high.

    Returns score, matches and begin for each place. A match counts 2, a mismatch, a missing or an inserted word -1. All places
    of a row of the band are computed at once: score, matches and begin share a number, so that a maximum picks all three, and
    runs of inserted words are a running maximum.
    """
    one, hit, mask = np.int64(1) << 40, np.int64(1) << 22, (1 << 22) - 1  # places below PART_WORDS, matches below 1 << 18
    best = np.zeros(len(text), dtype=np.int64)
    width = high - low + 1
    row = np.zeros(width + 1, dtype=np.int64)  # by diagonal, and a last one outside the band
    slope = np.arange(width, dtype=np.int64) * one
    for i in range(len(template)):
        a, b = max(0, -(i + low)), min(width, len(text) - i - low)  # diagonals that lie in the text
        if b <= a:
            row[:] = 0
            continue
        j = np.arange(a + i + low, b + i + low)
        same = text[j] == template[i]
        before = row[a:b]
        new = np.where(same, np.where(before > 0, before + 2 * one + hit, 2 * one + hit + j), before - one)
        np.maximum(new, row[a + 1 : b + 1] - one, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope[: b - a]) - slope[: b - a]
        new[new < one] = 0
        row[:] = 0
        row[a:b] = new
        np.maximum(best[j[0] : j[-1] + 1], new, out=best[j[0] : j[-1] + 1])
    return best >> 40, (best >> 22) & 0x3FFFF, best & mask


def occurrences(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, least: int, band: int = BAND) -> list[tuple[int, int, int]]:
    """(matches, begin, end) of the alignments of the template with ``least`` matches or more, none overlapping another."""
    size = len(template)
    diagonals = np.unique(diagonals)
    first = np.flatnonzero(np.r_[True, np.diff(diagonals) > size + 2 * band])
    out: list[tuple[int, int, int]] = []
    for a, b in zip(first, np.r_[first[1:], len(diagonals)], strict=True):
        low, high = int(diagonals[a]) - band, int(diagonals[b - 1]) + band
        todo = [(max(0, low), min(len(text), high + size))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < least:
                continue
            score, matches, begin = align(template, text[lo:hi], low - lo, high - lo)
            ends = np.flatnonzero(matches >= least)
            # The best first; each stretch of text between those that are taken is searched again, for what they hid.
            taken = np.zeros(hi - lo, dtype=bool)
            for end in ends[np.lexsort((ends, -score[ends]))].tolist():
                start = int(begin[end])
                if not taken[start : end + 1].any():
                    taken[start : end + 1] = True
                    out.append((int(matches[end]), lo + start, lo + end + 1))
            if taken.any():
                edge = np.flatnonzero(np.diff(np.r_[True, taken, True]))
                left = ends[~taken[ends]]
                spans_of = edge.reshape(-1, 2)
                has = np.searchsorted(left, spans_of[:, 0]) < np.searchsorted(left, spans_of[:, 1])
                todo += [(lo + x, lo + y) for x, y in spans_of[has].tolist()]
    return out


def matches(code: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray], own: Templates, wanted: np.ndarray, band: int = BAND) -> list[tuple[int, float, int, int]]:
    """(template, coverage, begin, end) of the wanted templates in a text; of overlapping ones that with more matched words.

    ``code`` are the text's words in the templates' vocabulary, ``hits`` the place in the text, template and place in it of each hit.
    """
    if len(code) > PART_WORDS:
        overlap = 4 * max(len(w) for w in own.words)
        parts = range(0, len(code), PART_WORDS - overlap)
        found = []
        for a in parts:
            inside = (hits[0] >= a) & (hits[0] < a + PART_WORDS)
            found += [(m, k, b + a, e + a) for m, k, b, e in _found(code[a : a + PART_WORDS], tuple(x[inside] - (a if n == 0 else 0) for n, x in enumerate(hits)), own, wanted, band)]
    else:
        found = _found(code, hits, own, wanted, band)
    out: list[tuple[int, float, int, int]] = []
    taken = np.zeros(len(code), dtype=bool)
    for m, template, a, b in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((template, m / len(own.words[template]), a, b))
    return sorted(out, key=lambda x: x[2])


def _found(code: np.ndarray, hits: tuple[np.ndarray, ...], own: Templates, wanted: np.ndarray, band: int) -> list[tuple[int, int, int, int]]:
    place, template, at = hits
    out = []
    for k in np.unique(template).tolist():
        if wanted[k]:
            mine = template == k
            out += [(m, k, a, b) for m, a, b in occurrences(own.words[k], code, place[mine] - at[mine], int(own.least[k]), band)]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = LEAST_COVERAGE) -> DataFrame:
    """Licenses in every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns for each row doc_id, n_licenses, licenses (names in order of place, comma-joined), and found: an array of
    (license, coverage, start, end), places in code points of the text. A null or empty text, or one without words, has
    none. Rows that share a doc_id, or have none, are each scanned alone. ``templates`` maps names to texts of MOST_TEMPLATE
    words at most (an error beyond); ``least`` is the share of a template's words that a match has at least. Matches don't overlap; a notice that a text
    repeats is reported each time. Time grows with the length of a text, not with its square.
    """
    texts = TEMPLATES if templates is None else templates
    Templates(texts, least)  # raises here, not in a task
    schema = "doc_id long, n_licenses long, licenses string, found array<struct<license: string, coverage: double, start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        own = Templates(texts, least)
        for batch in batches:
            for part in chunks(batch):
                data, at = flat_bytes(part.column("text"))
                words = split_words(data, at, lower=True)
                code, distinct = words.coded()
                hashed = np.fromiter((_word_hash(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
                h = hashed[code] if len(code) else np.zeros(0, dtype=np.uint64)
                filled = np.flatnonzero(h)
                h, of = h[filled], np.searchsorted(filled, words.of)
                start = words.start[filled]
                end = start + np.diff(words.at)[filled]
                runs = mixed(rolling(h, GRAM)) if len(h) >= GRAM else np.zeros(0, dtype=np.uint64)
                n_runs = np.maximum(np.diff(of) - GRAM + 1, 0)
                at_run = spans(of[:-1], n_runs)
                place = spans(np.zeros(len(n_runs), dtype=np.int64), n_runs)
                text_of_run = np.repeat(np.arange(part.num_rows), n_runs)
                run_of, template, in_template = own.hits(runs[at_run])
                code_of = own.coded(h)
                enough = own.enough(np.repeat(np.arange(part.num_rows), np.diff(of)), code_of, part.num_rows)
                good = enough[text_of_run[run_of], template]
                run_of, template, in_template = run_of[good], template[good], in_template[good]
                text_of = text_of_run[run_of]
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                edge = np.flatnonzero(np.r_[True, np.diff(text_of) > 0, True]) if len(text_of) else np.zeros(0, dtype=np.int64)
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    i = int(text_of[x])
                    base = of[i]
                    points = None
                    for name, coverage, a, b in matches(code_of[base : of[i + 1]], (place[run_of[x:y]], template[x:y], in_template[x:y]), own, enough[i]):
                        if points is None:
                            points = np.r_[0, np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)]
                        rows[i].append({"license": own.names[name], "coverage": coverage, "start": int(points[start[base + a] - at[i]]), "end": int(points[end[base + b - 1] - at[i]])})
                kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_licenses": pa.array([len(r) for r in rows], pa.int64()), "licenses": pa.array([",".join(x["license"] for x in r) for r in rows], pa.string()), "found": pa.array(rows, kind)})

    return space.documents(docs).mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(space.table(spark, sf_dir, "documents"))
