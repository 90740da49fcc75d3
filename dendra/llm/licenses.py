"""License scan by conditional compression.

A candidate block is compressed by itself and with each license template as zstandard raw dictionary; the
template that saves most is the winner, and it is confirmed by the exact differences in wording. A notice may
be wrapped over lines, so a block is also tried together with the text around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, chunks, texts_of

#: Fixed wordings: (license, text). Each text is a notice as it is found in documents.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher."),
)
#: A sentence with one of these may belong to a notice.
CUES = r"(?i)licen[cs]|copyright|redistribut|permission|public domain|all rights reserved|warrant|free software|creative commons|\bCC[ -](?:BY|0)|source code form|\bMPL\b|as[ -]is\b|you (?:can|may) obtain|liab(?:le|ility)"
_CUE = re.compile(CUES)
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?;:](?=\s)|(?=\n)|\Z)", re.S)
_WORD = re.compile(r"[\w.+-]*\w")
LEVEL = 3
#: A run of sentences with cues, and a sentence without an end, is cut into blocks of up to so many characters; what a cut divides is found in the text around a block.
BLOCK_CHARS = 2000


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def bounded_sentences(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of sentences; one without an end is cut before the last word that would make it longer than BLOCK_CHARS, or there within a word as long as that."""
    for m in _SENTENCE.finditer(text):
        at = m.start()
        while m.end() - at > BLOCK_CHARS:
            blank = max(text.rfind(x, at + 1, at + BLOCK_CHARS) for x in " \t")
            to = blank if blank > at else at + BLOCK_CHARS
            yield at, to
            at = to
        yield at, m.end()


def blocks(text: str) -> list[tuple[int, int]]:
    """Bounds of runs of sentences with a cue, up to BLOCK_CHARS; one sentence without a cue inside a run doesn't end it. Lines end sentences."""
    found: list[list[int]] = []
    idle = 2
    for start, end in bounded_sentences(text):
        said = text[start:end]
        if not said.strip():
            continue
        if _CUE.search(said):
            start += len(said) - len(said.lstrip())
            if found and idle < 2 and end - found[-1][0] <= BLOCK_CHARS:
                found[-1][1] = end
            else:
                found.append([start, end])
            idle = 0
        else:
            idle += 1
    return [(a, b) for a, b in found]


def words_before(text: str, low: int, at: int, n: int) -> int:
    """Where the last n words of text[low:at] start; low if there are fewer."""
    size = 16 * n
    while True:
        start = max(low, at - size)
        spans = [m.start() for m in _WORD.finditer(text, start, at)]
        if start == low or len(spans) > n:
            return spans[-n] if len(spans) > n else low
        size *= 2


def words_after(text: str, at: int, high: int, n: int) -> int:
    """Where the first n words of text[at:high] end; high if there are fewer."""
    ends = [m.end() for m in islice(_WORD.finditer(text, at, high), n)]
    return ends[-1] if len(ends) == n else high


def differences(block: list[str], template: list[str]) -> tuple[int, int, int]:
    """(differing words, first, last) of the part of the block that the template matches: words of either that the other lacks."""
    same = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return len(template), 0, 0
    first, last = same[0].a, same[-1].a + same[-1].size
    matched = sum(m.size for m in same)
    return (len(template) - matched) + (last - first - matched), first, last


class Scanner:
    """Holds a compressor for each template."""

    def __init__(self, templates=TEMPLATES, max_difference: float = 0.2):
        self.templates = [(name, text, words_of(text)) for name, text in templates]
        dictionaries = [zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in dictionaries]
        self.max_difference = max_difference
        #: Words around a block that may belong to a notice of it.
        self.around = int(max(len(w) for *_, w in self.templates) * (1 + max_difference)) + 1

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(size reduction in bytes, template), the largest reduction first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        base = len(self.alone.compress(raw))
        return sorted(((base - len(c.compress(raw)), i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def winner(self, block: str, tried: int = 5) -> tuple[int, int, int, int, int, bool] | None:
        """(template, reduction, words that differ, first and last word of the match, confirmed).

        Of the `tried` largest reductions the one with the fewest differing words for its length wins; it is
        confirmed if these are at most `max_difference` of the template's words. If it isn't, the other templates
        follow in order of their reductions until one is confirmed.
        """
        words, best, held = words_of(block), (9.0,), None
        for k, (reduction, i) in enumerate(self.rank(block)):
            template, allowed = self.templates[i][2], self.max_difference * len(self.templates[i][2])
            if k >= tried:
                if best[0] <= self.max_difference:
                    break
                held = held or Counter(words)
                if sum(max(0, m - held[w]) for w, m in Counter(template).items()) > allowed:
                    continue  # words that the block lacks differ in any alignment
            n, first, last = differences(words, template)
            if k < tried or n / len(template) <= self.max_difference:
                best = min(best, (n / len(template), -len(template), -reduction, i, n, first, last))
        share, _, reduction, i, n, first, last = best
        return i, -reduction, n, first, last, share <= self.max_difference

    def notice(self, text: str, a: int, b: int, low: int, high: int) -> tuple | None:
        """(start, end, license, reduction, differences, template words, True) of the confirmed notice in text[a:b] or around it, within low and high.

        The block by itself and the block with as many words on both sides as the longest template has are both tried; the one
        with fewer differing words for the template's length counts, then the longer template. If neither is confirmed, the block's
        sentences are tried one by one.
        """
        wide = words_before(text, low, a, self.around), words_after(text, b, high, self.around)
        best = None
        sentences = [m.span() for m in _SENTENCE.finditer(text, a, b) if _CUE.search(m[0])]
        for k, (start, end) in enumerate(dict.fromkeys([(a, b), wide, *sentences])):
            if k > 1 and best:
                break
            i, reduction, n, first, last, sure = self.winner(text[start:end])
            if sure:
                spans = [m.span() for m in _WORD.finditer(text, start, end)]
                size = len(self.templates[i][2])
                row = (spans[first][0], spans[last - 1][1], self.templates[i][0], reduction, n, size, True)
                best = min(best or (9.0,), (n / size, -size, start != a or end != b, row))
        return best and best[-1]

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, license, reduction, differences, template words, confirmed) of each notice.

        A confirmed match is taken out of the text and the rest of the blocks is scanned again, since a block may hold several notices.
        """
        text = text or ""
        found, taken, open_blocks = [], [], blocks(text)
        while open_blocks:
            a, b = open_blocks.pop(0)
            block = text[a:b]
            if not words_of(block) or not _CUE.search(block):
                continue
            low, high = max((e for _, e in taken if e <= a), default=0), min((s for s, _ in taken if s >= b), default=len(text))
            hit = self.notice(text, a, b, low, high)
            if hit:
                start, end = hit[:2]
                taken.append((start, end))
                rest = [(a, b), *open_blocks]
                open_blocks = [p for x, y in rest for p in ((x, min(y, start)), (max(x, end), y)) if p[0] < p[1]]
                found.append(hit)
            else:
                i, reduction, n, *_ = self.winner(block)
                found.append((a, b, self.templates[i][0], reduction, n, len(self.templates[i][2]), False))
        return sorted(found)


SCHEMA = "doc_id long, start int, end int, license string, reduction int, differences int, template_words int, confirmed boolean"


def scan_documents(docs: DataFrame, templates=TEMPLATES, max_difference: float = 0.2) -> DataFrame:
    """One row per candidate block or confirmed notice of each whole text, with columns SCHEMA; start and end in characters.

    `confirmed` tells whether the wording differs from the template in at most `max_difference` of its words;
    other rows name the nearest template of a block that has a cue but no known wording. Texts without a cue
    are left out before Python. A null or empty text has no rows; a very long text is scanned whole, in blocks of bounded size; of
    templates that differ by an equal share of words the longer one is named, then the one with the larger reduction; a null doc_id is returned as
    null; repeated rows are each scanned; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def scanned(batches):
        scanner = Scanner(templates, max_difference)
        for batch in (part for b in batches for part in chunks([b], 512)):
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in scanner.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    narrow = texts_of(docs)
    return arrow_map(narrow.where(F.col("text").rlike(CUES)), scanned, SCHEMA)
