"""Licence scans: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a window of words, a new one every half of its length, so any passage of half a block lies whole in one. Each template has blocks of its own
size, a power of two of at least BLOCK words of which half hold the template with room to spare. A block holds a template if it has at least THRESHOLD of the template's distinct words.
Words are ordered by the number of blocks of the whole corpus that hold them, rarest first. An index leads from words to the templates
that have them among their first ones in that order (prefix filter), so a block meets only templates that it shares such a word with. Of these it must hold enough template
words at all (length filter), and from the first common one on both must have enough words left, the template and the block (positional filter); what
is left is counted exactly. Templates are a fixed list, so they go to every task, and blocks are never shuffled.

Sets know no order, so a block that holds a template is a candidate: its label is given where the template's words also stand in their order (longest common
subsequence, THRESHOLD of all words) within SPAN times its length, and the words that tell licences of one family apart (TELLING) between
its ends, or right behind them, are just the template's own. Of templates found at one place those with most words in common stay, and of these the most complete.

A null text is empty: no words, no labels, score 0. Each row is scanned by itself, so ties and repeated rows change nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstone.llm.common import buffers, slices, split_words, table

BLOCK = 128
THRESHOLD = 0.85
SPAN = 1.5

#: Phrases of the base labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Words that tell licences of one family apart: a template stands only where they are the same as its own.
TELLING = "nc noncommercial sa sharealike nd noderivatives noderivs lesser library affero bsd mit isc apache cc0".split()
#: The licences of one family, by label.
CREATIVE = {
    "cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nc": "Attribution-NonCommercial", "cc-by-nd": "Attribution-NoDerivatives",
    "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
#: Public licence notices, and one-line forms in common use.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    *((label, f"Licensed under {label.upper().replace('-', ' ', 1)} 4.0") for label in CREATIVE),
    *((label, f"This work is licensed under a Creative Commons {name} 4.0 International License") for label, name in CREATIVE.items()),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Released under the BSD License"),
    # Heads of whole licences.
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("apache", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("mpl", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    # Whole licence texts.
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)

#: Bytes of words, once A to Z are lower: digits, a to z, and all of multi-byte characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z lower; no other character changes."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def words_of(text: str) -> list[str]:
    data, off = buffers(pa.array([text]))
    data = lower(data)
    codes, distinct = split_words(data, off, ~IN_WORD[data]).codes()
    return [distinct[int(i)].as_py() for i in codes]


def block_of(n_words: int) -> int:
    """Words of the blocks for a template of so many words."""
    size = BLOCK
    while size // 2 < reach(n_words):
        size *= 2
    return size


def reach(n_words: int) -> int:
    """Words within which a template of so many words may stand."""
    return int(np.ceil(SPAN * n_words)) + 2


@dataclass
class Templates:
    """Templates as sequences and sets of word numbers."""

    labels: list[str]
    words: list[list[int]]
    phrases: list[tuple[list[int], str]]
    vocabulary: list[str]
    order: list[list[int]] = field(default_factory=list)  #: each set, rarest word first

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]) -> Templates:
        split = [(label, words_of(text)) for label, text in templates]
        terms = [(words_of(text), label) for text, label in phrases]
        vocabulary = sorted({w for _, ws in split for w in ws} | {w for ws, _ in terms for w in ws} | set(TELLING))
        number = {w: i for i, w in enumerate(vocabulary)}
        return cls([x for x, _ in split], [[number[w] for w in ws] for _, ws in split], [([number[w] for w in ws], label) for ws, label in terms], vocabulary)

    @property
    def sizes(self) -> list[int]:
        """Sizes of blocks, each once."""
        return sorted({block_of(len(w)) for w in self.words})

    def telling(self, numbers: Iterable[int]) -> set[str]:
        return {self.vocabulary[i] for i in numbers} & set(TELLING)

    def held(self, size: int) -> np.ndarray:
        """Which words the templates with blocks of that size hold."""
        out = np.zeros(len(self.vocabulary), bool)
        for w in self.words:
            out[w] |= block_of(len(w)) == size
        return out

    def ordered(self, frequency: dict[int, np.ndarray]) -> Templates:
        return Templates(self.labels, self.words, self.phrases, self.vocabulary, [sorted(set(w), key=lambda c: (frequency[block_of(len(w))][c], c)) for w in self.words])


def in_order(template: list[int], words: np.ndarray) -> int:
    """Length of the longest common subsequence: the longest run of rising places of the template, taken from its end for each word."""
    places: dict[int, list[int]] = {}
    for i in range(len(template) - 1, -1, -1):
        places.setdefault(template[i], []).append(i)
    ends: list[int] = []  # least last place of a subsequence of each length
    for w in words.tolist():
        for i in places.get(w, ()):
            at = bisect_left(ends, i)
            ends[at : at + 1] = [i]
    return len(ends)


def placed(template: list[int], words: np.ndarray, at: np.ndarray, threshold: float) -> tuple[int, int, int] | None:
    """Words in common, and where they begin and end, at the best place where the template's words stand in order within its reach; ``at``: positions of ``words`` (those of the template alone)."""
    need, wide, step = threshold * len(template) - 1e-9, reach(len(template)), max(1, len(template) // 8)
    if in_order(template, words) < need:
        return None
    best = None
    a = 0
    while a < len(at):
        b = int(np.searchsorted(at, at[a] + wide + step - 1))
        if b - a >= need:
            got = in_order(template, words[a:b])
            if got >= need and (best is None or got > best[0]):
                best = (got, int(at[a]), int(at[b - 1]))
        a = max(a + 1, int(np.searchsorted(at, at[a] + step)))
    return best


def found(batch: pa.RecordBatch, t: Templates) -> pa.RecordBatch:
    """Per text: its number of words, the base result, and where it holds template words (word numbers and positions, packed)."""
    data, off = buffers(batch.column("text"))
    data = lower(data)
    words = split_words(data, off, ~IN_WORD[data])
    codes, distinct = words.codes()
    at = pc.index_in(distinct, value_set=pa.array(t.vocabulary, pa.large_utf8())).fill_null(-1).to_numpy(zero_copy_only=False)
    seq = at[codes].astype(np.int32) if len(codes) else np.zeros(0, np.int32)
    rows = len(off) - 1
    doc_of = lambda i: np.searchsorted(words.doc, i, side="right") - 1
    n_base = np.zeros(rows, np.int64)
    labels: dict[int, set[str]] = {}
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
    for phrase, label in t.phrases:
        k = len(phrase)
        hit = np.flatnonzero(seq[: max(0, len(seq) - k + 1)] == phrase[0])
        for j in range(1, k):
            hit = hit[seq[hit + j] == phrase[j]]
        doc = doc_of(hit)
        inside = hit + k <= words.doc[doc + 1]
        hit, doc = hit[inside], doc[inside]
        place = hit - words.doc[doc]
        n_base += np.bincount(doc, minlength=rows)
        for d in np.unique(doc).tolist():
            labels.setdefault(d, set()).add(label)
        np.minimum.at(first, doc, place)
        np.maximum.at(last, doc, place)
    hits = np.flatnonzero(seq >= 0)
    bounds = np.searchsorted(hits, words.doc)
    place = (hits - words.doc[doc_of(hits)]).astype("<i4") if len(hits) else np.zeros(0, "<i4")
    packed = lambda x: pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(bounds.astype(np.int64) * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    none = n_base == 0
    return pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_words": pa.array(words.counts), "n_base": pa.array(n_base), "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "base": pa.array([",".join(sorted(labels.get(i, ()))) for i in range(rows)], pa.string()), "codes": packed(seq[hits].astype("<i4")), "places": packed(place)})


FOUND = "key long, n_words long, n_base long, first_word long, last_word long, base string, codes binary, places binary"


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template words of all texts, their positions, and where each text's begin."""

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        data, off = buffers(batch.column(name))
        return data.view("<i4") if len(data) else np.zeros(0, "<i4"), off // 4

    (codes, off), (places, _) = flat("codes"), flat("places")
    return codes, places, off


def blocks(codes: np.ndarray, places: np.ndarray, off: np.ndarray, n_codes: int, size: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, word) pairs of the ``held`` words, in order: the text of each block and its number there, the block of each pair, the word of each pair."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    on = held[codes] if len(codes) else np.zeros(0, bool)
    codes, places, row = codes[on], places[on], row[on]
    step = size // 2
    own = (row.astype(np.int64) << 32) | (places // step)
    again = places >= step
    both, word = np.concatenate([own, own[again] - 1]), np.concatenate([codes, codes[again]])
    order = np.lexsort((word, both))
    both, word = both[order], word[order]
    once = np.ones(len(both), bool)
    once[1:] = (both[1:] != both[:-1]) | (word[1:] != word[:-1])
    block, index = np.unique(both[once], return_inverse=True)
    return block >> 32, block & 0xFFFFFFFF, index, word[once]


def least_held(n: int, threshold: float) -> int:
    """Words of a set of n that a block must hold."""
    return int(np.ceil(threshold * n - 1e-9))


@dataclass
class Index:
    """From words to the templates that begin with them, for blocks of one size."""

    rank: np.ndarray  #: place of each word in the order of the corpus
    start: np.ndarray  #: where each word's entries begin
    template: np.ndarray  #: of each entry, the template
    place: np.ndarray  #: and the word's place in it
    sizes: np.ndarray  #: words of each template
    need: np.ndarray  #: words of each template that a block must hold

    def candidates(self, block: np.ndarray, code: np.ndarray, n_blocks: int) -> Iterator[tuple[int, np.ndarray]]:
        """Templates with the blocks that may hold them. ``block`` and ``code``: the words of blocks, by block."""
        held = np.bincount(block, minlength=n_blocks)
        order = np.lexsort((self.rank[code], block))
        before = np.arange(len(order)) - (np.cumsum(held) - held)[block[order]]  # words of the block that are rarer
        many = np.diff(self.start)[code[order]]
        pair = np.repeat(np.arange(len(order)), many)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[code[order]], many)
        b, t = block[order][pair], self.template[entry]
        once = np.unique(b.astype(np.int64) * len(self.sizes) + t, return_index=True)[1]  # pairs are by rank within a block: the first common word
        b, t, place, before = b[once], t[once], self.place[entry[once]], before[pair[once]]
        fits = (held[b] >= self.need[t]) & (np.minimum(self.sizes[t] - place, held[b] - before) >= self.need[t])
        b, t = b[fits], t[fits]
        for number in np.unique(t).tolist():
            yield number, b[t == number]


def prefix_index(t: Templates, frequency: np.ndarray, size: int, n_codes: int, threshold: float) -> Index:
    rank = np.empty(n_codes, np.int64)
    rank[np.lexsort((np.arange(n_codes), frequency))] = np.arange(n_codes)
    own = [(code, number, place) for number, order in enumerate(t.order) if block_of(len(t.words[number])) == size for place, code in enumerate(order[: len(order) - least_held(len(order), threshold) + 1])]
    code, number, place = (np.array(x, np.int64) for x in zip(*sorted(own), strict=True))
    sizes = np.array([len(o) for o in t.order])
    return Index(rank, np.searchsorted(code, np.arange(n_codes + 1)), number, place, sizes, np.array([least_held(n, threshold) for n in sizes.tolist()]))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: key, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template's words in a block), contained (labels of all templates held by a block), n_blocks (pairs of a block and a template that it holds)."""
    t = Templates.of(templates, phrases)
    size, kinds = len(t.vocabulary), [(b, t.held(b)) for b in t.sizes]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield found(part, t)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kinds), size), np.int64)
        for batch in batches:
            words = unpacked(batch)
            for i, (b, held) in enumerate(kinds):
                total[i] += np.bincount(blocks(*words, size, b, held)[3], minlength=size)
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.repeat([b for b, _ in kinds], size).astype(np.int64)), "code": pa.array(np.tile(np.arange(size), len(kinds))), "n": pa.array(total.ravel())})

    rows = table(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(find, FOUND), "license-words")
    frequency = {b: np.zeros(size, np.int64) for b, _ in kinds}
    for b, code, n in rows.select("codes", "places").mapInArrow(count, "block long, code long, n long").groupBy("block", "code").agg(F.sum("n")).collect():  # a row for each size of blocks and template word
        frequency[b][code] = n
    ready = t.ordered(frequency)

    indexes = {b: prefix_index(ready, frequency[b], b, size, threshold) for b, _ in kinds}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, places, off = unpacked(batch)
            score, matching = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            contained: dict[int, set[str]] = {}
            candidates: dict[int, list[tuple[int, int, int]]] = {}  # of each text: template, and the words of the block
            for b, kept in kinds:
                block_row, block_number, block, code = blocks(codes, places, off, size, b, kept)
                n_blocks = len(block_row)
                for number, may in indexes[b].candidates(block, code, n_blocks):
                    order = ready.order[number]
                    member = np.zeros(size, bool)
                    member[order] = True
                    flag = np.zeros(n_blocks, bool)
                    flag[may] = True
                    overlap = np.bincount(block[flag[block] & member[code]], minlength=n_blocks)
                    np.maximum.at(score, block_row, overlap / len(order))
                    full = np.flatnonzero(overlap >= least_held(len(order), threshold))
                    np.add.at(matching, block_row[full], 1)
                    for r, i in zip(block_row[full].tolist(), block_number[full].tolist(), strict=True):
                        contained.setdefault(r, set()).add(ready.labels[number])
                        candidates.setdefault(r, []).append((number, i * (b // 2), i * (b // 2) + b))
            labels = {r: chosen(c, codes[off[r] : off[r + 1]], places[off[r] : off[r + 1]]) for r, c in candidates.items()}
            base = [set(x.split(",")) - {""} for x in batch.column("base").to_pylist()]
            score[[bool(x) for x in base]] = 1.0
            joined = lambda x: ",".join(sorted(x))
            out = {key: batch.column("key")} | {c: batch.column(c) for c in ("n_words", "n_base", "first_word", "last_word")}
            yield pa.RecordBatch.from_pydict(out | {"base_labels": batch.column("base"), "labels": pa.array([joined(labels.get(i, set()) | x) for i, x in enumerate(base)], pa.string()), "score": pa.array(score), "contained": pa.array([joined(contained.get(i, ())) for i in range(batch.num_rows)], pa.string()), "n_blocks": pa.array(matching)})

    def chosen(candidates: list[tuple[int, int, int]], words: np.ndarray, at: np.ndarray) -> set[str]:
        """Labels of the templates that stand in a text in order; of those at one place the most specific."""
        got = []
        for number, begin, end in candidates:
            template = ready.words[number]
            a, b = np.searchsorted(at, (begin, end))
            own = np.isin(words[a:b], template)
            where = placed(template, words[a:b][own], at[a:b][own], threshold)
            if where:
                x, y = np.searchsorted(at, (where[1], where[2] + 3))
                if ready.telling(words[x:y].tolist()) != ready.telling(template):
                    continue
                got.append((where[0], where[0] / len(template), where[1], where[2], ready.labels[number]))
        got.sort(key=lambda x: (-x[0], -x[1]))
        kept: list[tuple] = []
        for n, share, begin, end, label in got:
            if not any(begin <= e and b <= end and (m, s) > (n, share) for m, s, b, e, _ in kept):
                kept.append((n, share, begin, end, label))
        return {x[-1] for x in kept}

    return rows.mapInArrow(join, f"{key} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, contained string, n_blocks long")
