"""Licence texts in documents by patience alignment.

A template is aligned on the words that occur once in it and once in the passage: the longest increasing run of
these anchors is kept, and the gaps between them are aligned in the same way, with equal words at either end of a
gap matched first. Coverage is the share of the template's words that the alignment matches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.llm._words import buffers, column, pieces, span_hashes, word_spans

COVERAGE = 0.8

#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of letter and digit runs in lower case, their offsets by text, byte spans, and text offsets."""
    data, off = buffers(texts)
    low = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    starts, ends, words = word_spans(low, off, _PARTS)
    return span_hashes(low, starts, ends), words, starts, ends, off


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
        back[i] = last[k - 1] if k else -1
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    out = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if ours[w] == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if theirs[w] == 1 and w in where]
        keep = [anchors[i] for i in increasing([i for i, _ in anchors])]
        if not keep:
            continue
        out += keep
        edges = [(a - 1, c - 1), *keep, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:])]
    return sorted(out)


def passages(text: list[int], template: list[int], coverage: float = COVERAGE) -> Iterator[tuple[int, int]]:
    """Stretches of a text that may each hold the template once.

    A notice that reaches the coverage misses at most `spare` of the template's words, so it holds one of any spare + 1 of
    them; those that the text has least often mark the stretches. Around each of their occurrences come the
    stretch that the template would fill, the same with room for `spare` and for as many more words as the template has on
    either side, and one of twice the template's length on either side that ends before the word's next occurrence.
    Stretches without enough of the template's words, each as often as it has them, are left out.
    """
    n = len(template)
    need = ceil(coverage * n - 1e-9)
    spare = n - need
    count, own = Counter(text), Counter(template)
    held, marks = 0, []
    for w in sorted(own, key=lambda w: (count[w], w)):
        if held > spare:
            break
        held += own[w]
        marks.append(w)
    at: dict[int, list[int]] = {w: [] for w in marks}
    for i, w in enumerate(text):
        if w in at:
            at[w].append(i)
    seen = set()
    for w, places in at.items():
        theirs = [j for j, x in enumerate(template) if x == w]
        for k, i in enumerate(places):
            spans = [(i - j - room, i - j + n + room) for j in theirs for room in (0, spare, n)]
            spans.append((max(i - 2 * n, places[k - 1] + 1 if k else 0), min(i + 2 * n + 1, places[k + 1] if k + 1 < len(places) else len(text))))
            for low, high in spans:
                span = max(0, low), min(len(text), high)
                if span not in seen:
                    seen.add(span)
                    if (Counter(text[span[0] : span[1]]) & own).total() >= need:
                        yield span


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, license, coverage, copies, start, end): templates that a document covers to at least `coverage`.

    coverage is that of the best passage, start and end the code points its matched words span (the first of equally
    good ones), copies the number of passages that reach the bound. Of templates on overlapping passages the one with the
    largest coverage, then the most words, counts. Words are runs of letters and digits, case aside.
    Null and empty texts have no rows; repeated rows have rows each. Only doc_id and text are looked at.

    A text is aligned only with templates of which it has enough words at all; no more can be matched than that.
    """
    templates = dict(templates or TEMPLATES)
    names = sorted(templates)
    hashes, off, *_ = _hashed(pa.array([templates[n] for n in names], pa.large_string()))
    vocab = np.unique(hashes)
    sequences = [np.searchsorted(vocab, hashes[a:b]).tolist() for a, b in zip(off[:-1], off[1:])]
    weights = np.zeros((len(vocab), len(names)))
    for k, seq in enumerate(sequences):
        np.add.at(weights[:, k], seq, 1.0 / max(1, len(seq)))
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab >> np.uint64(48)).astype(np.int64)] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, word_off, starts, ends, text_off = _hashed(column(batch, "text"))
            at = np.flatnonzero(maybe[(words >> np.uint64(48)).astype(np.int64)])
            word = np.minimum(np.searchsorted(vocab, words[at]), len(vocab) - 1)
            real = vocab[word] == words[at]
            at, word = at[real], word[real]
            doc = np.searchsorted(word_off, at, "right") - 1
            there = np.unique(doc * len(vocab) + word)
            most = np.zeros((batch.num_rows, len(names)))
            np.add.at(most, there // len(vocab), weights[there % len(vocab)])
            could = most >= coverage - 1e-9
            data, _ = buffers(column(batch, "text"))
            found: list[tuple] = []
            per_doc: dict[int, set[tuple]] = {}
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i, k in zip(*np.nonzero(could)):
                seq = sequences[k]
                own = word[edges[i] : edges[i + 1]]
                use = np.flatnonzero(np.isin(own, seq))
                text, where = own[use].tolist(), at[edges[i] : edges[i + 1]][use]
                for low, high in passages(text, seq, coverage):
                    got = aligned(text[low:high], seq)
                    share = len(got) / len(seq)
                    if share >= coverage - 1e-9:
                        first, last = int(where[low + got[0][0]]), int(where[low + got[-1][0]])
                        per_doc.setdefault(int(i), set()).add((-share, -len(got), last - first, first, last, int(k)))
            for i, matches in per_doc.items():
                kept: list[tuple] = []  # ascending, and no two overlap
                for m in sorted(matches):
                    k = bisect_left(kept, m[3], key=lambda x: x[4])
                    if k == len(kept) or kept[k][3] > m[4]:
                        insort(kept, m, key=lambda x: x[4])
                for k in sorted({m[5] for m in kept}):
                    own = sorted((m for m in kept if m[5] == k), key=lambda m: (m[0], m[1], m[3]))
                    begin = text_off[i]
                    span = [len(data[begin:x].tobytes().decode()) for x in (starts[own[0][3]], ends[own[0][4]])]
                    found.append((i, names[k], -own[0][0], len(own), *span))
            cols = list(zip(*found)) or [[]] * 6
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(cols[0], pa.int64()))
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(cols[1:], types)]],
                names=["doc_id", "license", "coverage", "copies", "start", "end"],
            )

    out = "doc_id long, license string, coverage double, copies long, start long, end long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, out)
