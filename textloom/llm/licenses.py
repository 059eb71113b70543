"""License scans by an exact set-similarity join of templates and text blocks.

Blocks are windows of a span of words that begin every half span, so every run of up to
half a span lies in one block. The span goes by the template: the least power of two that is twice its words, ``SPAN`` at least, so a notice
of five words and a whole license text are both found wherever they stand. A template (a set of words) matches a block if the block holds at least a
threshold's part of it. The join, made once for each span, is exact and never compares a block with a template that can't reach the threshold:

* template words are put in one global order, rarest in the corpus first (counted over all documents);
* prefix filter: of a template of n words needing c, one of its n - c + 1 first words must be in the block;
* length filter: a block of fewer than c words can't match;
* positional filter: from the first shared prefix word on, the words left in the template and
  the template words left in the block both bound the overlap;
* what is left is verified by counting the overlap.

Phrases are templates that need all their words; blocks that match one are then checked for places where its words stand
consecutively, and phrases' places, unlike template matches, are the base results.

Templates go to the executors, documents stay where they are: there is no shuffle of text.

Defined results: a null text has no words; without a hit n_base and score are 0, labels are
empty and first_word, last_word null; repeated rows are scanned each; a very long text is scanned whole, in one piece; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SPAN, THRESHOLD = 64, 0.8
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual notices and whole license texts (label, words).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "available under the terms of cc by 4 0"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("reserved", "copyright all rights reserved"),
)


def span_of(words: int) -> int:
    """The span of the blocks that a template of so many words is joined with."""
    return max(SPAN, 1 << (2 * words - 1).bit_length())


class Join:
    """Templates in the global order, ready to be joined with the blocks of texts."""

    def __init__(self, span: int, phrases: dict[str, str], templates: list, threshold: float, counts: dict[int, int]) -> None:
        self.span = span
        self.phrases = [(W.word_list(p), label) for p, label in phrases.items()]
        self.labels = [label for _, label in self.phrases] + [label for label, _ in templates]
        sets = [np.unique(w) for w, _ in self.phrases] + [np.unique(W.word_list(t)) for _, t in templates]
        every = sorted({int(x) for s in sets for x in s}, key=lambda x: (counts.get(x, 0), x))
        rank = {x: i for i, x in enumerate(every)}
        self.n_ranks = len(every)
        order = np.argsort(np.array(every, np.uint64))
        self.vocabulary, self.rank = np.array(every, np.uint64)[order], order
        self.sets = [np.sort([rank[int(x)] for x in s]) for s in sets]
        self.size = np.array([len(s) for s in self.sets])
        part = np.array([1.0] * len(self.phrases) + [threshold] * len(templates))
        self.need = np.ceil(part * self.size - 1e-9).astype(np.int64)
        # Prefix index: rank of a word to the templates with it in their prefix, and its place there.
        found = [(int(r), t, i) for t, s in enumerate(self.sets) for i, r in enumerate(s[: len(s) - self.need[t] + 1])]
        found.sort()
        self.prefix = np.array(found, np.int64).reshape(-1, 3)
        self.flat, self.begin = np.concatenate([np.zeros(0, np.int64), *self.sets]), np.r_[0, np.cumsum(self.size)]

    def known(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of template words, and their ranks."""
        if not self.n_ranks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), self.n_ranks - 1)
        word = np.flatnonzero(self.vocabulary[at] == hashed)
        return word, self.rank[at[word]]

    def matches(self, word: np.ndarray, rank: np.ndarray, block: np.ndarray, half: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of all matches. block: of each word, the later of its two; half: the number of that in its text."""
        n = self.n_ranks
        held = np.unique(np.r_[block * n + rank, (block[half > 0] - 1) * n + rank[half > 0]])  # sorted by block, then rank
        b, r = held // n, held % n
        head = np.flatnonzero(np.r_[len(b) > 0, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        ends = np.repeat(np.r_[head[1:], len(b)], np.diff(np.r_[head, len(b)])) if len(b) else head
        low, high = np.searchsorted(self.prefix[:, 0], r), np.searchsorted(self.prefix[:, 0], r, "right")
        which = np.repeat(np.arange(len(b)), high - low)
        entry = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
        template, place = self.prefix[entry, 1], self.prefix[entry, 2]
        key = b[which] * len(self.sets) + template
        _, first = np.unique(key, return_index=True)  # ranks ascend: the first shared word
        which, template, place = which[first], template[first], place[first]
        need = self.need[template]
        ok = (length[b[which]] >= need) & (self.size[template] - place >= need) & (ends[which] - which >= need)
        at, template = b[which[ok]], template[ok]
        size = self.size[template]
        token = self.flat[np.repeat(self.begin[template] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        want = np.repeat(at, size) * n + token
        if not len(want):
            return at, template, size
        hit = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
        overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        ok = overlap >= self.need[template]
        return at[ok], template[ok], overlap[ok]


def count_words(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for part in W.slices(batch):
            hashed, _ = W.words(*W.raw(part.column("text")))
            at = np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)
            seen += np.bincount(at[wanted[at] == hashed], minlength=len(wanted))
    yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(seen)], names=["word", "n"])


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))


def scan(batches: Iterator[pa.RecordBatch], joins: list[Join]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            hashed, doc = W.words(*W.raw(part.column("text")))
            n = part.num_rows
            count = np.bincount(doc, minlength=n)
            begin = np.cumsum(count) - count
            labels: list[set[str]] = [set() for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            score, n_base = np.zeros(n), np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            spans: list[list] = [[] for _ in range(n)]
            for join in joins:
                step = join.span // 2
                blocks = (count + step - 1) // step
                first_block = np.cumsum(blocks) - blocks
                owner = np.repeat(np.arange(n), blocks)
                length = np.minimum(join.span, count[owner] - (np.arange(len(owner)) - first_block[owner]) * step)
                word, rank = join.known(hashed)
                half = (word - begin[doc[word]]) // step
                block, template, overlap = join.matches(word, rank, first_block[doc[word]] + half, half, length)
                for p, (phrase, label) in enumerate(join.phrases):
                    k = len(phrase)
                    of = block[template == p]
                    start = (begin[owner[of]] + (of - first_block[owner[of]]) * step)[:, None] + np.arange(join.span)
                    start = np.unique(start[start + k <= (begin + count)[owner[of]][:, None]])
                    for j in range(k):
                        start = start[hashed[start + j] == phrase[j]]
                    at = doc[start]
                    n_base += np.bincount(at, minlength=n)
                    np.minimum.at(low, at, start - begin[at])
                    np.maximum.at(high, at, start - begin[at])
                    for d, s in zip(at.tolist(), (start - begin[at]).tolist(), strict=True):
                        base[d].add(label)
                        spans[d].append({"label": label, "first_word": s, "n_words": k, "containment": 1.0})
                    score[at] = 1.0
                for b, t, o in zip(block.tolist(), template.tolist(), overlap.tolist(), strict=True):
                    if t >= len(join.phrases):
                        d, c = int(owner[b]), o / int(join.size[t])
                        labels[d].add(join.labels[t])
                        score[d] = max(score[d], c)
                        spans[d].append({"label": join.labels[t], "first_word": int(b - first_block[d]) * step, "n_words": int(length[b]), "containment": c})
            none = pa.array(high < 0)
            text = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(count, pa.int64()), pa.array(n_base, pa.int64()), pa.array(low, pa.int64(), mask=np.asarray(none)), pa.array(high, pa.int64(), mask=np.asarray(none)),
                    text(base), text([a | b for a, b in zip(base, labels, strict=True)]), pa.array(score), pa.array(spans, SPANS),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and labels of phrases, labels of templates, the highest containment, and the spans found."""
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(W.word_list(t) for t in [*phrases, *(t for _, t in templates)])]))
    counts = docs.select("text").mapInArrow(lambda it: count_words(it, wanted), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect() if len(wanted) else []
    counts = {r.word % (1 << 64): r.n for r in counts}
    by: dict[int, tuple[dict, list]] = {}
    for p, label in phrases.items():
        by.setdefault(span_of(len(W.word_list(p))), ({}, []))[0][p] = label
    for label, t in templates:
        by.setdefault(span_of(len(W.word_list(t))), ({}, []))[1].append((label, t))
    joins = [Join(span, p, t, threshold, counts) for span, (p, t) in sorted(by.items())]
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<label: string, first_word: bigint, n_words: bigint, containment: double>>"
    return docs.select("doc_id", "text").mapInArrow(lambda it: scan(it, joins), f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {span}")
