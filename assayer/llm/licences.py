"""Licence scans with a positional index of rare licence words.

A first pass counts, over all texts, in how many each licence word occurs.  The
index has a posting (template, position) for each word of each template.  The
second pass ranks each text's own licence words once, highest inverse document
frequency first, and looks up their postings in that order.  Templates of which the
text holds enough words are asked for by the first `RARE` of these: postings and
places in the text meet by relative position, and starts that enough of the words
agree on, within `drift` words of each other, are candidates.  Only then is a
template's text touched: a candidate is kept if enough of the template's words stand
at their places, again within the drift, and all its mandatory key phrases stand
there exactly.

Base phrases are templates whose words must all stand at their places; the
rarest word alone proposes theirs, so none is missed.

Both passes only map over whole texts; the counts that come back are one row per
licence word and task.

Defined results: null texts count as empty; a text without a match has empty
labels, null first_word and last_word and score 0; rows that repeat are scanned
each; of several matches all labels count and the score is the best one's; an
empty table gives no rows.  Texts of any length count whole; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import tables, words

#: Rare words that a text looks a template up by, the share of them that must propose a place, and the share of words that must match there.
RARE, PROPOSED, COVERED = 5, 0.5, 0.8


@dataclass(frozen=True)
class Template:
    """Words of a licence text, and phrases of it that must match exactly; a base template has none and matches whole."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    base: bool = False


# Phrases that are always looked for, one-line notices, and the words of well-known licences and notices.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "software and associated documentation")),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("to deal in the software without restriction", "merge publish distribute sublicense"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "bsd-3-clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("endorse or promote products derived from this software",),
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("with or without fee is hereby granted",),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        ("must not be misrepresented", "altered from any source distribution"),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0", "language governing permissions and limitations"),
    ),
    Template(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu general public license", "either version 3 of the license or at your option any later version"),
    ),
    Template(
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu general public license", "either version 2 of the license or at your option any later version"),
    ),
    Template(
        "lgpl-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        ("gnu lesser general public license", "either version 2 1 of the license"),
    ),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ("any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    ),
)


def _hash(text: str) -> np.ndarray:
    return words.split(pa.array([text.encode()]), words.NOT_ALNUM, lower=True).hashes()


class _Finder:
    """Finds which of some known words each word is."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.sort(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words, and which they are."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        same = self.known[which] == hashes[at]
        return at[same], which[same]


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of licence words, ascending, in how many texts each occurs, and how many texts there are."""
    known = np.unique(np.concatenate([_hash(t.text) for t in templates]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n, texts = _Finder(known), np.zeros(len(known), np.int64), 0
        for batch in words.slices(batches, "text"):
            w = words.split(batch.column("text"), words.NOT_ALNUM, lower=True)
            at, which = find(w.hashes())
            of = np.searchsorted(w.first, at, "right") - 1
            n += np.bincount(np.unique(of * len(known) + which) % len(known), minlength=len(known))
            texts += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known) + 1)), pa.array(np.append(n, texts))], ["word", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(known) + 1, np.int64)
    for r in rows:
        n[r["word"]] = r["n"]
    return known, n[:-1], int(n[-1])


class _Checked:
    """A template to hold against a text at a place: its words, their weights, and its key phrases with where they stand."""

    def __init__(self, template: Template, known: np.ndarray, idf: np.ndarray):
        self.template, self.words = template, _hash(template.text)
        self.place = np.searchsorted(known, self.words)
        self.weight = idf[self.place]
        self.drift = 0 if template.base else min(8, len(self.words) // 10)
        self.phrases = []
        for phrase in template.key_phrases:
            k = _hash(phrase)
            self.phrases.append((next(i for i in range(len(self.words) - len(k) + 1) if (self.words[i : i + len(k)] == k).all()), k))

    def verified(self, start: np.ndarray, text: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places where enough words and all key phrases stand, their texts and scores."""
        begin, end = first[text], first[text + 1]

        def stand(want: np.ndarray, offset: int, shift: int) -> np.ndarray:
            place = start[:, None] + offset + shift + np.arange(len(want))[None, :]
            inside = (place >= begin[:, None]) & (place < end[:, None])
            return inside & (hashes[np.clip(place, 0, max(len(hashes) - 1, 0))] == want) if len(start) else inside

        shifts = range(-self.drift, self.drift + 1)
        same = np.logical_or.reduce([stand(self.words, 0, x) for x in shifts])
        score = same @ self.weight / self.weight.sum()
        good = same.all(axis=1) if self.template.base else same.mean(axis=1) >= COVERED
        for offset, k in self.phrases:
            good &= np.logical_or.reduce([stand(k, offset, x).all(axis=1) for x in shifts])
        return start[good], text[good], score[good]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i] to first[i] + n[i] for each i, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Index:
    """Postings: for each licence word the templates that hold it, and its positions in each of them."""

    def __init__(self, parts: list[_Checked], known: np.ndarray, idf: np.ndarray):
        self.words = len(known)
        self.by_rank = np.lexsort((np.arange(len(known)), -idf))  # rarest first
        self.rank = np.argsort(self.by_rank)
        template = np.repeat(np.arange(len(parts)), [len(p.place) for p in parts])
        word, position = np.concatenate([p.place for p in parts]), np.concatenate([np.arange(len(p.place)) for p in parts])
        order = np.lexsort((position, word, template))
        self.posting, self.position = (template * len(known) + word)[order], position[order]
        held = np.unique(word * len(parts) + template)
        self.templates, self.first = held % len(parts), np.searchsorted(held, np.arange(len(known) + 1) * len(parts))
        self.distinct = np.bincount(self.templates, minlength=len(parts))
        base = np.array([p.template.base for p in parts])
        self.least = np.where(base, self.distinct, np.ceil(COVERED * self.distinct - 1e-9)).astype(np.int64)
        self.asked = np.where(base, 1, RARE)
        self.drift = np.array([p.drift for p in parts])

    def proposed(self, at: np.ndarray, of: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Templates that may start in a text, where, and which text; at, of and which are places, texts and words of known words.

        A text's licence words are ranked once, rarest first, and looked up in that
        order.  A template that enough of them name is asked for by the first of these;
        their places meet where they agree on where it starts.
        """
        pair = np.unique(of * self.words + self.rank[which])
        text, word = pair // self.words, self.by_rank[pair % self.words]
        n = self.first[word + 1] - self.first[word]
        template = self.templates[_spread(self.first[word], n)]
        text, word = np.repeat(text, n), np.repeat(word, n)
        order = np.argsort(text * len(self.least) + template, kind="stable")  # a text's words stay in rank order
        text, word, template = text[order], word[order], template[order]
        new = np.append(True, (text[1:] != text[:-1]) | (template[1:] != template[:-1])) if len(text) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(text)))
        group = np.repeat(np.arange(len(begin)), count)
        keep = (count >= self.least[template[begin]])[group] & (np.arange(len(text)) - begin[group] < self.asked[template])
        text, word, template, group = text[keep], word[keep], template[keep], group[keep]
        asked = np.bincount(group, minlength=len(begin))
        order = np.lexsort((at, which, of))
        here = (of * self.words + which)[order]
        bounds = [np.searchsorted(here, text * self.words + word, side) for side in ("left", "right")]
        posts = [np.searchsorted(self.posting, template * self.words + word, side) for side in ("left", "right")]
        n_here, n_post = bounds[1] - bounds[0], posts[1] - posts[0]
        row = np.repeat(np.arange(len(text)), n_here)
        place = at[order][_spread(bounds[0], n_here)]
        n = n_post[row]
        start = np.repeat(place, n) - self.position[_spread(posts[0][row], n)]
        row = np.repeat(row, n)
        low, drift = int(start.min(initial=0)), self.drift[template[row]]
        wide = int(start.max(initial=0)) - low + 2 * int(self.drift.max(initial=0)) + 2
        key = group[row] * wide + start - low
        order = np.argsort(key, kind="stable")
        key, row, drift = key[order], row[order], drift[order]
        votes = np.searchsorted(key, key + drift, "right") - np.searchsorted(key, key - drift, "left")
        good = votes >= np.ceil(PROPOSED * asked[group[row]])
        key, first = np.unique(key[good], return_index=True)
        row = row[good][first]
        return template[row], key - group[row] * wide + low, text[row]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known, n, texts = document_frequencies(docs, templates)
    idf = np.log((texts + 1) / (n + 1)) + 1e-3
    parts = [_Checked(t, known, idf) for t in templates]
    index = _Index(parts, known, idf)

    def matches(w: words.Words, hashes: np.ndarray, find: _Finder) -> Iterator[tuple[Template, np.ndarray, np.ndarray, np.ndarray]]:
        """For each template that some text may hold the texts, places and scores of its matches."""
        at, which = find(hashes)
        template, start, in_text = index.proposed(at, np.searchsorted(w.first, at, "right") - 1, which)
        for t in np.unique(template).tolist():
            own = template == t
            place, text, score = parts[t].verified(start[own], in_text[own], hashes, w.first)
            yield parts[t].template, text, place - w.first[text], score

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(known)
        for batch in words.slices(batches, "text"):
            w = words.split(batch.column("text"), words.NOT_ALNUM, lower=True)
            hashes, rows = w.hashes(), batch.num_rows
            n_base, first, last, score = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64), np.zeros(rows)
            base: dict[int, set[str]] = {}
            every: dict[int, set[str]] = {}
            for t, of, place, found in matches(w, hashes, find):
                np.maximum.at(score, of, found)
                for d in np.unique(of).tolist():
                    every.setdefault(d, set()).add(t.label)
                    if t.base:
                        base.setdefault(d, set()).add(t.label)
                if t.base:
                    n_base += np.bincount(of, minlength=rows)
                    np.minimum.at(first, of, place)
                    np.maximum.at(last, of, place)
            joined = lambda labels: pa.array([",".join(sorted(labels.get(d, ()))) for d in range(rows)], pa.string())
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), joined(base), joined(every), pa.array(np.minimum(score, 1.0))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return cut.mapInArrow(scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents."""
    return scan(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
