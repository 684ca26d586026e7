"""License scan: exact set-similarity join of text blocks with license templates, by containment.

Templates are short statements, headers and whole license texts, from ``TEMPLATES`` or from a table (label, text) of at most
``TABLE`` bytes, which every task gets whole. Words are maximal runs of ASCII digits, ASCII letters and anything beyond ASCII,
with A-Z lowered. Blocks are the lines and, since statements are wrapped, the whole text; for short templates what has more
than ``WINDOW`` words is cut into windows of ``WINDOW`` words, for longer ones (in classes of doubling size) into windows twice as
long as the class allows a statement to be: twice the distinct words of its longest template. Windows overlap by that length, so
that every run of so many words lies whole in a block, across lines too. A block matches a template if it holds at least
``threshold`` of the template's distinct words.

The join is exact. All template words are ordered by how many documents of the whole corpus hold them, rarest first.
A block that meets the threshold must share a word with the template's prefix (prefix filter), must have enough words
(length filter), and after a first shared word at place i can gain at most the template's words behind i (positional
filter); only what passes is counted out. The corpus counts cover the templates' words, a table of fixed size.

``templates`` lists all matches. A block gives the labels of those that hold all of their template's words that tell licenses apart
(``TELLING``), but for those whose matched words another one holds too, and more: a license's variant hides the license there.
Besides, fixed phrases give base labels wherever their words stand one after another, across lines too.

Defined cases: very long texts are scanned whole, alone in their batch; templates without words match nothing, and a larger
table of templates is an error; null text is empty, has no words and no labels; repeated rows are labelled alike; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, slices

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Statements, whole license texts and headers by which works state their license, with the label each stands for.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/."""),
)
#: Words that a match of a template that has them can't lack if it is to give its label.
TELLING = frozenset((b"mit", b"apache", b"gnu", b"lesser", b"mozilla", b"cc", b"nc", b"sa", b"creative", b"commons"))
THRESHOLD, WINDOW = 0.8, 64
#: Bytes of text that a table of templates has at most.
TABLE = 32 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Works on UTF-8: all bytes of characters beyond ASCII are over 127, and only those."""
    return data.translate(_WORDS).split()


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]  # distinct, rarest in the corpus first
    need: int  # words that a block must share


def ordered_templates(templates: Sequence[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        distinct = sorted(set(words_of(text.encode())), key=lambda w: (counts.get(w, 0), w))
        out.append(Template(label, tuple(distinct), max(1, math.ceil(threshold * len(distinct) - 1e-9))))
    return out


def prefix_index(templates: Sequence[Template]) -> dict[bytes, list[tuple[int, int]]]:
    """Prefix word -> (template, place of the word). One of a template's first ``n - need + 1`` words is in any match."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for place, word in enumerate(t.words[: len(t.words) - t.need + 1]):
            index.setdefault(word, []).append((k, place))
    return index


class Scale(NamedTuple):
    """Templates of about the same length, and the windows in which they are looked for."""

    templates: list[Template]
    numbers: list[int]  # of these among all
    index: dict[bytes, list[tuple[int, int]]]
    window: int
    longest: int


def scales(templates: Sequence[Template], window: int = WINDOW) -> list[Scale]:
    """Short templates are one class, longer ones one for each doubling of their distinct words."""
    by: dict[int, list[int]] = {}
    for k, t in enumerate(templates):
        if t.words:
            by.setdefault(0 if 8 * len(t.words) <= 3 * window else (2 * len(t.words)).bit_length(), []).append(k)
    out = []
    for size, numbers in sorted(by.items()):
        own = [templates[k] for k in numbers]
        longest = 2 * max(len(t.words) for t in own)
        out.append(Scale(own, numbers, prefix_index(own), 2 * longest if size else window, longest))
    return out


def windows_of(words: list[bytes], window: int, longest: int) -> Iterator[list[bytes]]:
    if len(words) <= window:
        yield words
        return
    step = max(1, window - longest)
    for at in range(0, max(1, len(words) - longest + step), step):
        if at < len(words):
            yield words[at : at + window]


def blocks_of(data: bytes, window: int, longest: int) -> Iterator[list[bytes]]:
    lines = [words for words in map(words_of, data.split(b"\n")) if words]
    for words in lines:
        yield from windows_of(words, window, longest)
    if len(lines) > 1:
        yield from windows_of([w for words in lines for w in words], window, longest)


def matches(block: Sequence[bytes], templates: Sequence[Template], index: dict[bytes, list[tuple[int, int]]]) -> Iterator[tuple[int, float]]:
    """(template, containment) of every template that the block meets."""
    held = set(block)
    first: dict[int, int] = {}
    for word in held & index.keys():
        for k, place in index[word]:
            first[k] = min(place, first.get(k, place))
    for k, place in first.items():
        t = templates[k]
        if len(held) < t.need or len(t.words) - place < t.need:
            continue
        shared = sum(w in held for w in t.words[place:])
        if shared >= t.need:
            yield k, shared / len(t.words)


def tells(held: set[bytes] | frozenset[bytes], words: Sequence[bytes]) -> bool:
    """Whether the words that a block holds of a template tell its license from others."""
    return TELLING.intersection(words) <= held


def all_labels(met: list[tuple[float, frozenset[bytes], int]], templates: Sequence) -> set[str]:
    """Labels of a block's matches (containment, matched words, template), less those that another match explains with more words, or the same ones more fully."""
    return {templates[k][0] for part, own, k in met if not any(own < other or own == other and part < whole for whole, other, _ in met)}


def _base(words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    n, first, last, labels = 0, None, None, set()
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                n += 1
                labels.add(label)
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
    return n, first, last, labels


def _count(vocabulary: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents of the corpus each word of a fixed vocabulary stands; as many rows as that has words."""
    counted = docs.select(F.col(text_col).alias("text")).transform(in_arrow, _count(vocabulary), "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _scan(classes: list[Scale]):
    phrase_words = {p.split()[-1].encode() for p in PHRASES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                held = set(words)
                n, first, last, base = _base(words) if held & phrase_words else (0, None, None, set())
                labels, score, found = set(base), 1.0 if base else 0.0, set()
                for c in classes:
                    if not any(matches(words, c.templates, c.index)):  # no block holds more than the text
                        continue
                    for block in blocks_of(text, c.window, c.longest):
                        met = [(containment, frozenset(block).intersection(c.templates[k].words), k) for k, containment in matches(block, c.templates, c.index)]
                        found.update(c.numbers[k] for _, _, k in met)
                        met = [m for m in met if tells(m[1], c.templates[m[2]].words)]
                        labels.update(all_labels(met, c.templates))
                        score = max([score, *(m[0] for m in met)])
                rows.append((doc_id, len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(found)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32()))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    return run


def from_table(table: DataFrame, label_col: str = "label", text_col: str = "text") -> list[tuple[str, str]]:
    """Templates of a table, in the order of label and text; rows without either are none."""
    rows = table.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(label_col, text_col)
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > TABLE:
        raise ValueError(f"{size} bytes of templates are more than {TABLE}; scan with a part of the table at a time")
    return sorted((r[0], r[1]) for r in rows.distinct().collect())


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates). ``templates``: numbers of all that a block
    meets; score: the largest containment of those that give a label, 1 with a base label."""
    if isinstance(templates, DataFrame):
        templates = from_table(templates)
    vocabulary = {w for _, text in templates for w in words_of(text.encode())}
    ordered = ordered_templates(templates, word_counts(docs, vocabulary, text_col), threshold)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).transform(in_arrow, _scan(scales(ordered, window)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<int>")


def brute_force(text: str | None, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[set[str], set[int]]:
    """Labels of a text and numbers of the templates that it meets, without index or filters, for tests."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    own = [set(words(t)) for _, t in templates]
    labels, numbers = {label for phrase, label in PHRASES.items() if f" {phrase} " in " " + b" ".join(words(text or "")).decode() + " "}, set()
    classes: dict[int, list[int]] = {}
    for k, held in enumerate(own):
        classes.setdefault(0 if 2 * len(held) <= 0.75 * window else (2 * len(held)).bit_length(), []).append(k)
    for size, members in classes.items():
        longest = 2 * max(len(own[k]) for k in members)
        wide = window if not size else 2 * longest
        step, blocks = max(1, wide - longest), []
        for part in [*(text or "").split("\n"), text or ""]:
            w = words(part)
            starts = [0] if len(w) <= wide else [i for i in range(len(w)) if i % step == 0 and i < len(w) - longest + step]
            blocks += [set(w[i : i + wide]) for i in starts]
        for block in blocks:
            met = [(len(own[k] & block) / len(own[k]), frozenset(own[k] & block), k) for k in members if own[k] and len(own[k] & block) / len(own[k]) >= threshold - 1e-9]
            numbers |= {k for _, _, k in met}
            labels |= all_labels([m for m in met if not own[m[2]] & TELLING - block], templates)
    return labels, numbers
