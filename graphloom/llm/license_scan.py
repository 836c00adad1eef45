"""License scans by an exact set-similarity join.

A block matches a template when the share of the template's distinct words that the
block has reaches ``threshold``.  Blocks of a text are its lines and, for notices that
are wrapped, all runs of as many consecutive words as the template has in all, over
line ends (the whole text if it is shorter).  Matching runs that overlap are reported
as one block; one that overlaps a line which holds as much is not reported again.

Words are ordered by how many lines of the whole corpus have them (rarest first), and
the join finds exactly the blocks at or above the threshold:

* length filter: a block with fewer than ``need`` distinct words cannot match, which is
  asked of a line's words before and after other than template words are left out;
* prefix filter: a match lacks at most ``n - need`` of a template's ``n`` words, so
  it has one of the first ``n - need + 1`` words in the global order;
* positional filter: when the first shared word stands at place ``i`` of the template
  and place ``j`` of the block's ``m`` words, both in the global order, at most
  ``1 + min(n - i - 1, m - j - 1)`` words are shared.

Only texts whose words as a whole pass the join are searched for runs.  Templates are
a small list given as a parameter, so every task holds them whole; their size is
checked.  Documents are never shuffled.  Beside the join the scan counts all places
where fixed phrases' words stand consecutively.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free_name

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by label (fixed values).
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("reserved", "All rights reserved."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
THRESHOLD = 0.8
#: Templates are held by every task; more characters than this are refused.
MAX_TEMPLATE_CHARS = 8 << 20

#: A-Z become a-z, other ASCII characters than letters and digits become blanks.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_WORDS).split()


@dataclass
class Index:
    """Templates as numbers of words in the global order, with their prefixes."""

    labels: list[str]
    sets: list[list[int]]  # distinct words, rarest first
    need: list[int]
    lengths: list[int]  # words, repeated ones included
    rank: dict[bytes, int]  # place of a word in the global order
    prefix: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    @property
    def least(self) -> int:
        """Fewer words than this match nothing."""
        return min(self.need, default=1)

    def block(self, words) -> list[int]:
        """The template words among ``words`` in the global order, each once."""
        return sorted(map(self.rank.__getitem__, self.rank.keys() & words))


def build_index(templates, frequency: dict[bytes, int], threshold: float) -> Index:
    """Order all template words by ``frequency`` and enter the prefixes."""
    cut = [(label, words) for label, text in templates if (words := words_of(text.encode()))]
    order = sorted({w for _, words in cut for w in words}, key=lambda w: (frequency.get(w, 0), w))
    index = Index([], [], [], [], {w: i for i, w in enumerate(order)})
    for label, words in cut:
        one = index.block(set(words))
        t, need = len(index.sets), max(1, math.ceil(threshold * len(one) - 1e-9))
        index.labels.append(label)
        index.sets.append(one)
        index.need.append(need)
        index.lengths.append(len(words))
        for i, w in enumerate(one[: len(one) - need + 1]):
            index.prefix[w].append((t, i))
    return index


def join_block(block: list[int], index: Index, passed: Counter | None = None) -> Iterator[tuple[int, float]]:
    """(template, containment) of all templates that ``block``, its template words in the global order, holds to the threshold.

    ``passed`` counts the templates that each filter lets through.
    """
    seen: set[int] = set()
    m = len(block)
    for j, w in enumerate(block):
        for t, i in index.prefix.get(w, ()):
            if t in seen:
                continue
            seen.add(t)
            words, need = index.sets[t], index.need[t]
            stages = (True, m >= need, 1 + min(len(words) - i - 1, m - j - 1) >= need)
            if passed is not None:
                passed.update(name for k, name in enumerate(("prefix", "length", "position")) if all(stages[: k + 1]))
            if not all(stages):
                continue
            shared = len(set(block[j:]).intersection(words))
            if shared >= need:
                yield t, shared / len(words)


def matching_runs(words: list[int], template: list[int], need: int, length: int) -> list[tuple[int, int, float]]:
    """(start, stop, containment) of the runs of ``length`` words that hold ``need`` of a template's distinct ones.

    ``words``: numbers in the global order, -1 for other words.  Runs that overlap are one, from the first
    shared word to the last, with the highest containment of any.
    """
    wanted, out = frozenset(template), []
    spots = [p for p, w in enumerate(words) if w in wanted]
    count: Counter = Counter()
    low = 0
    for p in spots:
        count[words[p]] += 1
        while spots[low] <= p - length:
            count[words[spots[low]]] -= 1
            if not count[words[spots[low]]]:
                del count[words[spots[low]]]
            low += 1
        if len(count) >= need:
            share = len(count) / len(template)
            if out and spots[low] < out[-1][1]:
                out[-1] = (out[-1][0], p + 1, max(out[-1][2], share))
            else:
                out.append((spots[low], p + 1, share))
    return out


def template_frequencies(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of the whole corpus each template word stands; summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                for line in t.as_py().split(b"\n"):
                    seen.update(words.intersection(line.translate(_WORDS).split(b" ")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    texts = docs.select(col(text_col).cast("binary").alias("t")).where("t is not null")
    return {bytes(r["w"]): r["n"] for r in texts.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of all places of the phrases; words are counted from 0."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        needle = b" " + b" ".join(words_of(phrase.encode())) + b" "
        at = joined.find(needle)
        before = start = 0
        while at >= 0:
            start += joined.count(b" ", before, at)
            out.append((start, label))
            before, at = at, joined.find(needle, at + 1)
    return out


BLOCK = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("containment", T.DoubleType())]
)
SCAN = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("blocks", T.ArrayType(BLOCK))]
)


class Scanner:
    """Scans texts with one index and one set of phrases."""

    def __init__(self, index: Index, phrases: dict[str, str]):
        self.index, self.phrases = index, phrases

    def blocks(self, text: bytes, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, containment) of all matching blocks, places counted in words."""
        ix, found = self.index, []
        if len(words) < ix.least:
            return found
        overall = ix.block(set(words))
        over = [t for t, _ in join_block(overall, ix)] if len(overall) >= ix.least else []
        if not over:  # no line holds more than the whole text
            return found
        at = 0
        for line in text.split(b"\n"):
            part = line.translate(_WORDS).split()
            if len(part) >= ix.least:
                found.extend((t, at, at + len(part), share) for t, share in join_block(ix.block(set(part)), ix))
            at += len(part)
        numbers = [ix.rank.get(w, -1) for w in words]
        for t in over:
            lines = [x for x in found if x[0] == t]
            for start, stop, share in matching_runs(numbers, ix.sets[t], ix.need[t], ix.lengths[t]):
                if not any(a < stop and start < b and share <= s for _, a, b, s in lines):
                    found.append((t, start, stop, share))
        return sorted(found)

    def scan(self, text: bytes) -> tuple:
        """The values of SCAN."""
        words = words_of(text)
        places = phrase_places(words, self.phrases)
        blocks = self.blocks(text, words)
        base = {label for _, label in places}
        labels = base | {self.index.labels[t] for t, *_ in blocks}
        best = 1.0 if base else max((share for *_, share in blocks), default=0.0)
        starts = [p for p, _ in places]
        listed = [{"label": self.index.labels[t], "template": t, "start": a, "stop": b, "containment": share} for t, a, b, share in blocks]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, listed


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Scan every whole text; adds the columns of ``SCAN``.

    ``blocks`` lists the matching blocks; ``score`` is their highest containment, 1
    where a phrase stands, else 0 for texts with no match; ``labels`` joins the phrases'
    and matched templates' labels.  A block that ties between templates is listed for
    each.  Null and empty texts have no words and no labels; columns of these names in
    the input are replaced, all others pass through; repeated rows each keep their row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if sum(len(t) for _, t in templates) > MAX_TEMPLATE_CHARS:
        raise ValueError("the templates are too large to be held by every task")
    vocabulary = frozenset(build_index(templates, {}, threshold).rank)
    index = build_index(templates, template_frequencies(docs, vocabulary, text_col), threshold)
    df = docs.select(*[col(c) for c in docs.columns if c not in SCAN.fieldNames()])
    shared, names = df.sparkSession.sparkContext.broadcast((index, phrases)), [*df.columns, *SCAN.fieldNames()]
    carried = docs.select(*[col(c) for c in df.columns], F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias(free_name(df, "__text")))
    types = [to_arrow_type(f.dataType) for f in SCAN.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            new = [pa.array([r[i] for r in rows], type=ty) for i, ty in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    return carried.mapInArrow(run, T.StructType([*df.schema.fields, *SCAN.fields]))
