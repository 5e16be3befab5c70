"""License scans: anchor words find candidate blocks, conditional compression ranks the templates, exact wording differences confirm."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .words import Texts, find_words, hash_words, slices

_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
          "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
          "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
          "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
          "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
          "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_TWO_CLAUSES = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_THIRD_CLAUSE = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                 "from this software without specific prior written permission.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.")


def _gnu(kind: str, what: str, version: str, mark: str) -> str:
    return (f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


#: The published wording of common notices, by SPDX name. What follows a slash tells two wordings of a licence apart.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                  "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                  'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
                  "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT": _MIT + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
           "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
           "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
           "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT/grant": _MIT,
    "MIT/line": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": f"{_TWO_CLAUSES} {_AS_IS}",
    "BSD-3-Clause": f"{_TWO_CLAUSES} {_THIRD_CLAUSE} {_AS_IS}",
    "BSD-2-Clause/line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/line": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": _gnu("", "program", "3", ":"),
    "GPL-2.0": _gnu("", "program", "2", ";"),
    "LGPL-3.0": _gnu("Lesser ", "library", "3", ":"),
    "LGPL-2.1": _gnu("Lesser ", "library", "2.1", ";"),
    "LGPL-2.0": _gnu("Library ", "library", "2", ";"),
    "AGPL-3.0": _gnu("Affero ", "program", "3", ":"),
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1/line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
               "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0/line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                 "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                 "by any means.",
    "Proprietary": "All rights reserved.",
}
#: Words that tell one licence of a family from another: none of them may be missing or added. Nor may a template's numbers be missing.
DECIDING = {"GPL": {"lesser", "library", "affero"}, "LGPL": {"lesser", "affero"}, "AGPL": {"lesser", "affero"}, "BSD": {"neither", "endorse"},
            "CC": {"by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd", "attribution", "attribution-sharealike", "attribution-noncommercial",
                   "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives"}}
#: The share of a template's words that must stand in order.
MIN_SHARE = 0.85
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123)]] = True


def anchors(words: list[str], min_share: float = MIN_SHARE) -> list[str]:
    """Words of a template of which any place holds one that has ``min_share`` of the template's words: so many, the longest
    (these are the rarest in other texts), that a place without them would lack too much."""
    counts, out, held = Counter(words), [], 0
    for word in sorted((w for w in counts if w.isalpha()), key=lambda w: (-len(w), w)):
        if len(words) - held < min_share * len(words):
            break
        out.append(word)
        held += counts[word]
    if len(words) - held >= min_share * len(words):
        raise ValueError("a template needs more words of letters")
    return out


class Scanner:
    """The templates, their words and anchors, and a compressor for each that has it as a raw dictionary."""

    def __init__(self, templates: dict[str, str]):
        self.words = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.deciding = {name: DECIDING.get(name.split("-")[0], set()) for name in templates}
        self.numbers = {name: {w for w in words if re.fullmatch(r"[0-9]+(\.[0-9]+)*", w)} for name, words in self.words.items()}
        self.anchors: dict[str, set[str]] = {}
        for name, words in self.words.items():
            for word in anchors(words):
                self.anchors.setdefault(word, set()).add(name)
        # a notice may have as many other words as its template has words
        self.reach = {word: 2 * max(len(self.words[name]) for name in names) for word, names in self.anchors.items()}
        line = " ".join(self.anchors).encode()
        texts = Texts(np.frombuffer(line, "u1"), np.array([0, len(line)]))
        self.hashes = np.sort(hash_words(texts, find_words(texts, _IN_WORD)))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.given = {name: zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(
            text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in templates.items()}
        self.seen: dict[tuple[str, str], float] = {}

    def anchored(self, texts: Texts) -> np.ndarray:
        """For each lower-cased text of a slice whether it has an anchor word: without one it can hold no notice."""
        words = find_words(texts, _IN_WORD)
        hashes = hash_words(texts, words)
        hit = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
        return np.bincount(words.text[hit], minlength=len(texts)) > 0

    def blocks(self, words: list[str]) -> list[tuple[int, int, set[str]]]:
        """The words (from, to) about the anchors, and the templates that these speak for: on both sides as many words as a
        notice can have, so that it is whole however its lines are wrapped. Where these meet they are one."""
        out: list[tuple[int, int, set[str]]] = []
        for k, word in enumerate(words):
            names = self.anchors.get(word)
            if names:
                a, b = max(0, k - self.reach[word]), min(len(words), k + self.reach[word])
                before: set[str] = set()
                while out and a <= out[-1][1]:
                    first, last, more = out.pop()
                    a, b, before = min(a, first), max(b, last), before | more
                out.append((a, b, before | names))
        return out

    def reduction(self, name: str, raw: str) -> float:
        """The share of a text's compressed size that knowing the template saves."""
        found = self.seen.get((name, raw))
        if found is None:
            if len(self.seen) > 10_000:
                self.seen.clear()
            alone = len(self.plain.compress(raw.encode()))
            found = self.seen[name, raw] = 1 - len(self.given[name].compress(raw.encode())) / alone
        return found

    def ranked(self, names: Iterable[str], block: str) -> list[str]:
        """The templates that shorten a compressed block, the one that shortens it most first."""
        by = sorted((-self.reduction(name, block), name) for name in names)
        return [name for saved, name in by if saved < 0]

    def aligned(self, name: str, words: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """The places in words[lo:hi] that hold MIN_SHARE of the template's words in order, and no more other words than it has.

        The longest matching run tells the place, and only words about it are aligned. Matches at either end
        that bring more other words than they are worth don't belong to it. Then the words before and after are searched.
        """
        wanted = self.words[name]
        n, found, todo = len(wanted), [], [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if not self.possible(name, Counter(words[lo:hi])):
                continue
            run = SequenceMatcher(None, wanted, words[lo:hi], autojunk=False).find_longest_match()
            first, last = max(lo, lo + run.b - run.a - n), min(hi, lo + run.b - run.a + 2 * n)
            same = [m for m in SequenceMatcher(None, wanted, words[first:last], autojunk=False).get_matching_blocks() if m.size]
            best, begin, score = (0, 0, 0), 0, 0  # the stretch of matches that is worth most: two for a word, less one for each other word
            for k, m in enumerate(same):
                between = m.b - same[k - 1].b - same[k - 1].size if k else 0
                if score <= between:
                    begin, score = k, 0
                else:
                    score -= between
                score += 2 * m.size
                best = max(best, (score, begin - k, k))
            for begin, end in ((best[1] + best[2], best[2]), (0, len(same) - 1)):  # if that stretch lacks words, all of them
                a, b = first + same[begin].b, first + same[end].b + same[end].size
                matched = sum(m.size for m in same[begin:end + 1])
                if matched >= MIN_SHARE * n:
                    break
            if matched >= MIN_SHARE * n and b - a - matched <= n:
                found.append((a, b))
            else:
                a, b = lo + run.b, lo + run.b + run.size
            todo += [(lo, a), (b, hi)]
        return found

    def possible(self, name: str, there: Counter) -> bool:
        """Whether words, in any order, have MIN_SHARE of the template's."""
        return sum(min(k, there[w]) for w, k in self.counts[name].items()) >= MIN_SHARE * len(self.words[name])

    def places(self, name: str, words: list[str], lo: int, hi: int) -> set[tuple[int, int]]:
        """As :func:`aligned`, for any number of words: in overlapping pieces, of which one holds any whole place."""
        step = 2 * len(self.words[name])  # the most words of a place
        return {x for at in range(lo, max(lo + 1, hi - step), step) for x in self.aligned(name, words, at, min(hi, at + 2 * step))}

    def confirmed(self, name: str, words: list[str]) -> dict | None:
        """A place's exact wording differences from a template; None if these say that it isn't the template's notice."""
        wanted = self.words[name]
        diff = SequenceMatcher(None, wanted, words, autojunk=False).get_opcodes()
        missing = [w for op, i, j, *_ in diff if op in ("delete", "replace") for w in wanted[i:j]]
        added = [w for op, _, _, i, j in diff if op in ("insert", "replace") for w in words[i:j]]
        share = 1 - len(missing) / len(wanted)
        if share < MIN_SHARE or len(added) > len(wanted) or self.numbers[name] & {*missing} or self.deciding[name] & {*missing, *added}:
            return None
        return {"license": name.split("/")[0], "share": share, "missing": missing, "added": added}

    def notices(self, low: str, starts: list[int], ends: list[int], words: list[str], lo: int, hi: int, names: set[str]) -> list[dict]:
        """The notices in words[lo:hi], in order of place, each with its exact wording differences.

        The places that hold enough of some template's words make the candidate blocks; where places meet they are one block. For each
        block the templates are ranked by how much knowing them shortens it, and the ranking chooses: the first is confirmed or refused,
        place by place, by the exact differences, then the next on what is left of the block; one that shortens nothing is none. What
        stands before and after is searched again until nothing is found.
        """
        there = Counter(words[lo:hi])
        proposed = sorted((a, b, name) for name in names if self.possible(name, there) for a, b in self.places(name, words, lo, hi))
        if not proposed:
            return []
        candidates: list[tuple[int, int, dict[str, list[tuple[int, int]]]]] = []
        for a, b, name in proposed:
            if candidates and a < candidates[-1][1]:
                first, last, by_name = candidates.pop()
                candidates.append((first, max(last, b), by_name))
            else:
                candidates.append((a, b, {}))
            candidates[-1][2].setdefault(name, []).append((a, b))
        chosen, taken = [], bytearray(hi - lo)
        for first, last, by_name in candidates:
            for name in self.ranked(by_name, low[starts[first]:ends[last - 1]]):
                for a, b in by_name[name]:
                    notice = self.confirmed(name, words[a:b]) if 1 not in taken[a - lo:b - lo] else None
                    if notice:
                        taken[a - lo:b - lo] = b"\1" * (b - a)
                        chosen.append(notice | {"reduction": self.reduction(name, low[starts[a]:ends[b - 1]]), "at": (a, b)})
        if not chosen:
            return []
        chosen.sort(key=lambda x: x["at"])
        out = []
        for before, x in zip([lo] + [x["at"][1] for x in chosen], chosen + [None]):
            end = x["at"][0] if x else hi
            out += self.notices(low, starts, ends, words, before, end, names) if end > before else []
            out += [x] if x else []
        return out

    def scan(self, text: str) -> list[dict]:
        """The notices of a text in order of place, with the line each begins on."""
        low, out = text.lower(), []
        found = [m.span() for m in _WORD.finditer(low)]
        starts, ends = [a for a, _ in found], [b for _, b in found]
        words = [low[a:b] for a, b in found]
        for lo, hi, names in self.blocks(words):
            out += [{k: x[k] for k in ("license", "reduction", "share", "missing", "added")} | {"first_line": low.count("\n", 0, starts[x["at"][0]])}
                    for x in self.notices(low, starts, ends, words, lo, hi, names)]
        return out


_FINDING = T.StructType([T.StructField("license", T.StringType()), T.StructField("first_line", T.LongType()), T.StructField("reduction", T.DoubleType()),
                         T.StructField("share", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType()))])
_FINDING_ARROW = pa.struct([("license", pa.string()), ("first_line", pa.int64()), ("reduction", pa.float64()), ("share", pa.float64()),
                            ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id and ``findings``, the confirmed notices in order of place.

    Each finding has the notice's name, the line it begins on, the size reduction of its place, the share of the template's words
    found in order, and the words missing and added. Every word of every text is looked at; a notice has MIN_SHARE of its
    template's words, none of its family's deciding words changed, and no more other words than its template has words. Equal
    notices are found each at its place. Null and empty texts have no finding; repeated rows stay repeated.
    """
    templates = templates or TEMPLATES
    schema = T.StructType([docs.schema[id_col], T.StructField("findings", T.ArrayType(_FINDING))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for first, texts in slices(batch.column(1), lower=True):
                rows = [scanner.scan(batch.column(1)[first + i].as_py()) if hit else [] for i, hit in enumerate(scanner.anchored(texts))]
                yield pa.record_batch([batch.column(0).slice(first, len(rows)), pa.array(rows, pa.list_(_FINDING_ARROW))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
