"""License scan by conditional compression.

Texts are taken as words, so line ends, comment marks and punctuation do not matter. A candidate block is where enough of
a template's telling words stand in the template's order of places: as many as any wording within the bounds must have.
It is as long as the template and what may have been put in. Blocks are compressed by zstandard alone and with each
template as a raw dictionary; what a template takes off a block's size ranks the templates, and the first in rank whose
exact differences of wording are within bounds wins. Words that tell licenses apart may neither be missing nor be added.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared
from weftline.llm._worker import slices

# Names, notices and texts of public licenses, by SPDX identifier.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
MIT_REST = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE_GRANT = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_REST = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
GPL_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."
GPL_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_REST = ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def gnu(name: str, version: str) -> tuple[str, ...]:
    """The ways to name a license of the family."""
    return (f"This work is licensed under the {name}, version {version}.", f"{name}, version {version}", f"version {version} of the {name}", f"{name} v{version}.0" if "." not in version else f"{name} v{version}")


TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License 2.0", "Apache License, Version 2.0", APACHE_GRANT, APACHE_GRANT + APACHE_REST),
    "MIT": ("Released under the MIT License.", "MIT License", MIT_GRANT, MIT_GRANT + MIT_REST),
    "GPL-3.0": (*gnu("GNU General Public License", "3"), GPL_GRANT.format(3), GPL_GRANT.format(3) + GPL_REST),
    "GPL-2.0": (*gnu("GNU General Public License", "2"), GPL_GRANT.format(2), GPL_GRANT.format(2) + GPL_REST),
    "LGPL-3.0": gnu("GNU Lesser General Public License", "3"),
    "LGPL-2.1": gnu("GNU Lesser General Public License", "2.1"),
    "AGPL-3.0": gnu("GNU Affero General Public License", "3"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "BSD 3-Clause License", BSD_HEAD + BSD_TWO + BSD_THIRD),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "BSD 2-Clause License", BSD_HEAD + BSD_TWO),
    "BSD": (BSD_HEAD,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Released under the ISC License.", "ISC License", ISC_GRANT, ISC_GRANT + ISC_REST),
    "proprietary": ("All rights reserved.",),
}
#: Hyphens part words, as lines may break at them.
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
#: Template words that say nothing about licenses.
PLAIN = frozenset("a above all and any as at be by can conditions copy distribute either extent file files following for form forms free from in including is it law may met modify not obtain of on or other out own person program provided purpose published related source subject that the this to under use used version with within work you your author charge compliance deal option terms later v".split())
#: Words that tell licenses apart, beside numbers and what holds one.
NAMING = frozenset("mit apache gnu lesser affero general mozilla bsd isc cc cc0 sa nc nd creative commons sharealike noncommercial noderivatives unencumbered reserved waived neither".split())
#: Spellings that are one word.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "https": "http"}
SCHEMA = "doc_id bigint, block int, start bigint, end bigint, license string, template int, reduction double, margin double, missing array<string>, added array<string>"
NAMES = [x.strip().split()[0] for x in SCHEMA.split(", ")]


def words(text: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in WORD.findall(text.lower())]


def tells(word: str) -> bool:
    """Whether a wording with and one without the word are different licenses. Web addresses and list numbers aren't versions."""
    return word in NAMING or word[:1].isdigit() and word not in ("1", "01") or word[:1] == "v" and word[1:2].isdigit()


@dataclass(frozen=True)
class Template:
    """``needed``: words that no wording may lack. ``places``: of each telling word. ``votes``: how many any wording within bounds has."""

    license: str
    number: int
    text: str
    words: tuple[str, ...]
    needed: frozenset[str]
    places: dict[str, tuple[int, ...]]
    wrong: int
    votes: int
    triggers: frozenset[str]


def as_templates(texts: dict[str, tuple[str, ...]], most_wrong: float = 0.2) -> list[Template]:
    """Of the triggers one must stand in any text that holds the template: a needed word, else so many telling ones that not all may be missing."""
    out = []
    for name, some in texts.items():
        for k, text in enumerate(some):
            ws = tuple(words(text))
            telling = {w: tuple(i for i, x in enumerate(ws) if x == w) for w in ws if w not in PLAIN and not w.replace(".", "").isdigit()}
            if not telling:
                raise ValueError(f"template {k} of {name} has no telling word")
            wrong = int(most_wrong * len(ws))
            needed = frozenset(w for w in ws if tells(w))
            rare = sorted(telling, key=lambda w: (len(telling[w]), -len(w), w))
            named = [w for w in rare if w in needed]
            least = next((i for i in range(1, len(rare) + 1) if sum(len(telling[w]) for w in rare[:i]) > wrong), len(rare))
            out.append(Template(name, k, text, ws, needed, telling, wrong, max(1, sum(map(len, telling.values())) - wrong), frozenset(named[:1] or rare[:least])))
    return out


def lowered(text: str) -> str:
    """Lower case, place for place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def differences(template: tuple[str, ...], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Template words that the block lacks, words it has among the matched ones beyond them, and the match's bounds."""
    found = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return list(template), [], 0, 0
    missing, added, at, where = [], [], 0, found[0].b
    for m in found:
        missing += template[at : m.a]
        added += block[where : m.b]
        at, where = m.a + m.size, m.b + m.size
    return missing + list(template[at:]), added, found[0].b, where


def wrong_words(template: tuple[str, ...], block: list[str]) -> int:
    """Words that differ: in each gap between matched runs the more of what is missing and what is added."""
    found = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return len(template)
    out = found[0].a + len(template) - found[-1].a - found[-1].size
    for one, two in zip(found, found[1:], strict=False):
        out += max(two.a - one.a - one.size, two.b - one.b - one.size)
    return out


class Scanner:
    """Templates compiled to dictionaries. A text without any trigger is done at once."""

    def __init__(self, templates: list[Template], least_reduction: float = 0.1, level: int = 3):
        self.templates, self.least = templates, least_reduction
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_template = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates]
        same = {}
        for new, old in SPELLINGS.items():
            same.setdefault(old, []).append(new)
        self.triggers = [(w, [k for k, t in enumerate(templates) if w in t.triggers]) for w in sorted(set().union(*(t.triggers for t in templates)))]
        self.triggers += [(x, ks) for w, ks in self.triggers for x in same.get(w, ())]
        self.telling: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        for k, t in enumerate(templates):
            for w, places in t.places.items():
                self.telling.setdefault(w, []).append((k, places))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Share of the block's compressed size that each template takes off, greatest first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(z.compress(data)) / alone, k) for k, z in enumerate(self.with_template)), key=lambda x: (-x[0], x[1]))

    def blocks(self, own: list[str], able: set[int]) -> set[tuple[int, int]]:
        """Bounds in words of all candidate blocks of the templates that are able to stand in the text."""
        starts: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            for k, places in self.telling.get(w, ()):
                if k in able:
                    starts.setdefault(k, []).extend([i - p for p in places])
        out = set()
        for k, found in starts.items():
            t = self.templates[k]
            found.sort()
            low, last = 0, None
            for high, at in enumerate(found):
                while at - found[low] > t.wrong:
                    low += 1
                if high - low + 1 >= t.votes:
                    # Places that overlap are one block, which therefore stays within two lengths.
                    if last is not None and found[low] <= last[1] and at - last[0] <= len(t.words):
                        last = (last[0], at)
                    else:
                        if last is not None:
                            out.add((max(0, last[0] - t.wrong), min(len(own), last[1] + len(t.words) + t.wrong)))
                        last = (found[low], at)
            if last is not None:
                out.add((max(0, last[0] - t.wrong), min(len(own), last[1] + len(t.words) + t.wrong)))
        return out

    def confirmed(self, block: str, own: list[str]) -> tuple | None:
        """The first template in rank whose wording differs in few enough words, none of them telling licenses apart."""
        ranked = self.ranked(block)
        for reduction, k in ranked:
            t = self.templates[k]
            if reduction < self.least:
                return None
            if t.needed <= set(own):
                missing, added, a, b = differences(t.words, own)
                if not t.needed & set(missing) and not any(w in NAMING for w in added) and wrong_words(t.words, own) <= t.wrong:
                    rest = max((r for r, i in ranked if self.templates[i].license != t.license), default=0.0)
                    return a, b, t.license, t.number, reduction, reduction - rest, missing, added
        return None

    def scan(self, text: str) -> list[tuple]:
        """block, start, end, license, template, reduction, margin, missing, added of each confirmed notice, by place."""
        low = lowered(text)
        able = {k for w, ks in self.triggers if w in low for k in ks}
        if not able:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        own = [SPELLINGS.get(w, w) for w in (low[a:b] for a, b in spans)]
        hits, todo, seen = [], list(self.blocks(own, able)), set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen or b - a < 2:
                continue
            seen.add((a, b))
            hit = self.confirmed(low[spans[a][0] : spans[b - 1][1]], own[a:b])
            if hit is not None:
                hits.append((a + hit[0], a + hit[1], *hit[2:]))
                todo += [(a, a + hit[0]), (a + hit[1], b)]
        # Of notices that overlap the longest stands.
        taken: list[tuple] = []
        for hit in sorted(hits, key=lambda h: (h[0] - h[1] + len(h[7]), h[0], h[3])):
            at = bisect_left(taken, (hit[0],), key=lambda t: t[:1])
            if (at == len(taken) or taken[at][0] >= hit[1]) and (not at or taken[at - 1][1] <= hit[0]):
                taken.insert(at, hit)
        return [(low.count("\n", 0, spans[first][0]), spans[first][0], spans[end - 1][1], *rest) for first, end, *rest in taken]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least_reduction: float = 0.1, most_wrong: float = 0.2) -> DataFrame:
    """One row per notice found (columns of ``SCHEMA``); texts without any have none.

    ``block`` is the number from 0 of the line on which the notice starts, ``start`` and ``end`` bound it in characters, ``reduction`` is the
    share of the block's compressed size that the template takes off and ``margin`` its lead over the best template of
    any other license. ``missing`` and ``added`` are the exact differences of wording; at most ``most_wrong`` of a
    template's words may differ. Ties in rank go to the template that is listed first, of notices that overlap the
    longest stands. Null texts have no notice; repeated rows give repeated rows; other columns are ignored.
    """
    compiled = as_templates(TEMPLATES if templates is None else templates, most_wrong)

    def run(batches):
        scanner = Scanner(compiled, least_reduction)
        texts = pa.list_(pa.string())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), texts, texts)
        for b in (part for whole in batches for part in slices(whole, 1)):
            rows = [(doc_id, *x) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in scanner.scan(text.as_py() or "")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op1_license_scan(spark, sf_dir):
    """A row per license notice of every document: where it stands, which it is and how its wording differs.

    Documents without one, null and empty texts give no row; repeated rows give repeated rows; null doc_ids stay null.
    """
    return scan_licenses(_shared.table(spark, sf_dir, "documents"))
