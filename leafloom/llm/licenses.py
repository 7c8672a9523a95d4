"""License scans by conditional compression.

Candidate blocks are runs of lines with licence wording and as many words around as a notice can have; for whole licence texts (`TEXTS`) the block is the document. A template is confirmed
at a stretch of the block's words that holds at least `share` of its words in order, few others between, and the same words that tell licences
apart (numbers and the like). Each block is compressed alone and with every template as a raw zstandard dictionary, and templates are ranked by how much smaller
it gets. The best one that is confirmed goes first, unless a stretch that overlaps has fewer differences; the stretch is reported and masked, and
the rest is compared again until nothing is confirmed. The rank orders the work and drops no template: all are compared at all places
where that is possible. Each hit's lines are compressed once more by themselves; templates that differ equally are told apart by how much smaller these get.

Null and empty texts have no blocks. Rows are scanned one by one, whatever their ids.
"""

from __future__ import annotations

import collections
import difflib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, ready

#: Wordings of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "proprietary": "All rights reserved.",
}
#: How a second licence is named in a notice.
FURTHER = [
    ("MIT", "or the MIT License"),
    ("Apache-2.0", "or the Apache License, Version 2.0"),
    ("GPL-3.0", "or the GNU General Public License, version 3"),
    ("GPL-2.0", "or the GNU General Public License, version 2"),
    ("LGPL-3.0", "or the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "or the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "or the BSD 3-Clause License"),
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licence texts, without title and copyright line.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
]
SHINGLE = 4  # a confirmed whole text has so many words in a row, for it lacks less than a quarter of them
#: What makes a line a candidate.
WORDING = r"(?i)licen[cs]e|copyright|©|all rights reserved|creative commons|\bcc[ -]by|\bcc0|redistribut|public domain"
#: Words that must agree whatever the share is.
TELLING = re.compile(r"\d|^(apache|mit|gnu|lesser|affero|mozilla|bsd|cc|by|nc|sa|nd|cc0|reserved)$")


MASK = ""  # no word


def words_of(text: str) -> list[str]:
    return re.findall(r"[\w]+(?:\.\d+)*", text.lower())


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], texts: list[tuple[str, str]], share: float):
        import zstandard

        self.short, self.long = ([(name, words_of(t), t) for name, t in some] for some in (templates, texts))
        self.share = share
        self.reach = max(len(words) + self.spare(words) for _, words, _ in self.short)
        raw = lambda t: zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = {"level": 19, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**options).compress
        self.given = {t: zstandard.ZstdCompressor(dict_data=raw(t), **options).compress for _, t in [*templates, *texts]}
        self.places = [collections.defaultdict(list) for _ in self.long]
        for (_, words, _), places in zip(self.long, self.places, strict=True):
            for i in range(len(words) - SHINGLE + 1):
                places[tuple(words[i : i + SHINGLE])].append(i)

    def spare(self, template: list[str]) -> int:
        """So many other words a confirmed stretch may have."""
        return int((1 - self.share) * len(template) + 1)

    def saved(self, lines: str, text: str) -> float:
        data = lines.lower().encode()
        size = len(self.alone(data))
        return (size - len(self.given[text](data))) / size

    def ranked(self, own: list[str], whole: bool) -> list[int]:
        """The templates by how much smaller the block gets with each as dictionary, the best first."""
        text = " ".join(own) or " "
        gain = [self.saved(text, t) for _, _, t in (self.long if whole else self.short)]
        return sorted(range(len(gain)), key=lambda k: (-gain[k], k))

    def compared(self, own: list, template: list[str], lo: int, hi: int) -> tuple[int, int, int, int] | None:
        """Missing and added words, first word and end of the stretch, if the template is confirmed within own[lo:hi]."""
        own, total = own[lo:hi], len(template)
        known = collections.Counter(template)
        if sum((known & collections.Counter(own)).values()) < self.share * total:
            return None
        parts = [m for m in difflib.SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks() if m.size]
        same = sum(m.size for m in parts)
        if not parts or same < self.share * total:
            return None
        first, end = parts[0].a, parts[-1].a + parts[-1].size
        inside = own[first:end]
        tell = lambda words: sorted(w for w in words if TELLING.search(w))
        if len(inside) - same > (1 - self.share) * total + 1 or MASK in inside or tell(inside) != tell(template):
            return None
        return total - same, len(inside) - same, lo + first, lo + end

    def windows(self, own: list, template: list[str], places: dict | None):
        """Where the template may stand: at every word and length, or for whole texts where some words in a row agree."""
        spare = self.spare(template)
        if places is None:
            for lo in (i for i, w in enumerate(own) if w in template):
                for size in range(math.ceil(self.share * len(template)), len(template) + spare + 1):
                    if lo + size <= len(own):
                        yield lo, lo + size
        else:
            starts = {i - k for i in range(len(own) - SHINGLE + 1) for k in places.get(tuple(own[i : i + SHINGLE]), ())}
            for lo in starts:
                yield max(0, lo - spare), lo + len(template) + spare

    def scan(self, words: list[tuple[str, int]], lines: list[str], whole: bool = False) -> list[tuple]:
        """First and last line, name, share saved, missing and added words of every confirmed template of the words (each with its line)."""
        own, out = [w for w, _ in words], []
        templates, order = self.long if whole else self.short, self.ranked(own, whole)
        while True:
            found, stock = [], collections.Counter(own)
            for k in order:
                name, template, text = templates[k]
                # No window has more words of the template than the block.
                if sum((collections.Counter(template) & stock).values()) < self.share * len(template) or any(w not in stock for w in template if TELLING.search(w)):
                    continue
                for lo, hi in self.windows(own, template, self.places[k] if whole else None):
                    hit = self.compared(own, template, lo, hi)
                    if hit:
                        # Of equally different ones the longer: a whole notice goes before a part of it.
                        found.append((hit[0] + hit[1], -len(template), hit[2], name, text, hit))
            if not found:
                return sorted(out)
            # The best of the first template in rank, then the least of what overlaps it, until that is the least among its own.
            least, near = None, min((f for f in found if f[4] == found[0][4]), key=lambda f: f[:3])
            while least != near[:3]:
                least = near[:3]
                near = min((f for f in found if f[5][2] < near[5][3] and near[5][2] < f[5][3]), key=lambda f: f[:3])
            ranked = []
            for f in {f[3:] for f in found if f[:3] == least}:
                name, text, (missing, added, first, end) = f
                a, b = words[first][1], words[end - 1][1]
                ranked.append((-self.saved("\n".join(lines[a : b + 1]), text), name, a, b, missing, added, first, end))
            saved, name, a, b, missing, added, first, end = min(ranked)
            out.append((a, b, name, -saved, missing, added))
            own[first:end] = [MASK] * (end - first)


def hits_of(text: str, wording: re.Pattern, scanner: Scanner) -> list[tuple]:
    """The hits of a document: of each run of candidate lines, and of whole licence texts."""
    lines, out, run, last = text.split("\n"), [], [], None
    words = [(w, k) for k, line in enumerate(lines) for w in words_of(line)]
    likely = [bool(wording.search(line)) for line in lines]
    # Runs bridge other lines, and reach as far beyond theirs as a notice can: wrapped notices have lines without wording.
    for i in (i for i, (_, k) in enumerate(words) if likely[k]):
        lo = max(0, i - scanner.reach)
        if last is not None and lo > last + scanner.reach:
            run.append(min(len(words), last + scanner.reach + 1))
            last = None
        if last is None:
            run.append(lo)
        last = i
    if last is not None:
        run.append(min(len(words), last + scanner.reach + 1))
    for lo, hi in zip(run[::2], run[1::2], strict=True):
        out += scanner.scan(words[lo:hi], lines)
    if scanner.long:
        out += scanner.scan(words, lines, whole=True)
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.85) -> DataFrame:
    """doc_id, first_line, last_line (from 0), license, saved (share of the compressed lines), missing and added words, exact: a row for every
    confirmed template, in documents that have any. Own templates replace those of this module."""
    ready(docs.sparkSession)
    short, texts = (list(templates.items()), []) if templates else ([*TEMPLATES.items(), *FURTHER], TEXTS)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(WORDING))
    cache: dict = {}

    def step(batch):
        if "scanner" not in cache:
            cache["scanner"], cache["wording"] = Scanner(short, texts, share), re.compile(WORDING)
        out: dict = {k: [] for k in ("doc_id", "first_line", "last_line", "license", "saved", "missing", "added", "exact")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for first, last, name, saved, missing, added in hits_of(text, cache["wording"], cache["scanner"]):
                for k, v in zip(out, (doc, first, last, name, saved, missing, added, missing + added == 0), strict=True):
                    out[k].append(v)
        return out

    return in_batches(rows, "doc_id long, first_line int, last_line int, license string, saved double, missing int, added int, exact boolean", step)
