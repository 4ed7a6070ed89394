"""Licence scans: passages of normalised text compared with licence templates by Dice over word bigrams.

Normalised text is its ASCII letters and digits in lower case, as words. A passage (a line of the
document, the whole document, or a run of words anywhere in it, across lines or within one) and a template
compare by 2 * common / (sum of both sizes) over their sets of word bigrams. Since common bigrams are at most the
smaller set, only templates whose size lies between t / (2 - t) and (2 - t) / t times the passage's can
reach the threshold t; of those, only templates that share a bigram are counted at all.

Runs are sought for templates of size m of which the text holds at least m * t / (2 - t) bigrams, as every
match must. A run has at most m * (2 - t) / t bigrams, repeats counted, as a match's distinct ones have. It matches if 2 * common - t * size
is at least t * m. Left to right, the first match to end gives way to runs that start no later than it ends and reach more, the first of
equals; what stands is taken, and the search goes on behind it, so a text takes time in proportion to its length. A run must hold a bigram of its template alone, if there is any, so that a phrase
that licences share names none of them. Where runs of several templates overlap, the one with the most common
bigrams stands. Runs that overlap a line (or text) that matches the same template are that match, not another.

Defined results: null and empty texts match nothing; of equal scores all templates are reported; a
row's best passage per template is its first line with the highest score (line 0 stands for the whole
text, a run is at its first line); a line that is the only one is not compared twice; rows that repeat an id are reported each; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.licence_texts import TEXTS

THRESHOLD = 0.7

_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}

#: Notices, full texts and short licences as their authors word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "all-rights-reserved": "Copyright (c) All rights reserved.",
    "all-rights-reserved-line": "All rights reserved.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-line": "Released under the BSD License.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "ISC-line": "Licensed under the ISC License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "MIT-work-line": "This work is licensed under the MIT License.",
    "Apache-2.0-short": "Released under the Apache 2.0 License.",
    "Apache-2.0-work-line": "This work is licensed under the Apache License, Version 2.0.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC0-1.0-line": "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    **{f"{name}-{number}-{kind}": frame.format(f"GNU {words}General Public License", number, name)
       for name, words, numbers in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
       for version in numbers for number in (version, version.removesuffix(".0"))[: 1 + version.endswith(".0")]
       for kind, frame in (("line", "Licensed under the {0}, version {1}."), ("work-line", "This work is licensed under the {0}, version {1}."),
                           ("released-line", "Released under the {0} v{1}."), ("short-line", "Licensed under {2}v{1}."), ("short-spaced", "Licensed under the GNU {2} v{1}."))},
    **{f"CC-{'-'.join(kinds)}-{version}-{kind}": frame.format("-".join(kinds), version, "-".join(_CC[k] for k in kinds))
       for kinds in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")) for version in ("3.0", "4.0")
       for kind, frame in (("short", "Licensed under CC {0} {1}."), ("work-short", "This work is licensed under CC {0} {1}."),
                           ("work-line", "This work is licensed under a Creative Commons {2} {1} " + ("International" if version == "4.0" else "Unported") + " License."))
       if (kinds, version, kind) != (("BY",), "4.0", "work-line")},
    **{f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in
       ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")},
    **TEXTS,
}

_words = re.compile(r"[A-Za-z0-9]+").findall


def bigrams(text: str) -> set[tuple[str, str]]:
    found = [w.lower() for w in _words(text)]
    return set(zip(found, found[1:], strict=False))


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _words(text)]


class Templates:
    """Templates by bigram, with their sizes."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.pairs = {k: bigrams(t) for k, t in texts.items()}
        self.sizes = {k: len(b) for k, b in self.pairs.items()}
        self.holders: dict[tuple[str, str], list[str]] = {}
        for k, pairs in self.pairs.items():
            for b in pairs:
                self.holders.setdefault(b, []).append(k)
        #: Bigrams that tell a template from all others.
        self.marks = {k: {b for b in pairs if len(self.holders[b]) == 1} for k, pairs in self.pairs.items()}
        sizes = [n for n in self.sizes.values() if n] or [0]
        self.share = threshold / (2 - threshold)
        self.least, self.most = min(sizes) * self.share, max(sizes) / self.share

    def compare(self, found: list[str]) -> list[tuple[str, float]]:
        if len(found) - 1 < self.least:
            return []
        pairs = list(zip(found, found[1:], strict=False))
        holders = self.holders
        hits = {b for b in pairs if b in holders}
        if not hits:
            return []
        n = len(set(pairs))
        # Common bigrams are at least t / (2 - t) of the passage's own.
        if n > self.most or len(hits) < n * self.share - 1e-9:
            return []
        common: Counter[str] = Counter(k for b in hits for k in holders[b])
        t = self.threshold
        out = []
        for k, c in common.items():
            m = self.sizes[k]
            if n * t <= m * (2 - t) and m * t <= n * (2 - t) and (dice := 2.0 * c / (n + m)) >= t:
                out.append((k, dice))
        return out

    def runs(self, found: list[str]) -> list[tuple[str, float, int, int]]:
        """(template, dice, first word, end) of the runs of words that match, one for words that several claim."""
        pairs = list(zip(found, found[1:], strict=False))
        holders = self.holders
        hits = [i for i, b in enumerate(pairs) if b in holders]
        if not hits:
            return []
        held = Counter(k for b in {pairs[i] for i in hits} for k in holders[b])
        all_runs = []
        for k, c in held.items():
            if c >= self.sizes[k] * self.share - 1e-9:
                own = self.pairs[k]
                all_runs += [(n_common, k, dice, a, b + 2) for n_common, dice, a, b in self._own_runs(k, pairs, [i for i in hits if pairs[i] in own])]
        out: list[tuple[int, int, str, float]] = []  # disjoint, in their order
        for _, k, dice, a, b in sorted(all_runs, key=lambda r: (-r[0], -r[2], r[3], r[1])):
            at = bisect_right(out, (a, len(found) + 1))
            if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
                out.insert(at, (a, b, k, dice))
        return [(k, dice, a, b) for a, b, k, dice in out]

    def _own_runs(self, k: str, pairs: list[tuple[str, str]], hits: list[int]) -> Iterator[tuple[int, float, int, int]]:
        """(common bigrams, dice, first, last bigram) of one template's runs, in those parts of a text whose gaps are shorter than a run."""
        own, m, most = self.pairs[k], self.sizes[k], self.longest(k)
        first = 0
        for i in range(1, len(hits) + 1):
            if i < len(hits) and hits[i] - hits[i - 1] < most:
                continue
            part = hits[first:i]
            first = i
            if len({pairs[h] for h in part}) >= m * self.share - 1e-9:
                yield from self._scan(k, own, pairs, part[0], part[-1] + 1)

    def longest(self, k: str) -> int:
        """Bigrams of a run of a template at most, repeats counted: as many as a passage that can match may have."""
        return int(self.sizes[k] / self.share + 1e-9)

    def _scan(self, k: str, own: set[tuple[str, str]], pairs: list[tuple[str, str]], begin: int, end: int) -> Iterator[tuple[int, float, int, int]]:
        """Steps through the bigrams once; after a run, from the one after it.

        A bigram changes the gains of those runs alone that start after its last occurrence, and each place is changed at most once for
        each distinct bigram of a run's length, so that repetitive texts take no longer than others.
        """
        m, t, most, marks = self.sizes[k], self.threshold, self.longest(k), self.marks[k]
        ceiling = (2 - t) * m - 1e-9
        # gains[l] is 2 * common - t * size of the bigrams from l to the current one.
        gains = np.zeros(end - begin)
        offset = begin
        while begin < end:
            last: dict[tuple[str, str], int] = {}
            top, best, gate, bound = t * m - 1e-9, None, end, 0.0
            gains[begin - offset :] = 0.0
            for r in range(begin, end):
                low = max(begin, r + 1 - most)
                # A run that starts beyond the first match is another.
                if low > gate or top >= ceiling:
                    break
                b = pairs[r]
                since = max(last.get(b, -1) + 1, low)
                last[b] = r
                if b not in own:
                    gains[since - offset : r + 1 - offset] -= t
                    continue
                gains[since - offset : r + 1 - offset] += 2 - t
                bound += 2 - t
                if bound <= top:
                    continue
                until = min(r, gate)
                if since > until:
                    continue
                # Runs that start earlier gain nothing by it, so those that start here tell whether there is a better one.
                l = since + int(gains[since - offset : until + 1 - offset].argmax())  # noqa: E741
                if gains[l - offset] > top + 1e-9 * bool(best):
                    top, best, gate = gains[l - offset], (l, r), min(gate, r)
            if not best:
                return
            l, r = best  # noqa: E741
            held = set(pairs[l : r + 1])
            n_common = len(held & own)
            if not marks or held & marks:
                yield n_common, 2.0 * n_common / (len(held) + m), l, r
            begin = r + 1


def matches(text: str, own: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, dice, line, n_passages) of a text, by licence."""
    lines = [tokens(part) for part in text.split("\n")]
    whole = [w for words in lines for w in words] if len(lines) > 1 else lines[0]
    starts = [0]
    for words in lines:
        starts.append(starts[-1] + len(words))
    best: dict[str, list] = {}
    spans: dict[str, list[tuple[int, int]]] = {}
    for number, part in [(0, whole)] * (len(lines) > 1) + list(enumerate(lines, 1)):
        for name, dice in own.compare(part):
            seen = best.setdefault(name, [dice, number, 0])
            seen[2] += 1
            spans.setdefault(name, []).append((starts[number - 1], starts[number]) if number else (0, len(whole)))
            if dice > seen[0]:
                seen[:2] = dice, number
    for name, dice, a, b in sorted(own.runs(whole), key=lambda r: r[2]):
        if any(a < y and b > x for x, y in spans.get(name, ())):
            continue
        number = bisect_right(starts, a)
        seen = best.setdefault(name, [dice, number, 0])
        seen[2] += 1
        if (-dice, number) < (-seen[0], seen[1]):
            seen[:2] = dice, number
    return [(name, dice, number, n) for name, (dice, number, n) in sorted(best.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, licence, dice, line (from 1; 0: the whole text), n_passages: a row for each licence found in a row's text."""
    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates, threshold)
        for batch in batches:
            at, names, scores, lines, counts = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for name, dice, number, n in matches(value.as_py() or "", own):
                    at.append(i), names.append(name), scores.append(dice), lines.append(number), counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lines, pa.int32()), pa.array(counts, pa.int64())], [id_col, "licence", "dice", "line", "n_passages"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, licence string, dice double, line int, n_passages long")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH t AS (SELECT name, {pairs("w")} AS b FROM (SELECT name, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM (VALUES {values}) AS v(name, body))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, text AS passage, 0 AS line FROM d WHERE contains(text, chr(10))
      UNION ALL SELECT rid, doc_id, unnest(string_split(text, chr(10))), unnest(range(1, len(string_split(text, chr(10))) + 1)) FROM d),
p AS (SELECT rid, doc_id, line, {pairs("w")} AS b FROM (SELECT *, list_transform(regexp_extract_all(passage, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM l)),
s AS (SELECT rid, doc_id, line, name, 2.0::DOUBLE * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS dice FROM p JOIN t
      ON len(p.b) <= len(t.b) * {2 - threshold} / {threshold} AND len(t.b) <= len(p.b) * {2 - threshold} / {threshold} AND list_has_any(p.b, t.b)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid, name ORDER BY dice DESC, line) AS k, count(*) OVER (PARTITION BY rid, name) AS n FROM s WHERE dice >= {threshold})
SELECT doc_id, name AS licence, dice, line::INT AS line, n AS n_passages FROM r WHERE k = 1"""
