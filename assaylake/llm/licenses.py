"""License scan by patience alignment with notice templates.

Texts and templates are word sequences (letters and digits, lower-cased). A
text is looked at only where enough of a template's words stand close
together. There the two are aligned by patience: words that occur once in
both are anchors, the longest increasing subsequence of their places is kept,
and the gaps between kept anchors are aligned the same way, after equal words
at their ends have been matched. Coverage is the share of the template's words
that are matched. Every place that reaches ``min_coverage`` and matches all of
the template's *required* words, those that tell it from its like (name,
version, letter code), is found; where findings overlap, the one that matches
more words stays, so a notice goes by its nearest template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from assaylake.llm.common import arrow_map, with_key

MIN_COVERAGE = 0.8
REACH = 2  # a notice may be spread over so many times its words
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

# Notices of public licenses, by SPDX identifier. Required words stand in braces. Where several
# licenses begin alike, the template goes on to where they part; what only the opening says has a name of its own.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT-notice": "Released under the {MIT} License.",
    "BSD-notice": "Released under the {BSD} License.",
    "Apache-2.0": "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file "
                  "except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Licensed under the {Apache} License, Version {2.0}.",
    "Apache-1.1-notice": "Licensed under the {Apache} License, Version {1.1}.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the "
                    "GNU {General} {Public} License {version} {2} as published by the Free Software Foundation.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of "
                        "the GNU {General} {Public} License as published by the Free Software Foundation; {either} "
                        "version {2} of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms "
                        "of the GNU {General} {Public} License as published by the Free Software Foundation, {either} "
                        "version {3} of the License, or (at your option) any later version.",
    "LGPL-2.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of "
                         "the GNU {Library} General Public License as published by the Free Software Foundation; "
                         "{either} version {2} of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of "
                         "the GNU {Lesser} General Public License as published by the Free Software Foundation; "
                         "{either} version {2.1} of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU {Lesser} General Public License as published by the Free Software Foundation, "
                         "{either} version {3} of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU {Affero} General Public License as published by the Free Software Foundation, "
                         "{either} version {3} of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU {General} {Public} License, version {2}.",
    "GPL-3.0-notice": "This work is licensed under the GNU {General} {Public} License, version {3}.",
    "LGPL-2.1-notice": "This work is licensed under the GNU {Lesser} General {Public} License, version {2.1}.",
    "LGPL-3.0-notice": "This work is licensed under the GNU {Lesser} General {Public} License, version {3}.",
    "AGPL-3.0-notice": "This work is licensed under the GNU {Affero} General {Public} License, version {3}.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are "
                   "permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must {retain} the "
                    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
                    "binary form must {reproduce} the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must {retain} the "
                    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
                    "binary form must {reproduce} the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution. "
                    "{Neither} the name of the copyright holder nor the names of its contributors may be used to "
                    "{endorse} or promote products derived from this software without specific prior written "
                    "permission.",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must {retain} the "
                    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
                    "binary form must {reproduce} the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution. "
                    "All {advertising} materials mentioning features or use of this software must display the "
                    "following {acknowledgement}: This product includes software developed by the organization. "
                    "{Neither} the name of the copyright holder nor the names of its contributors may be used to "
                    "{endorse} or promote products derived from this software without specific prior written "
                    "permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
           "copies.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
            "this software for any purpose, including commercial applications, and to {alter} it and redistribute it "
            "freely, subject to the following restrictions",
    "MPL-1.1": "The contents of this file are subject to the {Mozilla} Public License Version {1.1} (the \"License\"); "
               "you may not use this file except in compliance with the License. You may obtain a copy of the License "
               "at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of "
               "the MPL was not distributed with this file, You can obtain one at",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the {Eclipse} Public "
               "License {v1.0} which accompanies this distribution, and is available at",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the {Eclipse} Public "
               "License {2.0} which is available at",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or {organization} obtaining a copy of the "
               "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
               "display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
               "Software",
    "BSL-1.0-notice": "Distributed under the {Boost} Software License, Version {1.0}.",
    "Unlicense": "This is free and {unencumbered} software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and {neighboring} "
               "rights to this software to the {public} domain worldwide.",
    "All-rights-reserved": "All rights reserved.",
}
# Letter codes and names of the Creative Commons licenses; notices follow by rule for each version.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
      "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
      "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _long in CC.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_code}-{_version}-notice"] = f"Licensed under {{CC}} {{{_code}}} {{{_version}}}."
        TEMPLATES[f"CC-{_code}-{_version}"] = (f"This work is licensed under a {{Creative}} Commons {{{_long}}} "
                                               f"{{{_version}}} {_scope} License.")


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience piles)."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places ``(in a, in b)`` of the patience alignment, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i == j or k == n:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:n])
        at = {w: x for x, w in enumerate(b[k:n], k) if cb[w] == 1}
        anchors = [(x, at[w]) for x, w in enumerate(a[i:j], i) if ca[w] == 1 and w in at]
        anchors = [anchors[x] for x in longest_increasing([y for _, y in anchors])]
        if not anchors:
            continue
        out += anchors
        for (i0, k0), (i1, k1) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, n)]):
            todo.append((i0 + 1, i1, k0 + 1, k1))
    return sorted(out)


def common_length(words: list[str], masks: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of ``words`` and a template of ``size`` words, whose places
    are the bits of ``masks``: no alignment matches more."""
    all_ones = rest = (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            hit = rest & m
            rest = ((rest + hit) | (rest - hit)) & all_ones
    return size - rest.bit_count()


_REQUIRED = re.compile(r"\{([^{}]*)\}")


class Template:
    """A notice: its words, and places of the required ones (in braces in ``text``)."""

    def __init__(self, name: str, text: str, min_coverage: float):
        self.name, self.words, self.required = name, [], set()
        for k, part in enumerate(_REQUIRED.split(text.lower())):
            own = _WORD.findall(part)
            if k % 2:
                self.required |= {len(self.words) + x for x in range(len(own))}
            self.words += own
        self.need = max(1, -(-int(min_coverage * 1000) * len(self.words) // 1000))
        self.masks: dict[str, int] = {}
        for k, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        # Words of the template that a text may lack; the long ones are looked for first.
        count = Counter(self.words)
        self.must = sorted({self.words[k] for k in self.required}, key=lambda w: (-len(w), w))
        self.rare_first = sorted(((w, c) for w, c in count.items()), key=lambda x: (-len(x[0]), x[0]))
        self.spare = len(self.words) - self.need

    def possible(self, lowered: str) -> bool:
        """False only if the text lacks a required word, or too many words to reach the coverage."""
        if not all(w in lowered for w in self.must):
            return False
        spare = self.spare
        for w, c in self.rare_first:
            if w not in lowered:
                spare -= c
                if spare < 0:
                    return False
        return True

    def places(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(first word, end word, matched words)`` of all findings in a text, from left to right.

        A window whose longest common subsequence with the template is too
        short by d cannot be followed by a long enough one before d more of
        the template's words have come in: all windows up to there are passed
        over.
        """
        hits = [i for i, w in enumerate(words) if w in self.masks]
        reach, out, x = REACH * len(self.words), [], 0
        while x + self.need <= len(hits):
            last = bisect_left(hits, hits[x] + reach)  # hits in the window
            if last - x < self.need:
                x += 1
                continue
            at = hits[x]
            window = words[at:at + reach]
            lacking = self.need - common_length(window, self.masks, len(self.words))
            if lacking > 0:
                if last + lacking > len(hits):
                    break
                x = max(x + 1, bisect_left(hits, hits[last + lacking - 1] - reach + 1))
                continue
            found = patience(window, self.words)
            if (len(found) >= self.need and found[0][0] == 0
                    and self.required <= {k for _, k in found}):
                end = at + found[-1][0] + 1
                out.append((at, end, len(found)))
                while x < len(hits) and hits[x] < end:
                    x += 1
            else:
                x += 1
        return out


def scan_text(text: str, templates: list[Template]) -> list[tuple[str, int, int, int, float]]:
    """``(license, first character, end character, matched words, coverage)`` of a text, in text order."""
    lowered = text.lower()
    likely = [t for t in templates if t.possible(lowered)]
    if not likely:
        return []
    spans = [m.span() for m in _WORD.finditer(lowered)]
    words = [lowered[a:z] for a, z in spans]
    found = [(n, n / len(t.words), t.name, a, z) for t in likely for a, z, n in t.places(words)]
    # More words first, then the higher coverage; findings that overlap a better one go.
    kept: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for n, cover, name, a, z in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2])):
        x = bisect_left(taken, (a, z))
        if (x == len(taken) or taken[x][0] >= z) and (x == 0 or taken[x - 1][1] <= a):
            taken.insert(x, (a, z))
            kept.append((name, spans[a][0], spans[z - 1][1], n, cover))
    return sorted(kept, key=lambda f: f[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each license notice found in ``docs(doc_id, text)``.

    ``doc_id, license, start, end`` (characters), ``n_matched, coverage``.
    Null and empty texts hold none; templates without words are left out;
    repeated rows give repeated findings; a null doc_id stays null; other
    columns are ignored whatever their names. Long texts are read whole, one
    at a time. ``templates`` maps names to notices, required words in braces.
    """
    given = dict(templates if templates is not None else TEMPLATES)

    def run(batches):
        all_templates = [t for t in (Template(k, v, min_coverage) for k, v in given.items()) if t.words]
        for b in batches:
            rows = [(k, *f) for k, t in enumerate(b.column("text")) for f in
                    scan_text(t.as_py().decode(), all_templates)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                 pa.array(cols[5], pa.float64())],
                names=["doc_id", "license", "start", "end", "n_matched", "coverage"])

    return arrow_map(with_key(docs), run,
                     "doc_id long, license string, start long, end long, n_matched long, coverage double")


def op6_license_scan(spark, sf_dir):
    """License notices in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
