"""License names: every template against every other, near misses, alignment against brute force."""

import random
import time

import pytest

from assaylake.llm import licenses
from llm_texts import prose, words

PLAIN = {k: v.replace("{", "").replace("}", "") for k, v in licenses.TEMPLATES.items()}
ALL = [licenses.Template(k, v, licenses.MIN_COVERAGE) for k, v in licenses.TEMPLATES.items()]


def _names(text):
    return [f[0] for f in licenses.scan_text(text, ALL)]


@pytest.mark.parametrize("name", PLAIN)
def test_each_notice_goes_by_its_own_name_only(name):
    assert _names(f"{prose(30, 1)}\n{PLAIN[name]}\n{prose(30, 2)}") == [name]
    assert _names(PLAIN[name].upper().replace(" ", "\n * ")) == [name]


@pytest.mark.parametrize("text, want", [
    ("Released under the BSD License.", ["BSD-notice"]),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0-notice"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0-notice"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1-notice"]),
    ("Licensed under CC BY 2.5.", []),
    ("Licensed under the Apache License, Version 3.0.", []),
    ("Released under the Python License.", []),
    ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This work is licensed under the GNU Free Documentation License, version 3.", []),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version.", ["GPL-2.0-or-later"]),
    (PLAIN["BSD-3-Clause"].replace("the copyright holder", "Some Company Inc."), ["BSD-3-Clause"]),
    (PLAIN["GPL-3.0-or-later"].replace("version 3", "version 5"), []),
    ("All rights reserved. " + PLAIN["EPL-2.0"], ["All-rights-reserved", "EPL-2.0"]),
])
def test_near_misses(text, want):
    assert _names(f"{prose(20, 3)} {text} {prose(20, 4)}") == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def _patience_by_definition(a, b, i=0, k=0):
    """Equal ends first, then words unique in both on a longest increasing run, then the gaps."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    out = [(i + x, k + x) for x in range(head)]
    out += [(i + len(a) - 1 - x, k + len(b) - 1 - x) for x in range(tail)]
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    i, k = i + head, k + head
    pairs = [(x, b.index(w)) for x, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    keep = [pairs[x] for x in licenses.longest_increasing([y for _, y in pairs])]
    if keep:
        out += [(i + x, k + y) for x, y in keep]
        for (x0, y0), (x1, y1) in zip([(-1, -1), *keep], [*keep, (len(a), len(b))]):
            out += _patience_by_definition(a[x0 + 1:x1], b[y0 + 1:y1], i + x0 + 1, k + y0 + 1)
    return sorted(out)


def test_alignment_and_its_bound_against_brute_force():
    r = random.Random(7)
    for _ in range(400):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(0, 14))] for _ in (0, 1))
        got = licenses.patience(a, b)
        assert got == _patience_by_definition(a, b)
        assert all(a[i] == b[k] for i, k in got) and all(p < q and s < t for (p, s), (q, t) in zip(got, got[1:]))
        masks = {}
        for k, w in enumerate(b):
            masks[w] = masks.get(w, 0) | 1 << k
        longest = _lcs(a, b)
        assert licenses.common_length(a, masks, len(b)) == longest >= len(got)


def _places_one_by_one(t, text):
    """All findings with an alignment at every word of the template."""
    hits = [i for i, w in enumerate(text) if w in t.masks]
    out, x, reach = [], 0, licenses.REACH * len(t.words)
    while x < len(hits):
        found = licenses.patience(text[hits[x]:hits[x] + reach], t.words)
        if len(found) >= t.need and found[0][0] == 0 and t.required <= {k for _, k in found}:
            end = hits[x] + found[-1][0] + 1
            out.append((hits[x], end, len(found)))
            while x < len(hits) and hits[x] < end:
                x += 1
        else:
            x += 1
    return out


def test_windows_passed_over_hold_nothing():
    r = random.Random(9)
    t = licenses.Template("t", "one two {three} four five six two seven eight nine", 0.8)
    hits = 0
    for _ in range(300):
        text = []
        for _ in range(r.randrange(1, 5)):
            own = list(t.words)
            for _ in range(r.randrange(0, 4)):
                own.insert(r.randrange(len(own) + 1), r.choice(["x", "two", "six"]))
            if r.random() < 0.4:
                r.shuffle(own)
            text += own + words(r.randrange(0, 6), r.randrange(999))
        got = t.places(text)
        assert got == _places_one_by_one(t, text)
        hits += len(got)
    assert hits > 100


def test_many_template_words_in_no_order_are_passed_quickly():
    r = random.Random(1)
    own = licenses._WORD.findall(PLAIN["BSD-3-Clause"].lower())
    text = " ".join(r.choice(own) for _ in range(40_000))
    began = time.process_time()
    assert licenses.scan_text(text, ALL) == []
    assert time.process_time() - began < 8
