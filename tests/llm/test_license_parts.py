"""The choice between licences at one place, and holders' lines, against brute force over all templates and parts."""

import random
from collections import Counter

import pytest

from quillspark.llm import license_scan


@pytest.mark.parametrize("text, found", [
    ("Copyright 2020 Foo Ltd. Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("Copyright (c) 2020 Foo. Released under the MIT License.", ["MIT"]), ("Copyright (c) 2020 Foo Inc\nReleased under the MIT License.", ["MIT"]),
    ("Copyright 2020 Foo, Licensed under the Apache License, Version 2.0", ["Apache-2.0"]), ("Copyright 2019 " + "a long name " * 40 + "\nReleased under the MIT License.", ["MIT"]), ("copyright is a word", []),
])
def test_only_the_holder_goes(text, found):
    assert [x[0] for x in license_scan.Scanner().scan(text)] == found


def test_wrapped_lines_that_begin_with_copyright_stay():
    bsd = max((t for n, t in license_scan.TEMPLATES if n == "BSD-3-Clause"), key=len)
    wrapped = bsd.replace(" copyright", "\ncopyright")
    assert ("BSD-3-Clause", 1.0) in [x[:2] for x in license_scan.Scanner().scan(wrapped)]


def test_a_name_takes_its_next_part_where_a_nearer_licence_is():
    scanner = license_scan.Scanner()
    near = "This work here is being licensed under the GNU General Public License, version 3."
    far = max((t for n, t in license_scan.TEMPLATES if n == "LGPL-3.0"), key=len)
    assert [x[0] for x in scanner.scan(near)] == ["GPL-3.0"]
    assert [x[0] for x in scanner.scan(far + " word" * 60 + " " + near)] == ["GPL-3.0", "LGPL-3.0"]


def scanned_by_force(words, templates, threshold):
    """The nearest part of any template that overlaps none taken before, again and again."""
    pairs, taken, out = license_scan.bigrams(words), [], []
    while True:
        best = None
        for name, text in templates:
            if name in (x[0] for x in out):
                continue
            template = Counter(license_scan.bigrams(license_scan.normal(text)))
            for a in range(len(pairs)):
                left, common = Counter(template), 0
                for n, b in enumerate(pairs[a:], 1):
                    if any(a <= y and x <= a + n for x, y in taken):
                        break
                    if left[b] > 0:
                        left[b] -= 1
                        common += 1
                    d = 2 * common / (n + template.total())
                    key = (-d, a, name, n)
                    if d >= threshold and (best is None or key < best):
                        best = key
        if best is None:
            return sorted(out)
        d, a, name, n = best
        taken.append((a, a + n))
        out.append((name, -d, a, n + 1))


@pytest.mark.parametrize("seed", range(6))
def test_scan_is_that_of_all_templates_and_parts(seed):
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(14)]
    phrase = lambda n: " ".join(dice.choice(words) for _ in range(n))
    first = phrase(9)
    templates = [("A", first), ("B", first + " " + phrase(3)), ("A", phrase(6)), ("C", phrase(7)), ("D", phrase(5))]
    scanner = license_scan.Scanner(templates)
    for _ in range(12):
        parts = [dice.choice(templates)[1].split() for _ in range(dice.randrange(1, 4))]
        for p in parts:
            if dice.random() < 0.4:
                p[dice.randrange(len(p))] = "zz"
        text = " ".join(w for p in parts for w in [*p, *(f"x{dice.randrange(9)}" for _ in range(dice.randrange(3)))])
        got, want = scanner.scan(text), scanned_by_force(text.split(), templates, license_scan.THRESHOLD)
        assert [(n, round(d, 9), a, k) for n, d, a, k in got] == [(n, round(d, 9), a, k) for n, d, a, k in want]
