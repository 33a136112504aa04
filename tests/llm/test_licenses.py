import random
import re

from tidewire.llm import licenses

PHRASES = [p for p, _ in licenses.BASE]
PIECES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0 OR GPL-3.0-only", "https://www.gnu.org/licenses/lgpl-2.1.html", "http://www.apache.org/licenses/LICENSE-2.0", "All rights reserved",
    "Redistribution and use in source and binary forms, with or without\n modification, are permitted", "under the\nMIT\tlicense", "cc by nc", "the apache licence", "gplv2", "GPL v2 or later", "an ordinary sentence", "über den Straßen", "7 words",
    "Creative Commons Attribution-ShareAlike 3.0 Unported License", "mozilla public license 2.0", "MPL-2.0",
]

REGEXES = [(r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", re.ASCII)) for r in licenses.RULES]


def brute(text):
    """Words one by one, every rule tried, suppression against every detection taken."""
    words, now = [], ""
    for c in [*text, " "]:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            words += [now] if now else []
            now = ""
        else:
            now += c
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    line = " ".join(words)
    found = []
    for rule, regex in REGEXES:
        for m in regex.finditer(line):
            start = line[: m.start()].count(" ")
            found.append((rule.priority, -len(m[0].split(" ")), start, licenses.RULES.index(rule)))
    kept = []
    for p, size, start, i in sorted(found):
        if not any(a <= start and start - size <= b for a, b, _ in kept):
            kept.append((start, start - size, licenses.RULES[i].label))
    return len(words), base, sorted((label, a, b) for a, b, label in kept)


def test_against_brute_force():
    rng = random.Random(5)
    scanner = licenses.Scanner()
    for _ in range(80):
        text = rng.choice([" ", "\n", ", ", "; "]).join(rng.choices(PIECES, k=rng.randrange(8)))
        n, base, found = scanner.scan(text)
        want = brute(text)
        assert (n, [(i, label) for label, i in base]) == want[:2], text
        assert sorted((label, a, b) for label, _, a, b, _ in found) == want[2], text


def test_every_rule_is_reached_through_its_words():
    """A rule's own match always holds one of each group of its needed words: nothing is lost by the prefilter."""
    scanner = licenses.Scanner()
    told = {x: {f[0] for f in scanner.scan(x)[2]} for x in PIECES}
    assert told["SPDX-License-Identifier: Apache-2.0 OR GPL-3.0-only"] == {"apache-2", "gpl-3"}
    assert told["https://www.gnu.org/licenses/lgpl-2.1.html"] == {"lgpl-2.1"}
    assert told["GPL v2 or later"] == told["gplv2"] == {"gpl-2"}
    assert told["Licensed under CC BY-NC 4.0."] == {"cc-by-nc-4.0"}
    assert told["This work is licensed under the GNU General Public License, version 3."] == {"gpl-3"}
    assert told["Creative Commons Attribution-ShareAlike 3.0 Unported License"] == {"cc-by-sa-3.0"}
    assert not told["an ordinary sentence"] and not told["7 words"]
    assert len(licenses.RULES) > 400 and len({r.label for r in licenses.RULES}) > 90


def test_suppression():
    taken = licenses.Taken()
    rng, all_ = random.Random(1), []
    for _ in range(400):
        a = rng.randrange(60)
        b = a + rng.randrange(1, 12)
        assert taken.holds(a, b) == any(x <= a and b <= y for x, y in all_)
        if not taken.holds(a, b):
            taken.add(a, b)
            all_.append((a, b))


def test_odd_rows(spark):
    long_ = "word " * 200_000 + "under the MIT license " * 2
    rows = [(1, None), (1, None), (None, "CC-BY-NC"), (2, ""), (3, long_), (4, "MIT License"), (4, "MIT License")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_words", "'y' AS base", "'z' AS label")
    got = licenses.summary(licenses.find_licenses(d)).collect()
    told = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=str)
    mit = (4, 2, 0, None, None, "", "mit", 0.8)
    assert told == sorted([(1, 0, 0, None, None, "", "", 0.0)] * 2 + [(None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.9), (2, 0, 0, None, None, "", "", 0.0), (3, 200_008, 2, 200_000, 200_004, "mit", "mit", 0.9), mit, mit], key=str)
    assert licenses.find_licenses(d.limit(0)).collect() == []
