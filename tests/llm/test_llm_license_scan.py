import random
import textwrap
from collections import Counter

import pytest
from llm_helpers import documents, make_docs

from tierloom.llm import license_scan as L

CASES = {
    1: ("prose\nReleased under the MIT License.", [("MIT", "Released under the MIT License", 0)]),
    2: ("RELEASED under  the\tMIT license", [("MIT", "RELEASED under  the\tMIT license", 0)]),
    3: ("Licensed under CC BY-NC 4.0.\nmore", [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", 0)]),
    4: ("Licensed under CC BY 4.0.", [("CC-BY-4.0", "Licensed under CC BY 4.0", 0)]),
    5: ("Licensed under CC BY-SA 4.0", [("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", 0)]),
    6: ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3", 0)]),
    7: ("This work was licensed under the GNU General Public License, version 3.", [("GPL-3.0-only", "This work was licensed under the GNU General Public License, version 3", 1)]),
    8: ("his driving licence was lost", []),
    9: (None, []),
    10: ("", []),
    11: ("Licensed under the Apache License,\nVersion 2.0.", [("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0", 0)]),
    12: ("Released under the MIT License.\nx\n\nReleased under the MIT License.", [("MIT", "Released under the MIT License", 0)] * 2),
    13: ("Released under the MIT License. Licensed under CC BY 4.0.", [("MIT", "Released under the MIT License", 0), ("CC-BY-4.0", "Licensed under CC BY 4.0", 0)]),
    14: ("é\U0001f600 " * 30_000 + "\nLicensed under the Apache License, Version 2.0.", [("Apache-2.0", "Licensed under the Apache License, Version 2.0", 0)]),
}


def test_cases(spark):
    rows = [(n, text) for n, (text, _) in CASES.items()] + [(1, CASES[1][0]), (None, CASES[4][0])]
    got = L.scan_licenses(make_docs(spark, rows)).collect()
    for n, (text, want) in CASES.items():
        found = sorted((r.start, r.license, text[r.start : r.end], len(r.differences)) for r in got if r.doc_id == n)
        assert [f[1:] for f in found] == want * (2 if n == 1 else 1), n
    assert [r.license for r in got if r.doc_id is None] == ["CC-BY-4.0"]
    assert L.scan_licenses(make_docs(spark, [])).count() == 0


def brute(scanner, text):
    """Every template's notices in the whole text, by word alignment alone:
    the stretches that a notice fits, longest first, that overlap no other."""
    words = L.words_of(text)
    plain = [w for w, _, _ in words]
    found = []
    for name, notices in scanner.notices.items():
        for notice in notices:
            slack, held = L.allowed(notice), Counter(notice)
            if (held - Counter(plain)).total() > slack:
                continue
            for start in range(len(plain)):
                if (held - Counter(plain[start : start + len(notice) + slack])).total() > slack:
                    continue
                for end in range(start + max(1, len(notice) - slack), min(len(plain), start + len(notice) + slack) + 1):
                    if (cost := edits(scanner, notice, plain[start:end])) <= slack:
                        found.append((start - end, cost, start, end, name))
    best = []
    for _, cost, start, end, name in sorted(found, key=lambda x: (x[0] + 2 * x[1], x[2])):
        if not any(start < e and s < end for s, e, _ in best):
            best.append((start, end, name))
    return sorted((words[s][1], words[e - 1][2], name) for s, e, name in best)


def edits(scanner, notice, stretch):
    """Edits by words; those that tell licenses apart must agree."""
    price = lambda w: 99 if scanner.tells(w) else 1
    row = [0]
    for w in stretch:
        row.append(row[-1] + price(w))
    for word in notice:
        new = [row[0] + price(word)]
        for n, w in enumerate(stretch):
            change = 0 if w == word else max(price(w), price(word))
            new.append(min(row[n] + change, row[n + 1] + price(word), new[-1] + price(w)))
        row = new
    return row[-1]


def context(rng, docs, n):
    words = rng.choice(docs).split()
    at = rng.randrange(len(words))
    return " ".join(words[at : at + n])


def test_against_all_templates_and_all_stretches(spark):
    """What ranking leaves out or puts off is never a notice that fits."""
    rng = random.Random(5)
    docs = [r.text for r in documents(spark).collect()]
    scanner = L.Scanner(L.TEMPLATES)
    notices = [(name, x) for name, each in L.TEMPLATES.items() if not name.startswith("BSD") for x in each]
    for _ in range(40):
        parts = [context(rng, docs, rng.choice([3, 10, 40]))]
        for _, notice in rng.sample(notices, rng.choice([1, 1, 2, 4])):
            words = notice.split()
            if rng.random() < 0.4:  # one word missing or changed
                words[rng.randrange(len(words))] = rng.choice(["", "other"])
            parts += [" ".join(words), context(rng, docs, rng.choice([3, 10, 40]))]
        text = "\n".join(parts)
        got = [(s, e, name) for name, s, e, _, _ in L.scan_text(scanner, text)]
        assert got == brute(scanner, text), text


def test_no_exact_notice_is_lost(spark):
    rng = random.Random(6)
    docs = [r.text for r in documents(spark, "/root/testdata/sf0.01").collect()]
    for name, notices in L.TEMPLATES.items():
        for notice in notices:
            for n in (0, 6, 25, 120):
                before, after = ("\n" + context(rng, docs, n) + "\n" for _ in "ab")
                found = [(x, text) for x, text in found_in(before + notice + after) if text == notice.rstrip(".:")]
                assert [x.replace("2", "3") if notice in L._BSD else x for x, _ in found] == [name.replace("2-C", "3-C") if notice in L._BSD else name], notice


THIRD = L.NOTICES["BSD-3-Clause"][3]


@pytest.mark.parametrize("text, name", [(" ".join(L._BSD), "BSD-2-Clause"), (" ".join((*L._BSD, THIRD)), "BSD-3-Clause"), (L._BSD[0], "BSD-2-Clause")])
def test_the_block_decides_between_templates_of_the_same_words(text, name, monkeypatch):
    """The clauses of both BSD licenses go to the one that explains the block."""
    assert {x for x, _ in found_in(text)} == {name}
    # Without compression to rank them, the first template takes what it can.
    monkeypatch.setattr(L.Scanner, "ranked", lambda self, words: [(9, n) for n in self.given])
    assert {x for x, _ in found_in(" ".join((*L._BSD, THIRD)))} == {"BSD-2-Clause", "BSD-3-Clause"}
    monkeypatch.setattr(L.Scanner, "ranked", lambda self, words: [])
    assert found_in(text) == []


@pytest.mark.parametrize("text, names", [
    ("Licensed under the MIT License.", ["MIT"]),
    ("Released under MIT License.", ["MIT"]),
    ("Released under MIT.", []),
    ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0-only"]),
    ("SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"]),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", ["LGPL-3.0-or-later"]),
    ("Licensed under the MIT License or the Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
    (L._GNU.format("Affero General", 3), ["AGPL-3.0-or-later"]),
    (L._GNU.format("Lesser General", "2.1"), ["LGPL-2.1-or-later"]),
    (L._GNU.format("General", 2), ["GPL-2.0-or-later"]),
    ("Licensed under the GNU General Public License, version 4", []),
    ("mit Lizenz oder licence, cc general public software identifier", []),
])
def test_customary_forms(text, names):
    assert [name for name, _ in found_in(text)] == names


def test_own_templates_bring_their_hints(spark):
    own = {"house": ("Only the kitchen staff may open this cupboard.",), "void": ("",)}
    docs = make_docs(spark, [(1, "x y. only the kitchen staff may open this cupboard! z"), (2, "Released under the MIT License.")])
    found = L.scan_licenses(docs, own).collect()
    assert [(r.doc_id, r.license, r.differences) for r in found] == [(1, "house", [])]


def test_a_template_saves_most_on_its_own_text():
    scanner = L.Scanner(L.TEMPLATES)
    for name, notices in L.TEMPLATES.items():
        for notice in notices:
            savings = {x: s for s, x in scanner.ranked([w for w, _, _ in L.words_of(notice)])}
            assert savings[name] >= 0.9 * max(savings.values()) - 3, notice


@pytest.mark.parametrize("line, name", [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Released under the MIT License.", "MIT"),
])
def test_given_documents(spark, line, name):
    """Every document with the line is found, under that license, and no other."""
    docs = documents(spark, "/root/testdata/sf0.01")
    want = {r.doc_id for r in docs.where(docs.text.contains(line)).collect()}
    got = {r.doc_id for r in L.scan_licenses(docs).where(f"license = '{name}'").collect()}
    assert want == got and want


SCANNER = L.Scanner(L.TEMPLATES)


def found_in(text):
    return [(name, text[start:end]) for name, start, end, _, _ in L.scan_text(SCANNER, text)]


def either_bsd(found):
    """The clauses that both BSD licenses have are either's."""
    return [("BSD" if name[:3] == "BSD" and text.rstrip(".:") in [x.rstrip(".:") for x in L._BSD] else name, text) for name, text in found]


@pytest.mark.parametrize("words", [20, 800, 4_000])
def test_a_notice_inside_a_long_line(words):
    own = [" ".join(f"w{n * k % 9973}" for n in range(words)) for k in (7, 13)]
    for name, notices in L.TEMPLATES.items():
        for notice in notices:
            assert either_bsd(found_in(f"{own[0]} {notice} {own[1]}")) == either_bsd([(name, notice.rstrip(".:"))]), notice


def test_every_license_of_a_block():
    notices = [(name, notice) for name, texts in L.TEMPLATES.items() for notice in texts]
    found = found_in("\n".join(notice for _, notice in notices))
    assert either_bsd(found) == either_bsd([(name, notice.rstrip(".:")) for name, notice in notices])


@pytest.mark.parametrize("width", [60, 72])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices(width, mark):
    for name, notices in L.TEMPLATES.items():
        for notice in notices:
            for before in ("", "some other words of this file come first, "):
                text = textwrap.fill(before + notice, width, initial_indent=mark, subsequent_indent=mark)
                assert [x[:3] if notice in L._BSD else x for x, _ in found_in(text)] == [name[:3] if notice in L._BSD else name], text


def test_hints_far_apart_lose_nothing():
    scanner = L.Scanner(L.TEMPLATES)
    notice = L.TEMPLATES["GPL-3.0-or-later"][0]
    for gap in range(0, 4 * scanner.reach, 11):
        text = "license " + "x " * gap + notice + " y" * gap + " license " + notice
        assert [x for x, _ in found_in(text)] == ["GPL-3.0-or-later"] * 2, gap
