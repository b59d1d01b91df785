"""License scan by conditional compression.

1. *Candidates.* A notice can only be where a word stands that it must have
   (``hints_of`` derives them from the templates). The words around each
   such word, as many on either side as the longest notice can have, make a
   block; overlapping blocks are one, and long ones are read in overlapping
   windows that hold every notice whole.
2. *Ranking.* Each block is compressed on its own and with every template as
   a raw zstandard dictionary. What a template saves, in bytes, is how much
   of the block it explains. Templates that save ``MIN_SAVING`` or more are
   ranked by it; among leaders that save nearly the same the one that has the
   least text explains it best.
3. *Confirming.* In that order the notices of a template are aligned word by
   word with the block. If one fits, with few differences, none of them in a
   word that tells licenses apart, the template is confirmed, with all its
   notices there. Their words go from the block and the rest is ranked again,
   until no template that saves enough fits. So a block may hold any number
   of licenses.

A stretch that several templates explain (the opening of the BSD licenses)
therefore goes to the one that explains most of the block around it.

Templates are customary notices, the phrases "licensed under ..." with a
license's names, and SPDX tags; pass others as ``templates``, and the words
that tell them apart follow. ``saving`` is in bytes.

The hints are looked for inside Spark first, so most texts never reach
Python. Nothing is shuffled.

Defined cases: null or empty texts give no rows; a notice that occurs twice
in a text gives two rows; equal ranks go by license name; repeated rows
each get their rows; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tierloom.llm.storage import table

# Names of licenses by SPDX identifier (or expression), and
# customary notices.
NAMES = {
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2",),
    "GPL-3.0-only": ("GNU General Public License, version 3",),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
NOTICES = {
    "AGPL-3.0-or-later": (_GNU.format("Affero General", 3),),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": (*_BSD, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "CC0-1.0": ("This work has been dedicated to the public domain under CC0 1.0 Universal.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0-or-later": (_GNU.format("General", 2),),
    "GPL-3.0-or-later": (_GNU.format("General", 3),),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1-or-later": (_GNU.format("Lesser General", "2.1"),),
    "LGPL-3.0-or-later": (_GNU.format("Lesser General", 3),),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: How names are put; one word of it may differ.
PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "or the {}")
#: Words of names that say nothing of which license it is.
PLAIN_WORDS = frozenset("a any free international of or software the under universal v version".split())

TEMPLATES = {
    name: (
        *NOTICES.get(name, ()),
        *(phrase.format(x) for x in NAMES.get(name, ()) for phrase in PHRASES),
        *((f"SPDX-License-Identifier: {name}",) if name in NAMES or "-or-" in name else ()),
    )
    for name in sorted({*NAMES, *NOTICES})
}

#: Bytes that a template must save in a block to be tried there.
MIN_SAVING = 1
#: Words on either side of a hint in a narrow block.
NARROW = 8
#: Leaders save at least this share of the most, less a few bytes.
_NEAR, _NEAR_BYTES = 0.95, 3
#: Words of a notice that may be missing, changed or added.
MAX_DIFFERENCE = 0.15
#: Notices of so many words may differ in one at least.
SHORT = 4

# Optimal parsing: what a dictionary saves in a short block is a few bytes.
_LEVEL = 19
_BLOCK_BYTES = 1 << 10
_NEVER = 1 << 20
# A line may end after a hyphen; the next one may begin with comment marks.
_BREAK = r"(?<=-)\n[ \t*#/;]*"
_WORD = re.compile(rf"\w+(?:[.\-](?:{_BREAK})?\w+)*")
_BREAK = re.compile(_BREAK)


def each_word(text: str) -> Iterator[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return ((_BREAK.sub("", m.group().lower()), m.start(), m.end()) for m in _WORD.finditer(text))


def words_of(text: str) -> list[tuple[str, int, int]]:
    return list(each_word(text))


def allowed(notice: list[str]) -> int:
    return max(int(len(notice) * MAX_DIFFERENCE), len(notice) >= SHORT)


class Scanner:
    """Templates, ready to compress and to align."""

    def __init__(self, templates: dict[str, tuple[str, ...]], names: dict[str, tuple[str, ...]] | None = None):
        split = {name: [[w for w, _, _ in words_of(x)] for x in texts] for name, texts in templates.items()}
        #: Notices by license.
        self.notices = {name: [x for x in each if x] for name, each in split.items()}
        names = {n: NAMES.get(n, ()) for n in templates} if names is None else names
        self.telling = {w for each in names.values() for x in each for w, _, _ in words_of(x)} - PLAIN_WORDS
        every = [notice for each in self.notices.values() for notice in each]
        self.reach = max((len(x) + allowed(x) for x in every), default=0)
        self.hints = {hint for notice in every for hint in self.hints_of(notice)}
        hints = "|".join(map(re.escape, sorted(self.hints)))
        # The same words for Java and for Python.
        self.hinted = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{hints})(?![\p{{L}}\p{{N}}_])" if hints else r"(?!)"
        self.hint_words = re.compile(rf"(?i)(?<!\w)(?:{hints})(?!\w)" if hints else r"(?!)")
        parsing = zstandard.ZstdCompressionParameters.from_level(_LEVEL, source_size=_BLOCK_BYTES)
        self.plain = zstandard.ZstdCompressor(compression_params=parsing)
        self.given, self.size = {}, {}
        for name, each in self.notices.items():
            text = "\n".join(" ".join(notice) for notice in each).encode()
            raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parsing = zstandard.ZstdCompressionParameters.from_level(_LEVEL, source_size=_BLOCK_BYTES, dict_size=len(text))
            self.given[name], self.size[name] = zstandard.ZstdCompressor(compression_params=parsing, dict_data=raw), len(text)

    def tells(self, word: str) -> bool:
        """Whether a word tells licenses apart, so that it must agree."""
        return word in self.telling or bool(re.search(r"[0-9\-]", word))

    def hints_of(self, notice: list[str]) -> list[str]:
        """Words of which a stretch that fits the notice has at least one:
        the longest that must agree, or one more than may be missing."""
        must = [max(re.split(r"[.\-]", w), key=len) for w in notice if self.tells(w)]
        if must:
            return [max(must, key=len)]
        return sorted(set(notice), key=lambda w: (-len(w), w))[: allowed(notice) + 1]

    def saving(self, words: list[str], name: str) -> int:
        """Bytes that the template saves in compressing the words."""
        data = " ".join(words).encode()
        return len(self.plain.compress(data)) - len(self.given[name].compress(data))

    def ranked(self, words: list[str]) -> list[tuple[int, str]]:
        """``(saving, license)`` of the templates to try, in order."""
        data = " ".join(words).encode()
        own = len(self.plain.compress(data))
        savings = [(own - len(c.compress(data)), name) for name, c in self.given.items()]
        savings = [x for x in savings if x[0] >= MIN_SAVING]
        near = _NEAR * max((s for s, _ in savings), default=0) - _NEAR_BYTES
        return sorted(savings, key=lambda x: (x[0] < near, self.size[x[1]] if x[0] >= near else -x[0], x[1]))

    def confirmed(self, words: list[str], name: str) -> tuple[int, int, list[str]] | None:
        """``(first word, end, differences)`` of the template's notice that
        fits best somewhere: long, with few differences."""
        there = set(words)
        found = [x for n in self.notices[name] if all(w in there for w in n if self.tells(w)) and (x := self.aligned(n, words))]
        return max(found, key=lambda x: (x[1] - x[0] - 2 * len(x[2]), -x[0]), default=None)

    def aligned(self, notice: list[str], words: list[str]) -> tuple[int, int, list[str]] | None:
        """The stretch of words nearest to the notice, if it differs in no
        more words than allowed and in none that tells licenses apart."""
        price = np.array([_NEVER if self.tells(w) else 1 for w in words], np.int64)
        extra = np.r_[0, np.cumsum(price)]
        codes = {w: n for n, w in enumerate(dict.fromkeys(words))}
        text = np.array([codes[w] for w in words], np.int64)
        rows = [np.zeros(len(words) + 1, np.int64)]
        for word in notice:
            cost, before = (_NEVER if self.tells(word) else 1), rows[-1]
            same = text == codes.get(word, -1)
            row = before + cost
            row[1:] = np.minimum(row[1:], before[:-1] + np.where(same, 0, np.maximum(cost, price)))
            rows.append(np.minimum.accumulate(row - extra) + extra)
        end = int(rows[-1].argmin())
        if rows[-1][end] > allowed(notice):
            return None
        return self._differences(notice, words, rows, extra, end)

    def _differences(self, notice: list[str], words: list[str], rows: list[np.ndarray], extra: np.ndarray, end: int) -> tuple[int, int, list[str]]:
        at, r, out = end, len(notice), []
        while r:
            cost = rows[r][at] - (rows[r - 1][at - 1] if at else _NEVER)
            if at and words[at - 1] == notice[r - 1] and cost == 0:
                at, r = at - 1, r - 1
            elif at and cost == 1:
                out.append(f"{notice[r - 1]} -> {words[at - 1]}")
                at, r = at - 1, r - 1
            elif rows[r][at] == rows[r - 1][at] + 1:
                out.append(f"{notice[r - 1]} -> ")
                r -= 1
            else:
                out.append(f" -> {words[at - 1]}")
                at -= 1
        return at, end, out[::-1]


Words = list[tuple[str, int, int]]


def blocks_of(scanner: Scanner, text: str) -> Iterator[Words]:
    """The words of a text around its hints, up to ``reach`` of them on either
    side; windows of a long block overlap by ``reach``."""
    reach, window = scanner.reach, 4 * scanner.reach
    hints = (m.start() for m in scanner.hint_words.finditer(text))
    hint = next(hints, None)
    before, block, since = deque(maxlen=reach), [], 0
    for word in each_word(text):
        hinted = False
        while hint is not None and hint < word[2]:
            hinted, hint = True, next(hints, None)
        if hinted and not block:
            block = list(before)
        if not hinted and not block:
            if hint is None:
                return
            before.append(word)
            continue
        block.append(word)
        since = 0 if hinted else since + 1
        if since == 2 * reach:  # half of them may belong to the next hint
            yield block[: len(block) - reach]
            before = deque(block[len(block) - reach :], maxlen=reach)
            block = []
        elif len(block) >= window and since < reach:
            yield block
            block = block[-reach:]
    if block:
        yield block


def _narrow(scanner: Scanner, words: Words) -> Iterator[tuple[int, int]]:
    """Where the narrow blocks of some words begin and end."""
    for n, (word, _, _) in enumerate(words):
        if scanner.hint_words.search(word):
            yield max(0, n - NARROW), min(len(words), n + NARROW + 1)


def _taken(scanner: Scanner, words: list[str], name: str) -> Iterator[tuple[int, int, list[str]]]:
    """All notices of a template in some words: ``(first, end, differences)``."""
    parts = [(0, len(words))]
    while parts:
        start, stop = parts.pop()
        if found := scanner.confirmed(words[start:stop], name):
            first, end, differences = found
            yield start + first, start + end, differences
            parts += [(start, start + first), (start + end, stop)]


def scan_text(scanner: Scanner, text: str) -> list[tuple[str, int, int, int, list[str]]]:
    """``(license, start, end, saving, differences)`` of a text's notices."""
    out: list[tuple[str, int, int, int, list[str]]] = []

    def fits(part: Words, start: int, stop: int) -> list[Words] | None:
        """What the notices of the first template that fits leave of a part;
        None if none fits."""
        words = [w for w, _, _ in part[start:stop]]
        for saving, name in scanner.ranked(words):
            if taken := sorted(_taken(scanner, words, name)):
                places = [(start + first, start + end) for first, end, _ in taken]
                out.extend((name, part[a][1], part[b - 1][2], saving, x[2]) for (a, b), x in zip(places, taken, strict=True))
                # What stood apart stays apart.
                gaps = zip([0, *(b for _, b in places)], [*(a for a, _ in places), len(part)], strict=True)
                return [part[a:b] for a, b in gaps if a < b]
        return None

    for block in blocks_of(scanner, text):
        wide, narrow = [block], []
        while wide:
            part = wide.pop()
            left = fits(part, 0, len(part)) if part else []
            if left is None:
                narrow.append(part)
            else:
                wide += left
        while narrow:
            part = narrow.pop()
            narrow += next(filter(None, (fits(part, *x) for x in _narrow(scanner, part))), [])
    # Windows overlap: a notice may be found in both, in one of them cut short.
    best: list[tuple[str, int, int, int, list[str]]] = []
    for x in sorted(out, key=lambda x: (x[1] - x[2], len(x[4]), x[1], x[0])):
        if not any(x[1] < y[2] and y[1] < x[2] for y in best):
            best.append(x)
    return sorted(best, key=lambda x: (x[1], x[0]))


def scan_licenses(
    documents: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, names: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """``doc_id, license, start, end, saving, differences``: one row per
    notice, with its place in code points. ``names`` holds the words by
    which ``templates`` are told apart."""
    templates = templates or TEMPLATES
    schema = StructType([documents.schema["doc_id"]]).add("license", "string").add("start", "long").add("end", "long")
    schema = schema.add("saving", "long").add("differences", ArrayType(StringType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, names)
        for batch in batches:
            found = [(n, *x) for n, text in enumerate(batch.column("text").to_pylist()) for x in scan_text(scanner, text)]
            cut = list(zip(*found, strict=True)) or [()] * 6
            which, licenses, starts, ends, savings, differences = cut
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(which, pa.int64())),
                    pa.array(licenses, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(savings, pa.int64()),
                    pa.array(differences, pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    hinted = F.col("text").rlike(Scanner(templates, names).hinted)
    return documents.select("doc_id", "text").where(hinted).mapInArrow(scan, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(documents)
    return found.withColumn("differences", F.array_join("differences", "; "))
