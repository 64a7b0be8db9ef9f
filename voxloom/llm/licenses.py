"""License notices in texts, recognised by conditional compression.

A block around a cue word is compressed alone and with each template as raw zstandard dictionary.
The more bytes a template saves, the more of its wording the block repeats: templates are tried in that order, and the first
one that few differing words separate from a run of the block takes the run. What lies beside it is compressed
and ranked again. Words that tell licenses apart (versions, lesser, affero, ...) may not differ at all. A template that saves
nothing cannot be confirmed (a test compares all), so the ranking also ends the search.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
# Wording of common notices, by SPDX identifier ("BSD" where the clauses are not said), and identifiers' endings.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "BSD": [BSD[0]],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", f"{BSD[0]}: {BSD[1]}"],
    "BSD-3-Clause": ["Released under the 3-Clause BSD License.", f"{BSD[0]}: {BSD[1]} {BSD[2]}"],
    "BSD-4-Clause": ["Released under the 4-Clause BSD License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", GNU.format(";", "", ";", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", GNU.format(":", "", ",", "3")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", GNU.format(";", "Lesser ", ";", "2.1").replace("program", "library")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", GNU.format(":", "Lesser ", ",", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", GNU.format(":", "Affero ", ",", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
ENDINGS = {"GPL": ("", "-only", "-or-later", "+"), "LGPL": ("", "-only", "-or-later", "+"), "AGPL": ("", "-only", "-or-later", "+")}
NOTICES = {
    name: texts + ([] if name == "BSD" else [f"SPDX-License-Identifier: {name}{end}" for end in ENDINGS.get(name.split("-")[0], ("",))])
    for name, texts in NOTICES.items()
}
#: Words that a run must share with the template if either has them. So must it every word of the template with a digit.
TELLING = {"lesser", "affero", "noncommercial", "sharealike", "noderivatives"}
CUE = r"(?i)licen[sc]e|public\W+domain|permission\W+is\W+hereby|permission\W+to\W+use|redistribution\W+and\W+use"
LEVEL = 3
_word = re.compile(r"[\w./:-]*\w\+?")
_cue = re.compile(CUE)


def words(text: str) -> list[str]:
    return [w.lower() for w in _word.findall(text)]


def blocks(text: str | None, reach: int) -> list[tuple[int, int]]:
    """(start, end) of blocks around cue words, as far as `reach` either way, joined where they touch."""
    out: list[list[int]] = []
    for m in _cue.finditer(text or ""):
        low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def tells(change: str) -> bool:
    """Whether a change of a word (a -> b, -a or +b) makes it another license."""
    old, arrow, new = change.partition(" -> ")
    if arrow:
        return any(c.isdigit() for c in old) or bool({old, new} & TELLING)
    return change[1:] in TELLING or change[0] == "-" and any(c.isdigit() for c in change)


def wording(block: list[str], template: list[str]) -> tuple[int, int, int, list[str]]:
    """(edits, first, end, changes): fewest word edits between the template and a run of the block's words."""
    rows = [[(j, 0) for j in range(len(block) + 1)]]  # per cell: where the run starts, and the edits so far
    for i, t in enumerate(template, 1):
        row = [(0, i)]
        for j, b in enumerate(block, 1):
            diagonal, above, left = rows[-1][j - 1], rows[-1][j], row[-1]
            row.append(min(((s, n + x) for (s, n), x in ((diagonal, int(b != t)), (above, 1), (left, 1))), key=lambda c: (c[1], -c[0])))
        rows.append(row)
    end = min(range(len(block) + 1), key=lambda j: (rows[-1][j][1], j))
    first, edits = rows[-1][end]
    changes, i, j = [], len(template), end
    while i:
        n = rows[i][j][1]
        if j and n == rows[i - 1][j - 1][1] + (block[j - 1] != template[i - 1]):
            if block[j - 1] != template[i - 1]:
                changes.append(f"{template[i - 1]} -> {block[j - 1]}")
            i, j = i - 1, j - 1
        elif n == rows[i - 1][j][1] + 1:
            changes.append(f"-{template[i - 1]}")
            i -= 1
        else:
            changes.append(f"+{block[j - 1]}")
            j -= 1
    return edits, first, end, changes[::-1]


def between(taken: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The (start, end) of low to high that lie outside the taken ones."""
    ends = [low, *(b for _, b in sorted(taken))]
    return [(a, b) for a, b in zip(ends, [*(a for a, _ in sorted(taken)), high], strict=True) if a < b]


class Templates:
    """Compressors with each notice as raw dictionary."""

    def __init__(self, notices: dict[str, list[str]] | None = None):
        self.all = [(name, text, words(text)) for name, texts in (notices or NOTICES).items() for text in texts]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = []
        for _, text, _ in self.all:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw))
        self.found = lru_cache(maxsize=20_000)(self._found)
        #: No cue of a notice is farther from its ends, with a fifth more for added words.
        self.reach = 6 * max(len(text) for _, text, _ in self.all) // 5

    def ranked(self, block: str) -> list[tuple[int, float, int]]:
        """(bytes saved, their share, template) of the templates that shorten a block, most bytes first; of equal ones the longer template."""
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saved = [(alone - len(c.compress(data)), i) for i, c in enumerate(self.given)]
        return [(n, n / alone, i) for n, i in sorted(saved, key=lambda x: (-x[0], -len(self.all[x[1]][2]), x[1])) if n > 0]

    def confirmed(self, i: int, own: list[str], there: Counter, most: float) -> tuple[int, int, int, list[str]] | None:
        """(edits, first, end, changes) of a template in a run of words; None if too much or something telling differs."""
        template = self.all[i][2]
        # a word of the template that the words lack is an edit at least
        if (Counter(template) - there).total() > most * len(template):
            return None
        edits, first, end, changes = wording(own, template)
        return (edits, first, end, changes) if end > first and edits <= most * len(template) and not any(map(tells, changes)) else None

    def _found(self, block: str, most: float) -> list[tuple[str, int, int, float, int, str]]:
        """Confirmed notices of a block: the first of the ranking that holds takes its words, what lies beside them is ranked again."""
        spans = [m.span() for m in _word.finditer(block)]
        own = [block[a:b].lower() for a, b in spans]
        out, left = [], [(0, len(spans))] if spans else []
        while left:
            low, high = left.pop()
            there = Counter(own[low:high])
            for _, share, i in self.ranked(block[spans[low][0] : spans[high - 1][1]]):
                if hit := self.confirmed(i, own[low:high], there, most):
                    edits, first, end, changes = hit
                    first, end = first + low, end + low
                    out.append((self.all[i][0], spans[first][0], spans[end - 1][1], share, edits, "; ".join(changes)))
                    left += [(a, b) for a, b in ((low, first), (end, high)) if a < b]
                    break
        return sorted(out, key=lambda x: x[1])

    def notices(self, text: str | None, most: float = 0.15) -> list[tuple[str, int, int, float, int, str]]:
        """(license, start, end, size reduction, differing words, their list) of every notice in a text."""
        out = []
        for low, high in blocks(text, self.reach):
            own = [(n, low + a, low + b, s, e, c) for n, a, b, s, e, c in self.found(text[low:high], most)]
            # a short notice in long prose saves too little there: the cue's own line or sentence compresses apart from it
            for start, end in between([(x[1], x[2]) for x in own], low, high):
                for m in re.finditer(r"[^\n]+?(?:[.!?](?=\s)|$|(?=\n))", text[start:end]):
                    if _cue.search(m[0]):
                        own += [(n, start + m.start() + a, start + m.start() + b, s, e, c) for n, a, b, s, e, c in self.found(m[0], most)]
            out += sorted(own, key=lambda x: x[1])
        return out


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, start, end, reduction, differences, changes): every confirmed notice, by its place in code points.

    Only texts with a cue word go to Python. Null and empty texts have none; repeated documents
    give repeated rows; other columns are not looked at.
    """
    schema = "doc_id bigint, license string, start int, end int, reduction double, differences int, changes string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(notices)
        for rows in batches:
            found = [(d, *n) for d, t in zip(rows["doc_id"], rows["text"], strict=True) for n in templates.notices(t)]
            yield pd.DataFrame(found, columns=["doc_id", "license", "start", "end", "reduction", "differences", "changes"])

    likely = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(CUE))
    return likely.mapInPandas(run, schema)
