"""License notices found by conditional compression and confirmed word by word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: customary wordings of notices
_CC = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-NC": "Attribution-NonCommercial", "-ND": "Attribution-NoDerivatives"}


def _gnu(kind: str, short: str, version: str) -> list[str]:
    """Short forms, header and SPDX lines of a GNU license."""
    full = f"GNU {kind}General Public License"
    return [
        f"This work is licensed under the {full}, version {version}.",
        f"Licensed under the {full} v{version}.0.",
        f"Licensed under the {full} {version}.0.",
        f"Licensed under the GNU {short} v{version}.",
        f"Licensed under the GNU {short} version {version}.",
        f"Licensed under the {short} v{version}.",
        f"Licensed under the {short} version {version}.",
        f"Licensed under {short}v{version}.",
        f"Licensed under {short}-{version}.0.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version.",
        f"under the terms of the {full} version {version} as published by the Free Software Foundation",
        *[f"SPDX-License-Identifier: {short}-{version}.0{x}" for x in ("", "-only", "-or-later")],
    ]


TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under MIT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Licensed under the Apache License 2.0.",
        "Licensed under the Apache 2.0 License.",
        "Licensed under Apache-2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": _gnu("", "GPL", "2"),
    "GPL-3.0": _gnu("", "GPL", "3"),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", "3"),
    "AGPL-3.0": _gnu("Affero ", "AGPL", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Licensed under the MPL 2.0.",
        "Licensed under MPL-2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    # the sentence that the licenses of two and of three clauses begin with
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Licensed under the 2-Clause BSD License.",
        "Licensed under the Simplified BSD License.",
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the 3-Clause BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Licensed under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work is licensed under a Creative Commons Zero 1.0 Universal License.",
        "This work is licensed under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
} | {
    f"CC-BY{x}-4.0": [
        f"Licensed under CC BY{x} 4.0.",
        f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
        f"SPDX-License-Identifier: CC-BY{x}-4.0",
    ]
    for x, kind in _CC.items()
}
#: Words that every template has one of; blocks are looked for around them.
ANCHOR = re.compile(r"licen[cs]|permission|redistribut|unencumbered|contributors", re.IGNORECASE)
#: Words that tell licenses apart: a difference in one of them makes another license.
TELLING = {"mit", "apache", "gnu", "general", "public", "lesser", "affero", "mozilla", "cc", "cc0", "by", "sa", "nc", "nd", "creative", "commons",
           "attribution", "sharealike", "noncommercial", "noderivatives", "version", "v", "bsd", "clause", "simplified", "isc", "unlicense", "zero", "mpl", "gpl",
           "lgpl", "agpl", "spdx"}
#: Words that turn the notice after them into its opposite.
DENIALS = {"not", "never", "longer"}
WORDS = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
LEVEL = 9
#: Share of a template's words that may differ.
MOST_EDITS = 0.2
#: Words of a block beyond the longest template.
SLACK = 4


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@lru_cache(maxsize=1)
def _templates():
    out = []
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            words = words_of(wording)
            d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((name, words, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False), max(len(w) for _, w, _ in out)


def align(template: list[str], block: list[str]) -> tuple[int, int, int, list[str]]:
    """Fewest word edits from a template to any stretch of a block: edits, start, end, and the differing words."""
    rows = [[(0, j, None) for j in range(len(block) + 1)]]  # cost, where the stretch starts, step
    for i, t in enumerate(template):
        row = [(i + 1, 0, "-")]
        for j, b in enumerate(block):
            c, s, _ = rows[-1][j]
            best = (c + (t != b), s, "=" if t == b else "x")
            c, s, _ = rows[-1][j + 1]
            best = min(best, (c + 1, s, "-"), key=lambda x: x[0])
            c, s, _ = row[-1]
            row.append(min(best, (c + 1, s, "+"), key=lambda x: x[0]))
        rows.append(row)
    end = min(range(len(block) + 1), key=lambda j: (rows[-1][j][0], j))
    cost, start, _ = rows[-1][end]
    differ, i, j = [], len(template), end
    while i:
        step = rows[i][j][2]
        if step != "=":
            differ.append({"x": f"{template[i - 1]}>{block[j - 1]}", "-": f"-{template[i - 1]}", "+": f"+{block[j - 1]}"}[step])
        i, j = i - (step != "+"), j - (step != "-")
    return cost, start, end, differ[::-1]


def tells(difference: str) -> bool:
    """Whether a differing word decides which license it is."""
    return any(w in TELLING or any(c.isdigit() for c in w) for w in re.split(r"[>+-]", difference) if w)


def notices(text: str | None) -> list[tuple[str, int, int, int, int, str]]:
    """Notices of a text: license, first and last word (end excluded), edits, bytes saved, differing words.

    Blocks are the words around anchor words, merged where they overlap.  Every stretch of a block is compressed with each
    template as raw dictionary, and the templates are ranked by the bytes that this saves.  In that order they are
    confirmed by their exact differences in words, see `_confirmed`.  What stands before and after a notice is searched
    again, so a block may hold any number of them.
    """
    if not text or not ANCHOR.search(text):
        return []
    words = words_of(text)
    _, _, longest = _templates()
    reach, blocks = longest + SLACK, []
    for i, w in enumerate(words):
        if ANCHOR.search(w):
            a, b = max(0, i - reach), min(len(words), i + reach + 1)
            if blocks and a <= blocks[-1][1]:
                blocks[-1][1] = b
            else:
                blocks.append([a, b])
    out = []
    while blocks:
        a, b = blocks.pop()
        if found := _confirmed(words[a:b], 2 * reach, words[a - 1] if a else None):
            name, s, e, edits, saved, differ = found
            out.append((name, a + s, a + e, edits, saved, differ))
            blocks += [[a, a + s], [a + e, b]]
    return sorted(out, key=lambda x: x[1])


def _confirmed(block: list[str], span: int, before: str | None):
    """The best confirmed template of a block that follows the word `before`; a long block is taken in overlapping stretches.

    The first template of a stretch's ranking that stands in it word for word wins.  Where none does, the ranking is gone
    down to its end, so scattered words of other templates hide nothing: the fewest edits win, ties by rank.
    """
    best = None
    templates, _, _ = _templates()
    for at in range(0, max(1, len(block) - span // 2), span // 2):
        part = block[at : at + span]
        if not any(ANCHOR.search(w) for w in part):
            continue
        has, ahead = Counter(part), block[at - 1] if at else before
        for saved, i in _ranked(part):
            name, template, _ = templates[i]
            most = int(MOST_EDITS * len(template))
            # more words than may differ are not there at all
            if sum(n - has[w] for w, n in _counts(i) if has[w] < n) > most:
                continue
            if (found := _aligned(template, part, most, ahead)) is None:
                continue
            edits, s, e, differ = found
            key = (edits, -saved, at + s, i)
            if best is None or key < best[0]:
                best = key, (name, at + s, at + e, edits, saved, " ".join(differ))
            if not edits:
                break
    return best and best[1]


def _ranked(part: list[str]) -> list[tuple[int, int]]:
    """Bytes saved by each template as dictionary and its number, most bytes first."""
    templates, plain, _ = _templates()
    raw = " ".join(part).encode()
    size = len(plain.compress(raw))
    return sorted(((size - len(c.compress(raw)), i) for i, (_, _, c) in enumerate(templates)), key=lambda x: (-x[0], x[1]))


@lru_cache(maxsize=None)
def _counts(i: int) -> list[tuple[str, int]]:
    return list(Counter(_templates()[0][i][1]).items())


def _aligned(template: list[str], part: list[str], most: int, ahead: str | None = None):
    """The closest stretch within `most` edits that differs in no telling word and is not denied by the word before it.

    Others are passed over; `ahead` is the word before the part.
    """
    found, left = None, [(0, len(part))]
    while left:
        a, b = left.pop()
        if b - a < len(template) - most:
            continue
        edits, s, e, differ = align(template, part[a:b])
        if edits > most:
            continue
        first = a + s
        if any(map(tells, differ)) or (part[first - 1] if first else ahead) in DENIALS:
            left += [(a, a + s), (a + e, b)]
        elif found is None or (edits, a + s) < found[:2]:
            found = edits, a + s, a + e, differ
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each notice: doc_id, notice (its number in the document), license, start_word, end_word, edits, saved_bytes, differences.

    Documents without a notice have no row; a notice right after "not", "never" or "longer" is none; null and empty texts have none; repeated rows are scanned each; an empty
    table gives an empty result.  Rows are handled one by one, so nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, *n) for d, t in zip(b["doc_id"], b["text"]) for k, n in enumerate(notices(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "notice", "license", "start_word", "end_word", "edits", "saved_bytes", "differences"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, notice long, license string, start_word long, end_word long, edits long, saved_bytes long, differences string")
