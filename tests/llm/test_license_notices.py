"""License notices that stand in prose of many license words."""

import random

import pytest

from strideframe.llm import licenses

PROSE = ("Text and images in this work are made available by the authors under the terms of the International Creative Commons Attribution project "
         "and the name of {} may be used to any person without restriction")


def test_short_notice_in_prose_of_license_words():
    text = PROSE.format("it") + " Licensed under CC BY 4.0. released to any person without restriction."
    assert [(n[0], n[3]) for n in licenses.notices(text)] == [("CC-BY-4.0", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_no_template_is_outranked(seed):
    """Words of the long templates, shuffled, around each template."""
    r = random.Random(seed)
    words = [w for x in licenses.TEMPLATES.values() for t in x for w in licenses.words_of(t) if not licenses.tells(w)]
    for name, wordings in licenses.TEMPLATES.items():
        for t in wordings:
            text = " ".join(r.choices(words, k=28)) + " . " + t + " " + " ".join(r.choices(words, k=28))
            assert name in [n[0] for n in licenses.notices(text)], (name, t)


def test_a_closer_notice_of_another_license_hides_none():
    text = "this work is licensed under the GNU General Public License version 7 and this text is licenced under the GNU General Public License version 3"
    assert [n[0] for n in licenses.notices(text)] == ["GPL-3.0"]


@pytest.mark.parametrize("name, text", [
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "// SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "# SPDX-License-Identifier: MIT"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "Released under the Unlicense."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("MIT", "licensed under MIT."),
])
def test_customary_wordings(name, text):
    assert [n[0] for n in licenses.notices(text)] == [name]


def test_bsd_texts_are_told_apart():
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    two = head + "reproduce the above copyright notice in the documentation and/or other materials provided with the distribution. "
    three = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software. "
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"
    assert [n[0] for n in licenses.notices(two + end)] == ["BSD", "BSD-2-Clause"]
    assert [n[0] for n in licenses.notices(two + three + end)] == ["BSD", "BSD-3-Clause"]


def test_other_versions_are_not_reported():
    for text in ("SPDX-License-Identifier: LGPL-2.1-only", "Licensed under CC BY-NC-SA 3.0.", "Licensed under the Mozilla Public License 1.1."):
        assert licenses.notices(text) == []


def test_denied_notices_are_none():
    for text in ("Not licensed under the MIT License.", "It is no longer licensed under the MIT License.", "never licensed under CC BY 4.0"):
        assert licenses.notices(text) == []
    both = "Not licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [n[0] for n in licenses.notices(both)] == ["Apache-2.0"]


def brute_force(words, before=None):
    """Licenses and edits of a text: of all templates and places the fewest edits, then what is left on both sides."""
    best = None
    for i, (name, template, _) in enumerate(licenses._templates()[0]):
        if found := licenses._aligned(template, words, int(licenses.MOST_EDITS * len(template)), before):
            edits, s, e, _ = found
            key = (edits, -len(template), s, i)
            if best is None or key < best[0]:
                best = key, (name, s, e)
    if best is None:
        return []
    name, s, e = best[1]
    return brute_force(words[:s], before) + [(name, best[0][0])] + brute_force(words[e:], words[e - 1])


@pytest.mark.parametrize("seed", range(4))
def test_ranking_loses_nothing(seed):
    """Notices in prose, some with a word changed, against every template at every place."""
    r = random.Random(seed)
    pool = ["stone", "river", "license", "text", "under", "terms", "permission", "is", "made", "seven", "this", "work"]
    for _ in range(6):
        parts = []
        for name in r.sample(sorted(licenses.TEMPLATES), r.randint(0, 3)):
            words = licenses.words_of(r.choice(licenses.TEMPLATES[name]))
            if r.random() < 0.4:
                words[r.randrange(len(words))] = r.choice(pool)
            parts += [r.choices(pool, k=r.randint(0, 12)), words]
        text = " ".join(w for p in [*parts, r.choices(pool, k=9)] for w in p)
        assert [(n[0], n[3]) for n in licenses.notices(text)] == brute_force(licenses.words_of(text)), text


def test_first_exact_template_of_the_ranking_wins(monkeypatch):
    """The result comes through the ranking: of two templates that stand there word for word, the first ranked."""
    text = "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."
    number = {" ".join(w): i for i, (_, w, _) in enumerate(licenses._templates()[0])}
    long, short = number[" ".join(licenses.words_of(text))], number["licensed under the apache license version 2.0"]
    ranked = [i for _, i in licenses._ranked(licenses.words_of(text))]
    assert ranked.index(long) < ranked.index(short) and licenses.notices(text)[0][2] == 19
    monkeypatch.setattr(licenses, "_ranked", lambda part: [(1, short), (0, long)])
    assert licenses.notices(text)[0][2] == 7
