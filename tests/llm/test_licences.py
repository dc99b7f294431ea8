import numpy as np
import pytest

from lorebed.llm import licences as li
from lorebed.llm.licence_texts import CALIBRATING, FORMS, NAMES

#: Notices in words that no example has.
UNSEEN = [
    "Use of this material is governed by the {}.",
    "We release everything here under the {} license.",
    "See LICENSE ({}).",
    "The contents of this package may be copied under the terms of the {}",
    "All code in this repository is under the {}",
    "This article is published under the {} license and may be reused.",
    "The data set is licensed under the {} by its maintainers.",
    "Distributed under the terms of the {}",
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
PLAIN = "plain words without any notice "


def families(text, m=None):
    return [x[1] for x in li.scan_texts([text], m or li.model())[0]]


def test_forms_not_learnt_from():
    assert not set(UNSEEN) & {*FORMS, *CALIBRATING}
    found = [(family, families(form.format(name))) for family, names in NAMES.items() for name in names for form in UNSEEN]
    assert np.mean([own == [family] for family, own in found]) >= 0.9
    assert np.mean([family in own for family, own in found]) >= 0.93


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Released under the MIT License.", ["MIT"]),
        ("All rights reserved.", ["proprietary"]),
        (MIT, ["MIT"]),
        (GPL, ["GPL"]),
        (GPL.replace("General", "Affero General"), ["AGPL"]),
        (GPL.replace("General", "Lesser General"), ["LGPL"]),
        ("Dual licensed under MIT or Apache-2.0.", ["Apache-2.0", "MIT"]),
        ("This crate is licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Licensed under the ISC License.", ["ISC"]),
        ("Licensed under the EUPL-1.2.", ["EUPL"]),
        ("This program is made available under the terms of the Eclipse Public License v2.0.", ["EPL"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Permission is granted to copy this document under the terms of the GNU Free Documentation License.", ["GFDL"]),
        ("This work is in the public domain.", ["public domain"]),
        ("The GPL was discussed by MIT students who licensed nothing.", []),
        ("The Apache landed near the license office.", []),
        ("Students at MIT wrote about the history of the GNU project.", []),
        ("The public library is free to all people of the town.", []),
        ("Ich gehe mit dir.", []),
        ("", []),
        (None, []),
    ],
)
def test_families(text, want):
    assert families(text) == want


def test_notice_in_a_long_paragraph_and_in_a_long_text():
    text = "\n\n".join([PLAIN * 200, PLAIN * 100 + "\nReleased under the MIT License.\n" + PLAIN * 100, "All rights reserved."])
    assert [(k, f, line) for k, f, _, _, line in li.scan_texts([text], li.model())[0]] == [(1, "MIT", 2), (2, "proprietary", 6)]


def test_the_surest_window_of_a_paragraph_counts():
    low, high = "Published under GPL or so they said", "Licensed under the GNU General Public License, version 3."
    alone = li.scan_texts([high], li.model())[0][0][2]
    both = li.scan_texts([low + " " + PLAIN * 9 + high + " " + PLAIN * 9 + low], li.model())[0]
    assert [x[1] for x in both] == ["GPL"] and both[0][2] >= 0.9 * alone


def test_any_cut_of_the_work_gives_the_same():
    texts = [MIT, None, "", PLAIN * 50 + GPL + PLAIN * 50, "x\n\n\ny\n \nAll rights reserved.\n", PLAIN * 400]
    whole = li.scan_texts(texts, li.model())
    assert whole == [li.scan_texts([t], li.model())[0] for t in texts] == li.scan_texts(texts, li.model(), at_once=3)


def plain_logits(m, tokens):
    """Every n-gram of one window by its words."""
    base, number = len(m.vocabulary.words) + 2, m.vocabulary.words.get
    marks = set(li.MARKS)
    keys = []
    for masked in (False, True):
        names = [masked and t in marks for t in tokens]
        w = [1 if name else number(t, 0) for t, name in zip(tokens, names, strict=True)]
        for i in range(len(w)):
            for n in (1, 2, 3):
                run = w[i : i + n]
                mixed = any(names[i : i + n]) and not all(names[i : i + n])
                if len(run) == n and all(run) and (mixed if masked else True):
                    keys.append(sum(x * base**k for k, x in enumerate(run)))
    grams = {int(g): i for i, g in enumerate(m.vocabulary.grams)}
    slots = [grams[k] for k in keys if k in grams]
    return m.bias + sum((m.weights[s] for s in slots), np.zeros(len(m.families)))


def test_windows_score_as_a_plain_sum_of_their_ngrams():
    m = li.model()
    for text in (MIT, GPL, "Dual licensed under MIT or Apache-2.0.", PLAIN, "gnu gnu gnu", "zzz"):
        tokens = li.words_of(text)
        got = m.logits(m.vocabulary.numbers(tokens), np.array([0]), np.array([len(tokens)]))[0]
        assert np.allclose(got, plain_logits(m, tokens), atol=1e-9)


def test_corpus_negatives_are_learnt(spark, make):
    odd = "licensed under the tables of the apache valley " * 3
    m = li.fit(make([(i, f"{odd} {i}", "a") for i in range(30)] + [(99, "Licensed under the Apache License 2.0. " * 5, "a")]))
    assert m.probabilities(li.words_of(odd)[:16])["unknown"] > 0.9
    assert families("Licensed under the Apache License 2.0.", m) == ["Apache-2.0"]


def test_odd_documents(spark, make, odd_rows):
    got = li.scan(make([*odd_rows, (50, "x\n\nAll rights reserved.", "s")])).collect()
    assert len(got) == len(odd_rows) + 1
    assert [(r.doc_id, r.family, r.paragraph, r.line, r.n_found) for r in got if r.n_found] == [(50, "proprietary", 1, 2, 1)]
    assert li.scan(make([])).count() == 0
