"""Registered queries that SQL can't express, against plain versions on the whole small tables."""

import numpy as np
import pytest

from lorebed.llm import licences, quality, queries
from lorebed.llm.licences import AROUND, STEP, WINDOW
from lorebed.sources.tables import table


def plain_logits(m, tokens, start, end):
    """Every n-gram that starts in the window, by its words."""
    base, marks = len(m.vocabulary.words) + 2, set(licences.MARKS)
    grams = {int(g): i for i, g in enumerate(m.vocabulary.grams)} if not hasattr(plain_logits, "grams") else plain_logits.grams
    plain_logits.grams = grams
    z = m.bias.copy()
    for masked in (False, True):
        for i in range(start, end):
            for n in (1, 2, 3):
                run = tokens[i : i + n]
                names = [masked and t in marks for t in run]
                w = [1 if name else m.vocabulary.words.get(t, 0) for t, name in zip(run, names, strict=True)]
                if len(run) == n and all(w) and (not masked or (any(names) and not all(names))):
                    slot = grams.get(sum(x * base**k for k, x in enumerate(w)))
                    if slot is not None:
                        z += m.weights[slot]
    return z


def plain_scan(text, m, sure=0.5, alike=0.75):
    """Families by paragraph: window by window."""
    found = set()
    for k, part in enumerate(licences._BLANK.split((text or "").lower())):
        tokens = licences._TOKEN.findall(part)
        for a in range(0, max(1, len(tokens) - WINDOW + STEP), STEP) if tokens else ():
            b = min(a + WINDOW, len(tokens))
            if not any(t in m.vocabulary.words for t in tokens[a:b]):
                continue
            c, d = max(0, a - AROUND), min(len(tokens), b + AROUND)
            near, wide = (1 / (1 + np.exp(-plain_logits(m, tokens, x, y) / m.temperature)) for x, y in ((a, b), (c, d)))
            if near[-1] >= 0.5 or wide[-1] >= 0.5:
                continue
            for f, family in enumerate(m.families[:-1]):
                if min(near[f], wide[f]) >= sure and m.similarity(family, tokens[c:d]) >= alike:
                    found.add((k, family))
    return found


def test_licences(spark, small):
    docs = table(spark, small, "documents")
    m = licences.fit(docs)
    if hasattr(plain_logits, "grams"):
        del plain_logits.grams
    got = {r.doc_id: (r.families, r.n_found) for r in queries.op8_licence_scan(spark, small).collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 5_000]
    assert len(rows) > 150
    want = {r.doc_id: plain_scan(r.text, m) for r in rows}
    assert {i: got[i] for i in want} == {i: (sorted({f for _, f in x}), len({k for k, _ in x})) for i, x in want.items()}
    assert sum(bool(x) for x in want.values()) >= 3


def test_quality(spark, small):
    """Each interaction of two features by itself."""
    docs = table(spark, small, "documents")
    m = quality.train(docs, table(spark, small, "labels"))
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, small).collect()}
    for r in docs.select("doc_id", "text").collect():
        slots, x = quality.features(r.text)
        pairs = np.triu((m.factors[slots] @ m.factors[slots].T).astype(np.float64) * np.outer(x, x), 1).sum()
        score = 1 / (1 + np.exp(-(m.bias + m.linear[slots] @ x + pairs)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
