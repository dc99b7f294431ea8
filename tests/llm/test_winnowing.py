import hashlib
import random

import numpy as np
import pytest

from lorebed.llm import winnowing as wi


def plain_winnow(text, k, w):
    codes = [ord(c) for c in text]
    if not codes:
        return [], []
    k = min(k, len(codes))

    def hashed(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + c + 1) % (1 << 64)
        return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32

    hashes = [hashed(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    w, chosen = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [hashes[i] for i in chosen], chosen


@pytest.mark.parametrize("k,w", [(24, 40), (3, 5), (1, 1), (7, 8)])
def test_winnow_matches_a_plain_version(k, w):
    rnd = random.Random(k)
    for n in [*range(0, 70), 300, 700]:
        text = "".join(rnd.choice("ab é中") for _ in range(n))
        hashes, positions = wi.winnow(text, k, w)
        assert (hashes.tolist(), positions.tolist()) == tuple(plain_winnow(text, k, w))


def test_shared_runs_share_a_hash():
    rnd = random.Random(9)
    words = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = words(wi.GRAM + wi.WINDOW - 1)
        a, b = words(200) + shared + words(100), words(77) + shared + words(300)
        assert set(wi.winnow(a)[0].tolist()) & set(wi.winnow(b)[0].tolist())


def test_long_texts_are_read_in_stretches():
    text = "".join(random.Random(1).choices("abcdef ", k=(1 << 20) + 500))
    hashes, positions = wi.winnow(text)
    assert (np.diff(positions) > 0).all() and (np.diff(positions) <= wi.WINDOW).all()
    tail_hashes, tail = wi.winnow(text[(1 << 20) - 300 :])
    known = dict(zip(positions.tolist(), hashes.tolist(), strict=True))
    inner = [(p + (1 << 20) - 300, h) for p, h in zip(tail.tolist(), tail_hashes.tolist(), strict=True) if p > wi.WINDOW]
    assert all(known[p] == h for p, h in inner)


def test_likeness():
    a, b = np.array([1, 2, 3]), np.array([2, 3, 3, 4])
    assert wi.likeness(a, b) == 0.5
    assert wi.likeness(a[:0], b[:0]) == 1.0 and wi.likeness(a, b[:0]) == 0.0


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_edit_likeness_of_odd_documents(spark, make, odd_rows, ranges):
    got = wi.edit_likeness(make(odd_rows), ranges=ranges).collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t, _ in rows]
    want = []
    for (doc_id, _, _), text, following in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, nxt = (wi.winnow(t)[0] for t in (text, changed, following))
        inside = set()
        for h, at in zip(*(x.tolist() for x in wi.winnow(text)), strict=True):
            if h in new.tolist():
                inside.update(range(at, min(len(text), at + wi.GRAM)))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((doc_id, len(text), sha, wi.digest(own), wi.digest(new), wi.likeness(own, new), wi.likeness(own, nxt), len(inside) / len(text) if text else 0.0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert wi.edit_likeness(make([])).count() == 0
    assert wi.fingerprints(make(odd_rows)).count() == len(odd_rows)
