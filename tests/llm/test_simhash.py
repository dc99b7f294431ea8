import random
import re

import numpy as np
import pytest
import xxhash

from lorebed.llm import simhash


def plain_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_fingerprints_match_a_plain_version(odd_rows):
    for _, text, _ in odd_rows:
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_links_lose_no_component(spark, block):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds[:20]:
        for _ in range(12):  # near copies at 1 to 6 bits, and copies of copies
            x = s
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
            fps.add(x ^ (1 << rnd.randrange(64)))
    dense = seeds[0]
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(a, 32)}  # one large bucket
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(df, simhash.Bits(), block)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == brute_components(fps)


def test_links_within_four_bits_only():
    with pytest.raises(ValueError):
        simhash.Bits(distance=5)


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(50)], "u long, v long")
    roots = simhash.components(links).collect()
    assert len(roots) == 401 + 51
    assert len({r.root for r in roots}) == 2


def test_odd_documents(spark, make, odd_rows):
    got = simhash.near_duplicates(make(odd_rows), simhash.Bits()).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for g in got:
        by.setdefault(g.doc_id, set()).add(g.component_id)
    assert by[1] == by[2] == {1}
    assert by[3] == by[4] == by[5] == {3}  # no words: linked by fingerprint zero
    assert by[6] == {6}
    assert simhash.near_duplicates(make([]), simhash.Bits()).count() == 0


@pytest.mark.parametrize("scheme", [simhash.Bits(), simhash.Similar()])
def test_keep_one_leaves_one_of_each_group(spark, make, odd_rows, scheme):
    docs = make(odd_rows)
    kept = simhash.keep_one(docs, scheme)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r.doc_id in (1, 2) for r in rows) == 1
    assert sum(r.doc_id in (3, 4, 5) or (r.doc_id is None and r.text is None) for r in rows) == 1
    assert {r.text for r in rows if r.doc_id == 7} == {t for i, t, _ in odd_rows if i == 7}
    assert simhash.keep_one(make([]), scheme).count() == 0


def test_spanning_links_connect_blocks():
    fps = np.array([0, 1, 3, 7, 15, 31, 0x3FF << 40], dtype=np.uint64)[:, None]
    whole = simhash.spanning_links(fps, None, 2)
    assert len(whole) == 5
    across = simhash.spanning_links(fps[:3], fps[3:], 2)
    assert all((a < 3) != (b < 3) for a, b in across)


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(rnd, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return out


def test_texts_that_are_alike_link_and_others_do_not(spark, make):
    rnd = random.Random(7)
    rows, pairs = [], {}
    for k in range(220):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([120, 200, 400]))]
        copy = edited(rnd, words, rnd.randint(1, max(1, len(words) // 12)))
        pairs[10 * k] = jaccard(" ".join(words), " ".join(copy))
        rows += [(10 * k, " ".join(words), "a"), (10 * k + 1, " ".join(copy), "b")]
    # texts that share a passage of 60 words of 200, and a family of near copies of one text
    passage = [f"p{i}" for i in range(60)]
    rows += [(5000 + k, " ".join([f"u{rnd.randrange(10**6)}" for _ in range(140)] + passage), "c") for k in range(40)]
    base = [f"f{i}" for i in range(300)]
    rows += [(6000 + k, " ".join(edited(rnd, base, 2)), "d") for k in range(150)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows), simhash.Similar(), block=64).collect()}
    assert np.mean([got[i] == got[i + 1] for i, j in pairs.items() if j >= 0.9]) == 1
    assert np.mean([got[i] == got[i + 1] for i, j in pairs.items() if 0.8 <= j < 0.9]) >= 0.9
    assert np.mean([got[i] == got[i + 1] for i, j in pairs.items() if j < 0.55]) <= 0.1
    assert all(got[5000 + k] == 5000 + k for k in range(40))
    assert {got[6000 + k] for k in range(150)} == {6000}
    assert len(set(got.values())) >= 220 + 40 + 1  # no two of the texts themselves are one


def test_wide_links_are_those_of_a_plain_comparison(spark, make):
    rnd = random.Random(9)
    base = [f"f{i}" for i in range(200)]
    rows = [(k, " ".join(edited(rnd, base, rnd.randint(0, 12))), "d") for k in range(120)]
    scheme = simhash.Similar()
    marked = simhash.fingerprints(make(rows), scheme).collect()
    fps = {r.doc_id: int.from_bytes(r.fp, "little") for r in marked}
    keys = {r.doc_id: {s ^ sum(m for m, on in zip(masks, f"{j:03b}", strict=True) if on == "1") for s, masks in zip(r.segments, r.soft, strict=True) for j in range(8)} for r in marked}
    for r in marked:  # what is filed is what the fingerprint says
        assert [s & (1 << 25) - 1 for s in r.segments] == [fps[r.doc_id] >> 25 * k & (1 << 25) - 1 for k in range(10)]
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and keys[a] & keys[b] and (fps[a] ^ fps[b]).bit_count() <= scheme.distance:
                root[find(b)] = find(a)
    smallest = {}
    for i in sorted(fps):
        smallest.setdefault(find(i), i)
    for block in (1 << 16, 20):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows), scheme, block).collect()}
        assert got == {i: smallest[find(i)] for i in fps}


def test_the_wide_limit():
    assert simhash.Similar().distance == 48 and simhash.Similar(similarity=0.9).distance < 36
