import hashlib
import random
import re

import pytest

from lorebed.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Clamp and share again until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free = {}, set(names)
    left = sum(sizes.values())
    while free:
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > epochs * sizes[n]}
        if not over:
            target |= {n: weight[n] * level for n in free}
            break
        for n in over:
            target[n] = epochs * sizes[n]
            left -= target[n]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 7, 50, 1000, 20_000]) for i in range(rnd.randint(1, 12))} | ({None: 9} if seed % 2 else {})
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, (1.0, 2.0, 3.0), 3.0).collect()}
    want = plain_targets(sizes)
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets_and_reruns_agree(spark, make):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice("aaaaab")) for i in range(1500)] + [(9000 + i, "w w w", "c") for i in range(30)]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)  # some document fits almost exactly
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.repeats for r in got)


@pytest.mark.parametrize(
    "rows",
    [
        [(None, f"w{i} " * 100, "a") for i in range(50)],  # null ids
        [(7, "w " * 100, "a")] * 50,  # one row, many times
        [(7, f"w{i % 3} " * (100 + i % 3), "a") for i in range(50)],
        [(i, "w " * 100, "a") for i in range(50)],
    ],
)
def test_targets_are_met_whatever_the_ids(spark, make, rows):
    rows = rows + [(1000 + i, "v " * 100, "b") for i in range(50)] + [(2000, "x", "c")]
    docs = make(rows).repartition(5)
    got = mixing.mix(docs).collect()
    taken, target, most = {}, {}, {}
    for r in got:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        most[r.source] = max(most.get(r.source, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 for s in taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr)
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns
    words = {}
    for r in repeated.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: n for s, n in taken.items() if n}


def test_rows_repeat_as_a_plain_version_says(spark, make, odd_rows, tmp_path):
    """Rows in order of MD5 until the target is met, then the one that comes nearest."""
    rows = [*odd_rows, *odd_rows[:3], *[(20 + i, "w " * (i % 13), "abc"[i % 3]) for i in range(90)]]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    key = lambda r: hashlib.md5(":".join(["42", *[str(x) for x in r[:2] if x is not None]]).encode()).hexdigest()
    sums = {}
    for r in rows:
        sums[r[2]] = sums.get(r[2], 0) + size(r)
    want = []
    for s, goal in plain_targets(sums).items():
        own = sorted((r for r in rows if r[2] == s), key=key)
        whole = int(goal // sums[s]) if sums[s] else 0
        missing, more, k = goal - whole * sums[s], [], 0
        while k < len(own) and missing > 0 and size(own[k]) <= missing:
            more.append(own[k])
            missing -= size(own[k])
            k += 1
        left = [r for r in own[k:] if size(r)]
        if missing > 0 and left:
            best = min(left, key=lambda r: (abs(missing - size(r)), key(r)))
            if abs(missing - size(best)) < missing:
                more.append(best)
        want += [r for r in own if size(r) for _ in range(whole)] + [r for r in more if size(r)]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/docs")
    for given in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        got = [(r.doc_id, r.text, r.source) for r in mixing.repeat_rows(given).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_documents(spark, make, odd_rows):
    got = mixing.mix(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.taken == 0 for r in got if not r.size)
    assert mixing.mix(make([])).count() == 0 and mixing.repeat_rows(make([])).count() == 0
    empty = mixing.mix(make([(1, "", "a"), (2, None, "b")])).collect()
    assert [r.target for r in empty] == [0.0, 0.0]


def test_no_python_in_the_plan(spark, make, odd_rows, capsys):
    mixing.mix(make(odd_rows)).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Pandas", "InArrow"))
