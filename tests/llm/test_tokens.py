import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lorebed.llm import packing, token_store
from lorebed.llm.token_store import EliasFano
from lorebed.llm.tokens import UnitEncoder, default_vocabulary


@pytest.fixture(scope="module")
def coder():
    return UnitEncoder(default_vocabulary(), memory=500)


def ids_of(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_units_give_the_ids_of_whole_texts(coder):
    rnd = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", "!", "ß", " ", "²", "中", "\x1c", "word", "\r\n", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)] + ["x" * 5000, "ab " * 3000]
    theirs = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ours = [np.frombuffer(x, coder.dtype).tolist() for at in range(0, len(texts), 500) for x in coder.encode(texts[at : at + 500])]
    assert ours == theirs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(steps, dtype=np.int64) if steps else np.zeros(0, dtype=np.int64)
    made = EliasFano(EliasFano.encode(values).data)
    assert made.values().tolist() == values.tolist()
    assert [made.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        made.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    assert len(EliasFano.encode(ends).data) < 5000 * 2  # under 16 bits a value, against 64


def spark_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def test_an_id_of_many_rows_is_split(spark, make, tmp_path):
    path, key = f"{tmp_path}/tokens", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # so little would be one shard
    token_store.write_tokens(make([(1, "same words", "a")] * 3000 + [(2, "other", "b")]).repartition(3), path, default_vocabulary())
    spark.conf.unset(key)
    got = token_store.read_tokens(spark, path)
    assert got.count() == 3001 and got.orderBy("start").tail(1)[0].doc_id == 2
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("shard").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "count").collect()]
    assert len(sizes) > 1 and max(sizes) < 2000


@pytest.mark.parametrize("block_ids", [64, 1 << 17])
def test_files_give_back_every_document(spark, make, odd_rows, coder, tmp_path, block_ids):
    path = f"{tmp_path}/tokens"
    token_store.write_tokens(make(odd_rows), path, default_vocabulary(), 2, block_ids)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    at = 0
    assert len(got) == len(rows)
    for g, (doc_id, text, _) in zip(got, rows, strict=True):
        ids = ids_of(coder, text)
        assert (g.doc_id, g.start, g.n_tokens) == (doc_id, at, len(ids))
        assert np.frombuffer(g.ids, f"<u{g.width}").tolist() == ids
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_tables(spark, make):
    assert token_store.document_ids(make([]), default_vocabulary()).count() == 0
    assert packing.pack(make([]), default_vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_places_every_item(sizes):
    place, offset, fill = packing.best_fit(np.array(sizes, dtype=np.int64), 64)
    used = {}
    for b, o, s in sorted(zip(place.tolist(), offset.tolist(), sizes, strict=True)):
        assert o == used.get(b, 0)
        used[b] = o + s
    assert [used[b] for b in range(len(fill))] == fill.tolist()
    assert all(x <= 64 for x in fill)
    assert sum(x <= 32 for x in fill) <= 1  # two that are half empty would have been one


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_best_fit_of_counts_is_best_fit_of_the_items(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs = packing.best_fit_counts(counts, 64)
    assert sorted(f for run, f in runs for _ in range(run.n)) == sorted(packing.best_fit(np.array(sizes, dtype=np.int64), 64)[2].tolist())
    items = [(s, first + i) for run, _ in runs for s, first, _ in run.slots for i in range(run.n)]
    assert sorted(items) == sorted((s, i) for s, n in counts.items() for i in range(n))  # each item once
    for run, fill in runs:
        at = 0
        for size, _, offset in run.slots:
            assert offset == at
            at += size
        assert at == fill <= 64


def plain_best_fit(lengths, capacity=1024):
    """Number of sequences of best fit, largest first, over all pieces at once."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check_packed(got, rows, coder):
    """Every piece with its ids, gapless, none too long; returns the number of sequences and the lengths."""
    want = []
    for doc_id, text, _ in rows:
        ids = np.array(ids_of(coder, text), "<u4")
        want += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=repr) == sorted(want, key=repr)
    fill = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == fill.get(g.sequence_id, 0)
        fill[g.sequence_id] = g.offset + g.length
    assert max(fill.values()) <= 1024
    return len(fill), [g.length for g in got]


@pytest.mark.parametrize("tasks,fan_in,at_once", [(1, 16, 200_000), (1, 16, 40), (9, 2, 200_000), (9, 3, 25), (40, 3, 200_000)])
def test_packing_is_whole_and_as_tight_as_plain_best_fit(spark, make, odd_rows, coder, tasks, fan_in, at_once):
    rnd = random.Random(tasks)
    rows = odd_rows + [(100 + i, "several words " * rnd.randint(0, 400), "z") for i in range(400)]
    got = packing.pack(make(rows).repartition(tasks), default_vocabulary(), fan_in=fan_in, at_once=at_once).collect()
    sequences, lengths = check_packed(got, rows, coder)
    assert sequences <= 1.01 * plain_best_fit(lengths) + 1


def test_many_underfull_sequences_meet_their_fillers(spark, make, coder):
    """Tasks full of pieces that fit with nothing of their own task, and their fillers elsewhere."""
    rows = [(i, "a " * 650, "hot") for i in range(240)] + [(1000 + i, "a " * 340, "other") for i in range(240)]
    got = packing.pack(make(rows).repartitionByRange(12, "doc_id"), default_vocabulary(), fan_in=2).collect()
    sequences, lengths = check_packed(got, rows, coder)
    mixed = spark.createDataFrame([(g.sequence_id, g.doc_id < 1000) for g in got], "s long, big boolean").groupBy("s").agg({"big": "max"}).count()
    assert mixed == sequences and sequences < 480
