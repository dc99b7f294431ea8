import zlib

import numpy as np
import pytest

from lorebed.llm import quality as qu
from lorebed.sources.tables import table


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = qu.FactorisationMachine(0.3, rng.normal(size=qu.WIDTH).astype(np.float32), rng.normal(size=(qu.WIDTH, qu.RANK)).astype(np.float32) * 0.1)
    slots, x = np.array([3, 50, 700, 9000]), np.array([0.5, -1.0, 0.25, 2.0])
    z = m.bias + m.linear[slots] @ x
    z += sum((m.factors[a] @ m.factors[b]) * x[i] * x[j] for i, a in enumerate(slots) for j, b in enumerate(slots) if i < j)
    assert m.scores([(slots, x)])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_interactions_are_learnt():
    """Two features together mean good, each alone bad: no linear model tells them."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        slots = np.array(sorted({10 + a, 20 + b, 30 + int(rng.integers(0, 5))}))
        rows.append((slots, np.ones(len(slots))))
        labels.append(float(a == b))
    m = qu.FactorisationMachine.fit(rows[:2500], np.array(labels[:2500]), epochs=40)
    assert ((m.scores(rows[2500:]) >= 0.5) == np.array(labels[2500:])).mean() > 0.95


def test_held_out_accuracy(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    scored = {r.doc_id: r.score for r in qu.score(docs, qu.train(docs, labels)).collect()}
    own = [(scored[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(scored) == docs.count()
    assert np.mean([(s >= 0.5) == bool(q) for s, q in own]) >= 0.9


def test_held_out_rows_teach_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.when(qu.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    a, b = qu.train(docs, labels, 60), qu.train(docs, flipped, 60)
    assert (a.linear == b.linear).all() and a.bias == b.bias


def test_an_id_of_many_rows_teaches_once(spark, make):
    good, bad = "a fine text of many plain words", "!!! $$$ buy buy buy !!!"
    rows = [(i, f"{good if i % 2 else bad} {i}", "a") for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows] * 2, "doc_id long, quality int")
    first = rows[0]
    once, often = qu.train(make(rows), labels), qu.train(make(rows + [first] * 500).repartition(7), labels)
    assert (once.linear == often.linear).all() and once.bias == often.bias
    several = qu.train(make(rows + [(first[0], f"{good} {k}", "a") for k in range(500)]), labels)
    assert len(rows) >= 20 and several.bias == pytest.approx(once.bias, abs=1.0)


def test_odd_documents(spark, make, odd_rows):
    docs = make(odd_rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = qu.train(docs, labels)
    got = qu.score(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = qu.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = qu.train(docs, labels.limit(0))
    assert {r.score for r in qu.score(docs, none).collect()} == {0.5}
    assert qu.score(make([]), model).count() == 0
