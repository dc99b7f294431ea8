import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebed.llm import neighbours

KIND = "vec_id long, embedding array<float>, label int, q string, rep string, t string, bucket string, ids string"


def brute(rows, k=10):
    """query -> [(vec_id, distance)] over the rows that take part."""
    own = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for i, v in own:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in own if j != i)
            out[i] = near[:k]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, *"xxxxx") for i, v in rows], KIND)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("block,ask", [(50_000, 16_384), (50, 16_384), (50, 2), (50_000, 2)])
def test_recall_and_exact_scores(spark, block, ask):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 16)) * 0.5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = search(spark, rows, sample=400, block=block, ask=ask), brute(rows)
    assert set(got) == set(want)
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    scores = {(q, j): d for q in want for d, j in brute([r for r in rows], 1500)[q]}
    for q in got:
        assert all(abs(d - scores[q, j]) < 1e-12 for d, j in got[q])
        assert got[q] == sorted(got[q])


def test_equal_vectors_and_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 400)] + [(1000, [0.0, 1.0]), (1001, [0.0, -1.0]), (1002, [-1.0, 0.0])]
    got = search(spark, rows)
    assert [j for _, j in got[0]] == list(range(1, 11))
    assert [j for _, j in got[300]] == list(range(10))
    assert [d for d, _ in got[100]] == [0.0] * 10


def test_odd_vectors_take_no_part(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (200, None), (7, [1.0])]
    rows = [(0, [1.0, 2.0]), (8, [1.0, 2.5]), (9, [3.0, 2.0]), *odd]
    assert search(spark, rows) == {0: [(0.5, 8), (2.0, 9)]}
    assert search(spark, odd) == {}
    assert search(spark, []) == {}


def test_probes_go_from_likely_to_unlikely():
    h = neighbours.Hashes(4, 1.0, 2, 4, 24)
    steps = h._steps(np.array([0.1, 0.5, 0.9, 0.4]))
    assert steps[0] == 0 and steps[1] == -h.mix[0] or steps[1] == h.mix[2]
    assert len(set(steps.tolist())) == 24


def test_outliers_and_sparse_clusters_get_whole_results(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)) * 0.01
    x[0], x[100], x[200] = 500.0, -300.0, [900.0, *[-70.0] * 7]  # alone, each far from all
    x[300:306] = np.arange(1, 9) * 40.0 + rng.normal(size=(6, 8)) * 5  # fewer than k, far from all others
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = search(spark, rows, sample=400, block=300, ask=2), brute(rows)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    for q in (0, 100, 200, 300):
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-6, atol=0)


def test_tiny_table_gives_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1000.0, 0.0]), (2, [0.0, -50_000.0]), (3, [1e6, 1e6])]
    assert [j for _, j in search(spark, rows)[0]] == [1, 2, 3]


def test_exact_where_no_width_reaches_the_recall(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(600, 32)))]
    got, want = search(spark, rows, sample=300, tables=1, probes=1, recall=1.01), brute(rows)
    assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in want.items()}
