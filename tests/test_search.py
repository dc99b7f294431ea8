import random

import pytest
from pyspark.sql import functions as F

from lorebed.operators import search

COLUMNS = "doc_id long, source string, title string, content string, url string, score double, original_score double, pos int"


def hits(spark, rows):
    full = [(i, s, f"t{i}", "some text", None, float(x), float(x), k + 1) for k, (i, s, x) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def plain_diversity(rows, per_source=2, results=5):
    """Round by round: each source's next best, the best of a round first, at most ``per_source``; then by score."""
    if len(rows) <= results:
        return [i for i, _, _ in rows]
    by = {}
    for k, (i, s, x) in enumerate(rows):
        by.setdefault(s, []).append((x, -k, i))
    for own in by.values():
        own.sort(reverse=True)
    out = []
    for r in range(per_source):
        turn = [(own[r][0], s) for s, own in by.items() if len(own) > r]
        turn.sort(key=lambda t: -t[0])
        out += [by[s][r][2] for _, s in turn]
    rest = sorted(((x, k, i) for own in by.values() for x, k, i in own if i not in out[:results]), reverse=True)
    out = out[:results]
    return out + [i for _, _, i in rest][: results - len(out)]


def test_diversity_matches_a_step_by_step_version(spark):
    rnd = random.Random(11)
    for _ in range(12):
        rows = [(i, rnd.choice("abc"), rnd.choice([1, 2, 3])) for i in range(rnd.randint(1, 14))]
        got = [r.doc_id for r in search.diversity_cut(hits(spark, rows)).orderBy("pos").collect()]
        assert got == plain_diversity(rows), rows


@pytest.mark.parametrize(
    "query,scores,want",
    [
        ("water pump", [0.5, 0.2, 0.1], [0, 1]), ("water pump", [0.15, 0.13, 0.05], [0, 1, 2]), ("water pump", [0.11, 0.1], []),
        ("help", [0.4, 0.32], [0]), ("help me", [0.2], []), ("water pump", [], []),
    ],
)
def test_quality(spark, query, scores, want):
    cut = search.quality_cut(hits(spark, [(i, "a", x) for i, x in enumerate(scores)]), query)
    assert sorted(r.doc_id for r in cut.collect()) == want


def test_rerank(spark):
    types = spark.createDataFrame([(0, "academic"), (1, "guide")], "doc_id long, doc_type string")
    got = search.rerank(hits(spark, [(0, "a", 0.9), (1, "a", 0.8), (2, "a", 0.7)]).drop("original_score"), types).orderBy("pos").collect()
    assert [(r.doc_id, r.doc_type) for r in got] == [(1, "guide"), (0, "academic"), (2, "article")]
    assert [round(r.score, 2) for r in got] == [0.95, 0.85, 0.65]


def test_keyword(spark):
    docs = spark.createDataFrame([(1, "a", "Pump water", "pump pump"), (2, "a", "x", "aaaa pump"), (3, "b", "pump", ""), (4, "a", None, None)], "doc_id long, source string, title string, content string")
    got = [(r.doc_id, round(r.score, 3)) for r in search.keyword_top(docs, "PUMP", 5).collect()]
    assert sorted(got) == [(1, 1.0), (2, round(1 / 7, 3)), (3, round(5 / 7, 3))]
    assert search.keyword_top(docs, "pump", 5, []).count() == 0
    assert [r.doc_id for r in search.keyword_top(docs, "pump", 5, ["b"]).collect()] == [3]
    assert search.keyword_top(docs, "aa", 5).first().doc_id == 2


def test_filter_reaches_the_scan(spark, small, capsys):
    from lorebed.sources.tables import corpus

    search.keyword_top(corpus(spark, small), "that", 5, ["src1"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(source" in plan or "EqualTo(source,src1)" in plan
    assert "TakeOrderedAndProject" in plan


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [3.0, 4.0], "b")], "id long, embedding array<float>, source string")
    assert [(r.id, r.score) for r in search.vector_top(v, [0.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.5)]
    assert [r.id for r in search.vector_top(v, [0.0, 0.0], 1, keep=F.col("source") == "b").collect()] == [2]
    assert [r.id for r in search.similar_to(v, 1, 5).orderBy("pos").collect()] == [2, 3]
    assert search.similar_to(v, 99, 5).count() == 0


def test_sources():
    known = ["alpha", "beta", "wiki"]
    assert search.resolve_sources(known) == (None, [])
    assert search.resolve_sources(known, only=[]) == ([], [])
    assert search.resolve_sources(known, only=["wiki"]) == (["wiki"], [])
    chosen, notes = search.resolve_sources(known, only=["wikki"])
    assert chosen is None and "nearest is 'wiki'" in notes[0] and len(notes) == 2
    assert search.resolve_sources(known, exclude=["wiki"])[0] == ["alpha", "beta"]
    assert search.resolve_sources(known, "none", include=["wiki"])[0] == ["wiki"]
    assert search.resolve_sources(known, "none") == (None, [])
    chosen, notes = search.resolve_sources(known, exclude=["wiki"], include=["wiki"])
    assert chosen is None and "excluded and included" in notes[0]
    assert search.resolve_sources(known, "odd")[0] is None and "'odd'" in search.resolve_sources(known, "odd")[1][0]
    assert search.resolve_sources(known, exclude=known) == ([], [])
    assert search.resolve_sources(known, "none", include=known)[0] == known
    assert search.resolve_sources(known, "none", include=["alfa", "beta"])[0] == ["beta"]
    assert search.resolve_sources(known, exclude=["gone"], include=["gone"])[1] == ["'gone' is excluded and included; it is searched.", "No source is called 'gone' (included)."]


def test_intent_and_generic(spark):
    rows = [("how to build a pump", "guide", False), ("where to buy a pump", "product", False), ("research on pumps", "academic", False), ("what is a pump", "article", False), ("pumps", None, False), ("help", None, True), ("please,  HELP me", None, True), ("help me find water now", None, False)]
    got = spark.createDataFrame(rows, "m string, i string, g boolean").select("m", "i", "g", search.intent(F.col("m")).alias("a"), search.is_generic(F.col("m")).alias("b")).collect()
    assert all(r.i == r.a and r.g == r.b for r in got)
    assert all(search.intent_text(m) == i and search.is_generic_text(m) == g for m, i, g in rows)
