"""Archives, papers, models, fallbacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebed.functions import web
from lorebed.operators import models, papers, search, validate
from lorebed.sources import archives
from lorebed.streaming import ingest as stream


def test_headers_and_sections():
    text = "1\nProgram Overview\n" + "body " * 60 + "\n1.1 Scope of work\n" + "more " * 60 + "\n2.1 Listed ....... 5\nAppendix A: Tables\n" + "rest " * 60
    assert [(n, t, level) for _, n, t, level in papers.headers(text)] == [("1", "Program Overview", 1), ("1.1", "Scope of work", 2), ("Appendix A", "Tables", 1)]
    got = papers.sections([text])
    assert [g[0] for g in got] == ["1 Program Overview", "1 Program Overview > 1.1 Scope of work", "Appendix A Tables"]
    assert papers.headers("1999\nToo large a number\nPage | 3") == [] and papers.sections([]) == []


def test_paper_parts(spark):
    text = "Journal of Things\nA study of small pumps\nAbstract: " + "We test pumps in water. " * 8 + "\nKeywords: pumps, water; wells\nIntroduction\nText"
    got = papers.parts(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].title == "A study of small pumps" and got[0].abstract.startswith("We test") and got[0].keywords == ["pumps", "water", "wells"]
    assert (got[1].title, got[1].abstract) == ("", "")


def flaky():
    """A model that fails on batches, and on one text for good."""

    class Flaky:
        dimension = 2

        def embed(self, texts):
            if len(texts) > 1 or texts == ["bad"]:
                raise RuntimeError
            return np.ones((1, 2), dtype=np.float32)

    return Flaky


def test_embedding_falls_back_to_single_texts_and_zeros(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.embedding for r in models.embed(docs, flaky()).collect()} == {1: [1.0, 1.0], 2: [0.0, 0.0], 3: [1.0, 1.0]}
    own = models.embed(docs, models.Hashing).collect()
    assert all(len(r.embedding) == 64 for r in own)


def test_translation_uses_its_cache_and_skips_numbers(spark):
    texts = spark.createDataFrame([("hello world",), ("12.3.2024",), ("good day",), ("good day",)], "text string")
    cache = spark.createDataFrame([("hello world", "hallo welt")], "source_text string, translated string")
    got = models.translate(texts, cache, lambda: lambda own: [t.upper() for t in own]).collect()
    assert sorted((r.text, r.translated) for r in got) == [("12.3.2024", "12.3.2024"), ("good day", "GOOD DAY"), ("good day", "GOOD DAY"), ("hello world", "hallo welt")]


def test_search_falls_back_to_keywords(spark):
    docs = spark.createDataFrame([(1, "a", "pump", "water pump"), (2, "b", "x", "other words")], "doc_id long, source string, title string, content string")
    own = models.embed(docs.select("doc_id", F.col("content").alias("text")), models.Hashing)
    vectors = own.join(docs.select("doc_id", "source"), "doc_id").withColumnRenamed("doc_id", "id")
    assert search.search_with_fallback(docs, "water pump", 1, None, vectors, models.Hashing()).first().doc_id == 1
    assert search.search_with_fallback(docs, "water pump", 1, ["b"], vectors, models.Hashing()).first().doc_id == 2
    assert search.search_with_fallback(docs, "pump", 5, None, None).first().doc_id == 1
    assert search.search_with_fallback(docs, "pump", 5, None, vectors.limit(0), models.Hashing()).first().doc_id == 1


@pytest.mark.parametrize("message,want", [("more like #3", 3), ("show me something similar to 2", 2), ("more like this", 1), ("how to build", None)])
def test_similarity_requests(message, want):
    assert search.similarity_request(message) == want


def test_published(spark):
    listing = spark.createDataFrame([("a/x",), ("a/y",), ("b/z",)], "key string")
    master = spark.createDataFrame([("m",)], "source_id string")
    assert {r.source_id for r in archives.published(master, listing).collect()} == {"m"}
    assert {r.source_id for r in archives.published(master.limit(0), listing).collect()} == {"a", "b"}


def test_binary_files_by_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    got = archives.read(spark, str(tmp_path), "*.pdf", lambda path, data: [(path.rsplit("/", 1)[1], i, t.decode()) for i, t in enumerate(data.split(b"\f"))], "pdf string, page int, text string")
    assert sorted(map(tuple, got.collect())) == [("a.pdf", 0, "one"), ("a.pdf", 1, "two")]


def test_localisable(spark):
    rows = [("a", "en", None, True, True), ("a_es", "es", "a", True, True), ("b", "en", None, True, True), ("c", "en", None, True, False)]
    sources = spark.createDataFrame(rows, "source_id string, language string, parent_source string, has_metadata boolean, has_backup boolean")
    assert {r.source_id: r.can_localise for r in validate.localisable(sources, "es").collect()} == {"a": False, "a_es": False, "b": True, "c": False}


def test_html_rewrites(spark):
    html = '<a href="/x">1</a><img src="//cdn/y"><script src="https://www.google-analytics.com/a.js"></script><script>gtag("x")</script><script>keep()</script>'
    row = spark.createDataFrame([(html,)], "h string").select(web.localise_links(F.col("h"), F.lit("s")).alias("a"), web.without_trackers(F.col("h")).alias("b")).first()
    assert 'href="/local/s/x"' in row.a and 'src="//cdn/y"' in row.a
    assert row.b == '<a href="/x">1</a><img src="//cdn/y"><script>keep()</script>'


def test_failures_in_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:01:00", "error"), (1, "2024-01-01 00:04:00", "error"), (1, "2024-01-01 00:06:00", "error"), (1, "2024-01-01 00:02:00", "view")], "user_id long, ts string, event_type string")
    got = stream.failures(events.withColumn("ts", F.to_timestamp("ts"))).orderBy("since").collect()
    assert [r.failures for r in got] == [2, 1]


def test_wiki_assets(spark):
    got = spark.createDataFrame([("_mw_/a.css",), ("plain.css",), ("_assets_/h/i.png",)], "u string").select(web.wiki_asset_candidates(F.col("u")).alias("c")).collect()
    assert got[0].c[:3] == ["_mw_/a.css", "-/mw/a.css", "-/a.css"] and got[1].c == ["plain.css"]
    assert {"I/h/i.png", "I/m/h/i.png", "I/i.png", "i.png"} <= set(got[2].c)


def test_dois_reads_whole_texts(spark, tmp_path):
    from lorebed import queries

    rows = [(1, "words " * 50 + "see 10.5555/far.away, and so on"), (2, "no such thing"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.doi for r in queries.dois(spark, str(tmp_path)).collect()}
    assert got == {1: "10.5555/far.away", 2: "10.1234/ab.2", 3: "10.1234/ab.3"}
