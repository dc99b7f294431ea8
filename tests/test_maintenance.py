"""Upkeep and translation, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lorebed.operators import document_types, graph, maintenance, models, sessions
from lorebed.plans import answer, config, packs
from lorebed.session import Kept
from lorebed.sources import connectors, store


def test_live_catalog_falls_back(spark):
    one, none = spark.createDataFrame([("a",)], "source_id string"), spark.createDataFrame([], "source_id string")
    old = spark.createDataFrame([("b",)], "source_id string")
    assert [tuple(r) for r in maintenance.live(one, old).collect()] == [("a", "published")]
    assert [tuple(r) for r in maintenance.live(none, old).collect()] == [("b", "cached")]


def test_installs_by_another_name(spark):
    rows = spark.createDataFrame([(1, "s")], "doc_id long, source string")
    with pytest.raises(ValueError):
        maintenance.install_into(rows, rows, "merge")


def test_cache(spark):
    kind = "language string, kind string, item_id string, text string, saved_at int"
    cache = spark.createDataFrame([("es", "article", "1", "uno", 1), ("fr", "article", "1", "un", 1)], kind)
    put = maintenance.cache_put(cache, spark.createDataFrame([("es", "article", "1", "una", 2)], kind))
    wanted = spark.createDataFrame([("es", "article", "1"), ("de", "article", "1")], "language string, kind string, item_id string")
    assert {r.language: r.text for r in maintenance.cache_get(put, wanted).collect()} == {"es": "una", "de": None}
    assert maintenance.cache_clear(put).count() == 0
    assert maintenance.cache_stats(put.limit(0)).first()["bytes"] == 0


def test_backups_without_files_fail(spark):
    rows = [("a", "zim", "x.txt", b"ZIM"), ("b", "pdf", "1.pdf", b"%PDF-1"), ("b", "pdf", "2.pdf", b"junk"), ("c", "html", "pages/x/y.HTM", None), ("d", "pdf", "1.pdf", None)]
    files = spark.createDataFrame(rows, "source_id string, backup_type string, path string, head binary")
    got = {r.source_id: (r.passed, r.issues) for r in maintenance.backup_issues(files).collect()}
    assert got == {"a": (False, ["No ZIM file"]), "b": (True, []), "c": (True, []), "d": (False, ["Not a PDF file"])}


PAGE = """<!DOCTYPE html><html><head><title>A page title</title><style>two words</style></head><body class='x'>
<nav><a href="/">home page</a></nav><p>One short   text &amp; more</p><!-- a comment here --><pre>code stays here</pre>
<div class="big infobox">a box of facts</div><p>12 34<br>v1.2.3<br/>ok</p><p>last one here"""


def test_pages_keep_their_markup():
    got = models.translated_page(PAGE, lambda texts: [t.upper() for t in texts])
    want = PAGE.replace("A page title", "A PAGE TITLE").replace("One short   text &amp; more", "ONE SHORT   TEXT &amp; MORE").replace("last one here", "LAST ONE HERE")
    assert got == want
    assert models.translated_page("", lambda t: t) == ""
    long = "word " * 300
    assert models.translated_page(f"<p>{long}</p>", lambda texts: [str(len(t)) for t in texts]) == f"<p>{models.LONGEST_TRANSLATED}</p>"


def test_texts_are_cut_before_they_are_translated(spark):
    texts = spark.createDataFrame([("word " * 300,)], "text string")
    none = spark.createDataFrame([], "source_text string, translated string")
    assert models.translate(texts, none, lambda: lambda own: [str(len(t)) for t in own]).first().translated == str(models.LONGEST_TRANSLATED)


def test_transcripts_in_english(spark):
    rows = [("v", "s1", 0.0, 1.0, "hola amigo mio", "es"), ("v", "s2", 1.0, 2.0, " ", "en"), ("v", "s3", 2.0, 3.0, "plain words", None)]
    segments = spark.createDataFrame(rows, "video_id string, segment_id string, start_sec double, end_sec double, text string, language string")
    got = sessions.in_english(segments, lambda df: df.withColumn("translated", F.upper("text")))
    assert {(r.segment_id, r.original_segment_id, r.text, r.original_language) for r in got.collect()} == {
        ("s1", "s1", "HOLA AMIGO MIO", "es"), ("s2", "s2", " ", "en"), ("s3", "s3", "plain words", "en"),
    }
    assert sessions.transcripts(got).first().full_text == "HOLA AMIGO MIO\n\nplain words"


def test_groups_of_segments_against_a_plain_fold(spark):
    import random

    rnd = random.Random(4)
    rows = [(f"v{v}", f"s{i}", float(rnd.randrange(600)), 700.0, f"t{i}") for v in range(5) for i in range(60)]
    got = sessions.group_segments(spark.createDataFrame(rows, "video_id string, segment_id string, start_sec double, end_sec double, text string").repartition(4)).collect()
    want = {}
    for v in {r[0] for r in rows}:
        anchor, k = None, 0
        for _, i, start, _, _ in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            if anchor is None or start - anchor > 60:
                anchor, k = start, k + 1
            want.setdefault((v, k), []).append(i)
    assert {(r.video_id, r.chunk): r.n_segments for r in got} == {k: len(x) for k, x in want.items()}


def test_extremes_break_ties_by_key(spark):
    rows = [(i, [("guide", 0.5, [])]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, types array<struct<type:string,confidence:double,signals:array<string>>>")
    assert {(r.side, r["rank"], r.doc_id) for r in document_types.extremes(df).collect()} == {(s, k, k - 1) for s in ("highest", "lowest") for k in (1, 2, 3)}


def test_maps_are_read_by_source(spark, tmp_path):
    points = spark.createDataFrame([(1, "a", "t", "u1", 0.0), (2, "b", "t", "u2", 1.0)], "id long, source string, title string, url string, x double")
    edges = spark.createDataFrame([(1, 2, "a")], "src long, dst long, source string")
    graph.write_map(points, edges, str(tmp_path))
    assert [r.url for r in graph.read_map(spark, str(tmp_path), "urls", ["b"]).collect()] == ["u2"]
    assert graph.read_map(spark, str(tmp_path), "points").count() == 2 and graph.read_map(spark, str(tmp_path), "edges", ["b"]).count() == 0


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert config.merged(base, {"a": {"b": 9}, "e": {"f": 1}}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": {"f": 1}}
    assert base == {"a": {"b": 1, "c": 2}, "d": 3}
    assert config.get(base, "a.c") == 2 and config.get(base, "a.x.y", "none") == "none"
    assert config.put(base, "a.x.y", 5) == {"a": {"b": 1, "c": 2, "x": {"y": 5}}, "d": 3}


def test_files_of_a_store(spark, tmp_path):
    files = store.Store(spark, str(tmp_path / "s"))
    assert list(files.list()) == [] and files.size("a") is None
    files.write("a/b.txt", b"0123456789")
    files.write("c.bin", bytes(range(256)))
    assert sorted(files.list()) == [("a/b.txt", 10), ("c.bin", 256)] and [n for n, _ in files.list("a/")] == ["a/b.txt"]
    assert files.read("a/b.txt", 3, 4) == b"456" and files.read("c.bin") == bytes(range(256)) and files.size("c.bin") == 256
    assert files.copy("a", "d") and files.move("c.bin", "x/y.bin") and files.delete("a")
    assert sorted(n for n, _ in files.list()) == ["d/b.txt", "x/y.bin"]


def test_zim_headers():
    data = store.ZIM_HEADER.pack(store.ZIM_MAGIC, 6, 1, bytes(16), 1234, 5, 80, 90, 100, 110, 7, 0xFFFFFFFF, 999) + b"more"
    found = store.zim_header(data)
    assert (found["major"], found["entries"], found["main_page"], found["checksum_at"]) == (6, 1234, 7, 999)
    assert store.zim_header(b"PK" + data[2:]) is None and store.zim_header(data[:79]) is None


def test_packs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "s"), (2, "two", "s")], "doc_id long, text string, source string")
    vecs = spark.createDataFrame([(1, [1.0]), (9, [2.0])], "doc_id long, embedding array<double>")
    pack, into = str(tmp_path / "packs" / "s"), str(tmp_path / "store")
    assert packs.create(spark, pack, "s", docs, vecs, name="S") == {"name": "S", "source_id": "s", "documents": 2, "vectors": 1}
    assert packs.install_all(spark, str(tmp_path / "packs"), ["s"], into) == {"s": 2}
    more = spark.createDataFrame([(2, "new", "s"), (3, "three", "s")], docs.schema)
    packs.create(spark, pack, "s", more, vecs)
    packs.install(spark, pack, into)
    assert {(r.doc_id, r.text) for r in spark.read.parquet(into).collect()} == {(1, "one"), (2, "new"), (3, "three")}
    packs.install(spark, pack, into, "replace")
    assert {r.doc_id for r in spark.read.parquet(into).collect()} == {2, 3}
    with pytest.raises(ValueError):
        packs.install(spark, str(tmp_path / "none"), into)


def test_backups_are_resumed_and_repaired(spark, tmp_path):
    path, log = str(tmp_path / "b"), tmp_path / "log"
    log.mkdir()
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "url string")

    def get(url, broken):
        (log / f"{url}-{len(list(log.iterdir()))}").write_text("")
        if url in broken:
            raise OSError("gone")
        return f"<title>{url}</title><p>" + "words " * (40 if url != "c" or not broken else 1) + "</p>"

    first = connectors.backup(spark, urls, path, "s", lambda u: get(u, {"b"}))
    assert {r.url: r.sound for r in first.collect()} == {"a": True, "b": False, "c": False}
    assert tuple(maintenance.backup_status(first).first()) == (1, 1, 1)
    second = connectors.backup(spark, urls, path, "s", lambda u: get(u, set()))
    assert {r.url: (r.sound, r.part) for r in second.collect()} == {"a": (True, 0), "b": (True, 1), "c": (True, 1)}
    n = len(list(log.iterdir()))
    assert connectors.backup(spark, urls, path, "s", lambda u: get(u, set())).count() == 3 and len(list(log.iterdir())) == n == 5


def test_answers_fall_back(spark):
    hits = spark.createDataFrame([(1, "T", "article", "s", 0.5, "text", 1)], "doc_id long, title string, doc_type string, source string, score double, content string, pos int")

    def fails(question, context):
        raise OSError("offline")

    def stops(question, context):
        yield "so far"
        raise OSError("cut")

    assert list(answer.respond("q", hits, [fails, lambda q, c: iter([""]), lambda q, c: iter([q, " ", c[:10]])])) == ["q", " ", "Article #1"]
    assert list(answer.respond("q", hits, [stops, fails])) == ["so far"]
    assert list(answer.respond("q", hits, [fails])) == ["- T"]


def test_kept_values():
    now, made = [0.0], []

    def make():
        if now[0] == 20:
            raise OSError("gone")
        made.append(now[0])
        return len(made)

    kept = Kept(make, 10, lambda: now[0])
    assert (kept.get(), kept.get()) == (1, 1)
    now[0] = 10
    assert kept.get() == 2
    now[0] = 20
    assert kept.get() == 2  # the old one, as it can't be made
    now[0] = 25
    kept.forget()
    assert kept.get() == 3
