"""Folds, captions, merges, chains, files, streams."""

import json
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from lorebed.operators import catalog, chunks, document_types, extract, graph, ingest, sessions, stats, sync, validate
from lorebed.plans import jobs
from lorebed.sources import connectors, files
from lorebed.streaming import ingest as stream


def test_page_chunks():
    got = list(chunks.page_chunks(["a" * 10, "b" * 10, "c" * 10], size=22, overlap=4))
    assert got == [("a" * 10 + "\n" + "b" * 10 + "\n", 1, 2), ("b" * 3 + "\n" + "c" * 10 + "\n", 3, 3)]
    assert list(chunks.page_chunks([])) == [] and list(chunks.page_chunks(["x" * 50], size=10)) == [("x" * 50 + "\n", 1, 1)]


def test_smart_chunks():
    text = "# Head one\n" + "Sentence of words. " * 30 + "\n\n# Head two\n" + "Other text here. " * 20
    got = chunks.smart_chunks(text, size=200, overlap=20)
    assert all(len(c) <= 221 for c in got) and all(len(c) > 100 for c in got)
    assert got[0].startswith("# Head one")
    assert chunks.smart_chunks("short") == []


def test_halves():
    text = "First part ends here. " * 100
    got = chunks.halve(text, 600, levels=3, reach=50)
    assert "".join(got) == text and len(got) == 4 and all(g.rstrip().endswith(".") for g in got)
    assert len(chunks.halve("x" * 1000, 10, levels=3)) == 8


def test_chunk_frames(spark):
    docs = spark.createDataFrame([(1, ["a" * 30, "b" * 30], "word " * 60), (2, None, None)], "doc_id long, pages array<string>, text string")
    got = chunks.chunk_pages(docs, size=40, overlap=5).orderBy("chunk").collect()
    assert [(r.doc_id, r.chunk, r.total, r.first_page) for r in got] == [(1, 0, 2, 1), (1, 1, 2, 2)]
    assert chunks.chunk_text(docs).count() == 1
    pages = spark.createDataFrame([(1, p, f"p{p}") for p in range(1, 8)], "doc_id long, page int, text string")
    assert [(r.first_page, r.last_page) for r in chunks.page_groups(pages).orderBy("grp").collect()] == [(1, 3), (4, 6), (7, 7)]
    headers = spark.createDataFrame([(1, 1, 2, "a", 9), (1, 2, 5, "b", 9)], "doc_id long, pos int, page int, title string, n_pages int")
    assert [r.end_page for r in chunks.section_bounds(headers).orderBy("pos").collect()] == [5, 9]


def test_html_text():
    assert extract.page_text("<nav>m</nav><p>a <b>b</b></p><script>x</script>c &amp; d<footer>f") == "a b c & d"
    assert extract.page_text(None) == ""


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nAgain\n\nnot a block"
    vtt = "WEBVTT\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000 align:start\n<v A>Hi &amp; bye\n\n00:03.000 --> 00:04.000\nTwo\nlines"
    a = extract.srt_segments(spark.createDataFrame([("v", srt)], "video_id string, text string")).orderBy("pos").collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in a] == [(1.0, 2.5, "Hello there"), (3.0, 4.0, "Again")]
    b = extract.vtt_segments(spark.createDataFrame([("v", vtt)], "video_id string, text string")).orderBy("pos").collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in b] == [(1.0, 2.0, "Hi & bye"), (3.0, 4.0, "Two lines")]


def test_segments(spark):
    rows = [("v", [(0.0, 5.0, "a"), (30.0, 20.0, " "), (60.0, 61.0, "b"), (60.5, 62.0, "c"), (121.0, 125.0, "d")])]
    videos = spark.createDataFrame(rows, "video_id string, segments array<struct<start_sec:double,end_sec:double,text:string>>")
    numbered = sessions.number_segments(videos)
    assert [(r.segment_id, r.end_sec) for r in numbered.orderBy("start_sec").collect()] == [("seg_1", 5.0), ("seg_3", 61.0), ("seg_4", 62.0), ("seg_5", 125.0)]
    got = sessions.group_segments(numbered).orderBy("chunk").collect()
    assert [(r.start_sec, r.text) for r in got] == [(0.0, "a b"), (60.5, "c d")] or [(r.start_sec, r.text) for r in got] == [(0.0, "a b"), (60.5, "c"), (121.0, "d")]
    assert got[0].start_sec == 0.0 and all(b.start_sec - a.start_sec > 60 for a, b in zip(got, got[1:], strict=False))


def test_sync(spark):
    kind = "doc_id string, content_hash string, scraped_at string"
    local = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "1", "2"), ("d", "1", "1"), ("e", "1", None)], kind)
    remote = spark.createDataFrame([("b", "1", "9"), ("c", "2", "2"), ("d", "2", "2"), ("f", "1", "1"), ("e", "2", None)], kind)
    got = {r.doc_id: r.action for r in sync.diff(local, remote).collect()}
    assert got == {"a": "push", "b": "in_sync", "c": "update", "d": "conflict", "e": "update", "f": "pull"}
    changes = sync.diff(local, remote)
    assert sync.push_plan(changes).count() == 0
    assert sync.push_plan(changes, force=True).count() == 4
    assert sync.push_plan(changes.filter("action <> 'conflict'")).count() == 3


def test_second_ingest_adds_nothing(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [0.0]), (3, None)], "id long, embedding array<float>")
    new = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert {r.id: r.action for r in sync.incremental_plan(new, v).collect()} == {1: "skip", 2: "replace", 3: "replace", 4: "insert"}


def test_merge_manifest(spark):
    a = spark.createDataFrame([("s", "mine", "")], "source_id string, name string, license string")
    b = spark.createDataFrame([("s", "theirs", "MIT"), ("t", None, None)], "source_id string, name string, license string")
    got = {r.source_id: (r["name"], r.license) for r in sync.merge_manifest(a, b, ["name", "license"], {"license": "Unknown"}).collect()}
    assert got == {"s": ("mine", "MIT"), "t": ("", "Unknown")}


def test_edges(spark):
    rows = [
        (1, "h", "https://h/a", None, ["/b", "b#x", "/a", "https://h/c?q"]), (2, "h", "https://h/b", None, ["a"]), (3, "h", "https://h/zz", "/c", []),
    ]
    pages = spark.createDataFrame(rows, "id long, host string, url string, local_url string, links array<string>")
    assert sorted((r.src, r.dst) for r in graph.link_edges(pages).collect()) == [(1, 2), (1, 3)]


def test_points_are_centred(spark, small):
    from lorebed.sources.tables import table

    got = graph.points(table(spark, small, "embeddings").select(F.col("vec_id").alias("id"), "embedding")).toPandas()
    assert abs(got[["x", "y", "z"]].mean()).max() < 0.001
    assert got.x.var() >= got.y.var() >= got.z.var()


def test_first_match(spark):
    asked = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["q"])], "id long, candidates array<string>")
    index = spark.createDataFrame([("a", 10), ("b", 20)], "url string, entry long")
    assert [(r.id, r.entry) for r in catalog.first_match(asked, index).collect()] == [(1, 20)]


def test_active_packs(spark):
    one = lambda *x: spark.createDataFrame([(s,) for s in x], "source_id string")
    assert {r.source_id for r in catalog.active_packs(one("a", "b"), one("b", "z")).collect()} == {"b"}
    assert {r.source_id for r in catalog.active_packs(one("a", "b"), one("b").limit(0)).collect()} == {"a", "b"}


def test_chain(spark):
    steps = spark.createDataFrame([("c", 1, "index"), ("c", 2, "metadata"), ("d", 1, "metadata"), ("d", 2, "index")], "chain_id string, pos int, job string")
    assert [(r.chain_id, r.job) for r in validate.chain_problems(steps, jobs.ORDER).collect()] == [("c", "index")]


GUIDE = "How to build\n1. Cut the wood\n2. Mix the glue\n3. Place it\nMaterials needed:\n" + "This project works well and the result is fine. " * 20


def test_document_types():
    assert document_types.types_of("short", "", "") == [("misc", 0.90, ["content_too_short"])]
    kinds = document_types.types_of(GUIDE, "How to build a pump", "")
    assert kinds[0][0] == "guide" and kinds[0][1] >= 0.5
    assert "faq" in [t for t, _, _ in document_types.types_of("plain words " * 120, "Frequently asked", "")]
    assert document_types.types_of("plain words " * 120, "", "")[0][:2] == ("misc", 0.80)
    stub = document_types.types_of("this article is a stub. " + GUIDE, "Pump (disambiguation)", "")
    assert stub[0][0] == "misc" or stub[0][1] < kinds[0][1]


def test_model_answers(spark):
    text = 'Sure: {"types": [{"type": "guide", "confidence": 1.4}, {"type": "odd", "confidence": 0.2}]} done'
    got = spark.createDataFrame([(text,), ("nothing",)], "a string").select(document_types.parse_answer(F.col("a")).alias("t")).collect()
    assert [tuple(x) for x in got[0].t] == [("guide", 1.0), ("misc", 0.2)] and got[1].t is None


def test_files(spark, tmp_path):
    for name, size in (("www.a.org_x.html", 200), ("b.html", 20)):
        (tmp_path / name).write_text("<title>" + name + "</title>" + "x" * size)
    (tmp_path / "css").mkdir()
    (tmp_path / "css" / "c.html").write_text("<p>")
    for name in ("d.pdf", "d.ocr.pdf", "e.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    pages = {r.filename: (r.url, r.title) for r in files.pages(spark, str(tmp_path)).collect()}
    assert pages == {"www.a.org_x.html": ("https://www.a.org/x", "www.a.org_x.html"), "b.html": ("/b", "b.html")}
    listed = files.inventory(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.pdfs(listed).collect()) == ["d.ocr.pdf", "e.pdf"]
    assert files.backup_size(listed).first().kind == "html"
    manifest = spark.createDataFrame([("u", "b.html"), ("v", "gone.html"), ("w", None)], "url string, filename string")
    sizes = listed.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "length")
    assert sorted(r.url for r in files.corrupt_pages(manifest, sizes, 100).collect()) == ["u", "v", "w"]
    (tmp_path / "jobs.jsonl").write_text('{"id": "1", "completed_at": "2024-01-02"}\nbroken\n{"id": "2", "completed_at": "2024-01-03"}\n')
    assert [r.id for r in files.job_history(spark, str(tmp_path / "jobs.jsonl"), "2024-01-01").collect()] == ["2", "1"]


WIKI = "https://w.org/api.php"
#: What the pretended network answers.
ANSWERS = {
    f"{WIKI}?action=query&list=allpages&aplimit=500&format=json": {"query": {"allpages": [{"title": "A&B?"}, {"title": "Bé"}]}, "continue": {"apcontinue": "C D", "continue": "-||"}},
    f"{WIKI}?action=query&list=allpages&aplimit=500&apcontinue=C%20D&format=json": {"query": {"allpages": [{"title": "C"}, {"title": "Gone"}]}},
    f"{WIKI}?action=query&list=search&srsearch=a%20%26%20b&srlimit=50&format=json": {"query": {"search": [{"title": "A&B?"}]}},
    f"{WIKI}?action=query&list=categorymembers&cmtitle=Category%3AX&cmtype=page&cmlimit=500&format=json": {"query": {"categorymembers": [{"title": "C"}]}},
    f"{WIKI}?action=query&list=allcategories&aclimit=500&format=json": {"query": {"allcategories": [{"*": "X"}]}},
    f"{WIKI}?action=query&prop=extracts&explaintext=1&titles=A%26B%3F&format=json": {"query": {"pages": {"1": {"extract": "short"}}}},
    "https://w.org/wiki/A%26B%3F": "<p>" + "plain " * 40 + "</p>",
    f"{WIKI}?action=query&prop=extracts&explaintext=1&titles=B%C3%A9&format=json": {"query": {"pages": {"1": {"extract": "short"}}}},
    "https://w.org/wiki/B%C3%A9": "<p>short</p>",
    f"{WIKI}?action=parse&page=B%C3%A9&format=json": {"parse": {"text": {"*": "<p>" + "long " * 40 + "</p>"}}},
    f"{WIKI}?action=query&prop=extracts&explaintext=1&titles=C&format=json": {"query": {"pages": {"1": {"extract": "extracted " * 20}}}},
    "https://m.org/map": "<sitemapindex><loc>https://m.org/1</loc></sitemapindex>",
    "https://m.org/1": "<urlset><loc> https://m.org/a?x=1&amp;y=2 </loc><loc>https://m.org/gone</loc></urlset>",
    "https://m.org/a?x=1&y=2": "<title>T &amp; U</title><p>body</p>",
}


def pretended(url):
    if url not in ANSWERS:
        raise OSError("not there")
    return ANSWERS[url] if isinstance(ANSWERS[url], str) else json.dumps(ANSWERS[url])


def test_connectors(spark, tmp_path):
    assert list(connectors.wiki_titles(WIKI, pretended)) == ["A&B?", "Bé", "C", "Gone"]
    assert list(connectors.wiki_search(WIKI, "a & b", pretended)) == ["A&B?"]
    assert list(connectors.wiki_category(WIKI, "X", pretended)) == ["C"]
    assert list(connectors.wiki_categories(WIKI, pretended)) == ["X"]
    assert connectors.wiki_page(WIKI, "A&B?", pretended)[1].startswith("plain plain")
    assert connectors.wiki_page(WIKI, "Bé", pretended)[1].startswith("long long")
    assert list(connectors.sitemap_urls("https://m.org/map", pretended)) == ["https://m.org/a?x=1&y=2", "https://m.org/gone"]
    asked = spark.createDataFrame([("u1",), ("bad url",), (None,)], "url string")
    pages = connectors.read_urls(spark, asked, "s", lambda u: "<title>T</title><p>body</p>" if u == "u1" else urlopen(u)).collect()
    assert sorted((p.url or "", p.title, p.error is None) for p in pages) == [("", None, False), ("bad url", None, False), ("u1", "T", True)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    read = []

    def links(frontier):
        read.append(sorted(r.url for r in frontier.collect()))
        return frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url"))

    for _ in range(2):  # a second crawl finds all rounds written
        found = connectors.crawl(spark, ["a"], links, str(tmp_path / "crawl"), 2)
        assert {(r.url, r.depth) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert read == [["a"], ["b"]]


def test_connectors_as_data_sources(spark):
    connectors.register(spark)
    way = f"{__name__}:pretended"
    spark.sparkContext.addPyFile(__file__)
    rows = spark.read.format("wiki").option("api", WIKI).option("fetch", way).option("per_task", "1").option("source", "w").load().collect()
    got = {r.title or r.url: r for r in rows}
    assert set(got) == {"A&B?", "Bé", "C", "Gone"} and all(r.source == "w" for r in rows)
    assert got["A&B?"].url == "https://w.org/wiki/A%26B%3F" and got["Gone"].error.startswith("OSError")
    part = spark.read.format("wiki").option("api", WIKI).option("category", "X").option("fetch", way).load()
    assert [r.title for r in part.collect()] == ["C"]
    pages = spark.read.format("sitemap").option("url", "https://m.org/map").option("fetch", way).load().collect()
    assert sorted((r.url, r.title, r.error is None) for r in pages) == [("https://m.org/a?x=1&y=2", "T & U", True), ("https://m.org/gone", None, False)]


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([(f"u{i}", f"t{i}", "words " * 20 * (i + 1)) for i in range(4)] + [("short", "t", "x")], "url string, title string, text string")
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages.coalesce(1).write.parquet(folder)
    stream.ingest(spark, folder, pages.schema, "s", out, mark)
    assert spark.read.parquet(out).count() == 4
    stream.ingest(spark, folder, pages.schema, "s", out, mark)
    pages.coalesce(1).write.mode("append").parquet(folder)
    stream.ingest(spark, folder, pages.schema, "s", out, mark)
    assert spark.read.parquet(out).count() == 4


def test_appending_reads_only_the_parts_of_its_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "doc_id string, n int")
    stream.append_new(out, parts=8)(rows, 0)
    stream.append_new(out, parts=8)(rows.limit(7).unionByName(spark.createDataFrame([("new", 1), ("new", 1)], rows.schema)), 1)
    stream.append_new(out, parts=8)(rows.limit(0), 2)
    stored = spark.read.parquet(out)
    assert stored.count() == 41 and stored.select("doc_id").distinct().count() == 41
    kept = stored.withColumn("p", stream.part_of("doc_id", 8))
    assert kept.filter("p <> key_part").count() == 0


def test_phases_resume(spark, tmp_path):
    ran = []

    def phase(name, fail=False):
        def run(s, last):
            if fail:
                raise RuntimeError(name)
            ran.append(name)
            return (last if last is not None else s.range(3).toDF("id")).withColumn(name, F.lit(1))

        return name, run

    with pytest.raises(RuntimeError):
        jobs.run(spark, str(tmp_path / "job"), [phase("a"), phase("b", fail=True)])
    done = jobs.run(spark, str(tmp_path / "job"), [phase("a"), phase("b")])
    assert ran == ["a", "b"] and done.columns == ["id", "a", "b"]


def test_store_forms(spark, tmp_path):
    docs = spark.createDataFrame([("1", [1.0], "t" * 600, ["a"], "c" * 2000), ("2", [0.0], "t", None, "c")], "id string, embedding array<float>, title string, categories array<string>, content string")
    hosted = ingest.hosted_form(ingest.store_form(docs)).collect()
    assert [(len(r.title), r.categories, len(r.preview)) for r in hosted] == [(500, '["a"]', 1000)]
    back = ingest.store_form(docs).select(ingest.categories_of("categories").alias("c")).collect()
    assert [r.c for r in back] == [["a"], []]
    ingest.write_vectors(docs.select("id", "embedding"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).filter("dimension = 1").count() == 2


def test_stats_changes(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "source string, count long, chars long")
    new = spark.createDataFrame([("b", 1, 1), ("c", 2, 1), ("d", 1, 1)], "source string, count long, chars long")
    assert tuple(stats.stats_changes(old, new).first()) == (1, 1, 1, 1)
