"""Further queries, next to the SQL whose rows they must equal: upkeep, store forms, manifests, caches, transcripts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors, web
from .operators import document_types, ingest, maintenance, models, sessions, stats, sync, validate
from .queries import _SQUARED, _STORE, query
from .sources import archives, files
from .sources.tables import corpus, table, vector_store


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cycle(key: str, *values: str) -> Column:
    """The values in turn, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# --- files and backups -------------------------------------------------------------------------------------------

_LISTING = """f AS (SELECT source AS source_id, ['html', 'zim', 'pdf'][min(doc_id) OVER (PARTITION BY source) % 3 + 1] AS backup_type,
  CASE doc_id % 4 WHEN 0 THEN 'pages/p' || doc_id || '.html' WHEN 1 THEN doc_id || '.zim' WHEN 2 THEN doc_id || '.pdf' ELSE 'notes.txt' END AS path,
  CASE WHEN doc_id % 4 = 1 AND doc_id % 3 > 0 THEN 'ZIM' WHEN doc_id % 4 = 2 AND doc_id % 5 > 0 THEN '%PDF' ELSE '' END || coalesce(text[:3], '') AS head FROM documents)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n, k = _docs(spark, sf_dir), F.col("doc_id").cast("string"), F.col("doc_id") % 4
    least = docs.groupBy(F.col("source").alias("s")).agg(F.min("doc_id").alias("k"))
    path = F.when(k == 0, F.concat(F.lit("pages/p"), n, F.lit(".html"))).when(k == 1, F.concat(n, F.lit(".zim"))).when(k == 2, F.concat(n, F.lit(".pdf"))).otherwise("notes.txt")
    magic = F.when((k == 1) & (F.col("doc_id") % 3 > 0), "ZIM").when((k == 2) & (F.col("doc_id") % 5 > 0), "%PDF").otherwise("")
    head = F.concat(magic, F.coalesce(F.left("text", F.lit(3)), F.lit(""))).cast("binary")
    joined = docs.join(least, F.col("source").eqNullSafe(F.col("s")))
    return joined.select(F.col("source").alias("source_id"), _cycle("k", "html", "zim", "pdf").alias("backup_type"), path.alias("path"), head.alias("head"))


@query(f"""WITH {_LISTING}, g AS (SELECT source_id, any_value(backup_type) AS t, bool_or(starts_with(path, 'pages/')) AS html,
  arg_min(NOT starts_with(head, 'ZIM'), path) FILTER (path LIKE '%.zim') AS zim, arg_min(NOT starts_with(head, '%PDF'), path) FILTER (path LIKE '%.pdf') AS pdf FROM f GROUP BY source_id),
i AS (SELECT source_id, CASE WHEN t = 'html' AND NOT html THEN 'No HTML files' WHEN t = 'zim' AND zim IS NULL THEN 'No ZIM file' WHEN t = 'zim' AND zim THEN 'Not a ZIM file'
  WHEN t = 'pdf' AND pdf IS NULL THEN 'No PDF file' WHEN t = 'pdf' AND pdf THEN 'Not a PDF file' END AS issue FROM g)
SELECT source_id, issue IS NULL AS passed, coalesce(issue, '') AS issue FROM i""")
def backup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintenance.backup_issues(_listing(spark, sf_dir))
    return found.select("source_id", "passed", F.array_join("issues", ",").alias("issue"))


@query("""WITH f AS (SELECT source AS source_id, CASE WHEN doc_id % 7 = 0 THEN source ELSE 'old' || doc_id % 3 END || '.zim' AS filename FROM documents WHERE doc_id % 2 = 0),
g AS (SELECT source_id, count(*) AS n, min(filename) AS old, bool_or(filename = source_id || '.zim') AS done FROM f GROUP BY 1)
SELECT source_id, CASE WHEN n = 1 THEN old END AS old, CASE WHEN n = 1 THEN source_id || '.zim' END AS new, CASE WHEN n <> 1 THEN 'several archives' END AS note FROM g WHERE NOT done""")
def archive_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.when(k % 7 == 0, F.col("source")).otherwise(F.concat(F.lit("old"), (k % 3).cast("string"))), F.lit(".zim"))
    return maintenance.rename_plan(_docs(spark, sf_dir).filter("doc_id % 2 = 0").select(F.col("source").alias("source_id"), name.alias("filename")))


@query("""WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/zim/src/A/' || page_id WHEN 1 THEN 'https://h.org/' || page_id ELSE 'p/' || page_id END AS link FROM pages ORDER BY page_id LIMIT 20)
SELECT page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'https://base/A/' || page_id WHEN 1 THEN link ELSE 'https://base/p/' || page_id END AS online,
 CASE page_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'online' ELSE 'unknown' END AS kind FROM d""")
def link_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    local = F.when(k == 0, F.concat(F.lit("/zim/src/A/"), n)).when(k == 2, F.concat(F.lit("p/"), n))
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("https://h.org/"), n).alias("url"), local.alias("local_url"))
    return maintenance.link_test(docs, F.lit("https://base/"))


@query("""SELECT DISTINCT source || '_' || lang || '_all_2021-0' || (doc_id % 9 + 1) || '.zim' AS filename, source AS project, lang AS language, '2021-0' || (doc_id % 9 + 1) AS date,
 CASE WHEN source = 'src1' THEN 'https://one.example/' ELSE 'https://' || source || '.org/' END AS base_url FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), "lang", F.lit("_all_2021-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(".zim"))
    names = _docs(spark, sf_dir).select(name.alias("filename")).filter("filename is not null").distinct()
    return maintenance.archive_names(names, {"src1": "https://one.example/"}).select("filename", "project", "language", "date", "base_url")


@query("""WITH f AS (SELECT page_id, 'p' || page_id AS filename, length(html) AS length FROM pages WHERE page_id % 5 <> 0)
SELECT 'u' || p.page_id AS url, CASE WHEN p.page_id % 7 <> 0 THEN 'p' || p.page_id END AS filename, coalesce(f.length, -1) AS length FROM pages p
LEFT JOIN f ON f.page_id = p.page_id AND p.page_id % 7 <> 0 WHERE p.page_id % 7 = 0 OR f.length IS NULL OR f.length < 2000""")
def corrupt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    name = F.concat(F.lit("p"), n)
    manifest = pages.select(F.concat(F.lit("u"), n).alias("url"), F.when(F.col("page_id") % 7 != 0, name).alias("filename"))
    there = pages.filter("page_id % 5 <> 0").select(name.alias("filename"), F.length("html").cast("long").alias("length"))
    return files.corrupt_pages(manifest, there, 2000).withColumn("length", F.coalesce("length", F.lit(-1)))


@query("""WITH p AS (SELECT 'd/' || doc_id // 2 AS base, doc_id % 2 AS ocr, doc_id % 3 AS k FROM documents WHERE doc_id % 3 <> 2)
SELECT base || CASE WHEN max(ocr) = 1 THEN '.ocr' ELSE '' END || '.pdf' AS path FROM p GROUP BY base""")
def pdf_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(F.lit("d/"), F.floor(k / 2).cast("string"), F.when(k % 2 == 1, ".ocr").otherwise(""), F.lit(".pdf"))
    other = F.concat(F.lit("d/"), k.cast("string"), F.lit(".html"))
    listed = _docs(spark, sf_dir).filter("doc_id % 3 <> 2").select(F.explode(F.array(path, other)).alias("path"))
    return files.pdfs(listed).select("path")


@query("SELECT page_id, url FROM (SELECT * FROM pages ORDER BY page_id LIMIT 200) WHERE contains(lower(url), 'th') ORDER BY page_id LIMIT 50")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("").alias("title"))
    return archives.first_matching(entries, "Th", "page_id", 200, 50).select("page_id", "url")


# --- stores and manifests ----------------------------------------------------------------------------------------


@query("""SELECT doc_id, '["' || lang || '","' || source || '"]' AS categories, text[:500] AS title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def store_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).filter("lang is not null and source is not null")
    made = ingest.store_form(docs.withColumns({"categories": F.array("lang", "source"), "internal_links": F.array("lang")}))
    return made.select("doc_id", "categories", F.left("text", F.lit(500)).alias("title"))


@query("""SELECT vec_id AS id, text[:500] AS title, coalesce(text[:1000], '') AS preview FROM embeddings JOIN documents ON doc_id = vec_id
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0""")
def hosted_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("categories"), F.col("text").alias("content"))
    return ingest.hosted_form(vector_store(spark, sf_dir).select("id", "embedding").join(docs, "id")).select("id", "title", "preview")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS categories FROM documents")
def stored_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("lang"))).when(F.col("doc_id") % 3 == 1, "not json")
    return _docs(spark, sf_dir).select("doc_id", given.alias("j")).select("doc_id", F.array_join(ingest.categories_of("j"), ",").alias("categories"))


@query("""WITH p AS (SELECT doc_id, source, 'pack' AS origin FROM documents WHERE doc_id % 3 = 0 AND source IN ('src1', 'src2')), s AS (SELECT doc_id, source, 'store' AS origin FROM documents)
SELECT * FROM p UNION ALL SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def install_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _docs(spark, sf_dir).select("doc_id", "source", F.lit("store").alias("origin"))
    pack = store.filter(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 3 == 0)).withColumn("origin", F.lit("pack"))
    return maintenance.install_into(store, pack, "update")


@query("""WITH p AS (SELECT doc_id, source, 'pack' AS origin FROM documents WHERE doc_id % 3 = 0 AND source IN ('src1', 'src2')), s AS (SELECT doc_id, source, 'store' AS origin FROM documents)
SELECT * FROM p UNION ALL SELECT * FROM s WHERE source IS NULL OR source NOT IN (SELECT source FROM p)""")
def install_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _docs(spark, sf_dir).select("doc_id", "source", F.lit("store").alias("origin"))
    pack = store.filter(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 3 == 0)).withColumn("origin", F.lit("pack"))
    return maintenance.install_into(store, pack, "replace")


@query("SELECT DISTINCT source, 'published' AS via FROM documents")
def live_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return maintenance.live(docs.select("source").distinct(), docs.select(F.lit("old").alias("source")).distinct())


@query("""WITH a AS (SELECT source, min(doc_id) AS k FROM documents GROUP BY 1)
SELECT source AS source_id, CASE WHEN k % 2 = 0 THEN 'kept ' || source WHEN k % 3 = 0 THEN 'archive ' || source ELSE 'Untitled' END AS name FROM a WHERE source IS NOT NULL""")
def merged_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _docs(spark, sf_dir).filter("source is not null").groupBy(F.col("source").alias("source_id")).agg(F.min("doc_id").alias("k"))
    mine = known.select("source_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("kept "), "source_id")).alias("name"))
    theirs = known.select("source_id", F.when(F.col("k") % 3 == 0, F.concat(F.lit("archive "), "source_id")).alias("name"))
    return sync.merge_manifest(mine, theirs, ["name"], {"name": "Untitled"}).select("source_id", "name")


@query("SELECT doc_id, regexp_full_match(coalesce(text[:4], ''), '[a-z0-9][a-z0-9_-]*') AS valid FROM documents")
def source_id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", validate.valid_source_id(F.left("text", F.lit(4))).alias("valid"))


_CHAIN = "s AS (SELECT conv_id AS chain_id, turn AS pos, ['scrape', 'metadata', 'index', 'vectors'][CAST((conv_id * 7 + turn * 3) % 4 AS INT) + 1] AS job FROM conversations WHERE turn < 4)"
_ORDER = {"index": ["metadata"], "vectors": ["index"], "metadata": ["scrape"]}


@query(f"""WITH {_CHAIN}, r(job, before) AS (VALUES ('index', 'metadata'), ('vectors', 'index'), ('metadata', 'scrape'))
SELECT a.chain_id, a.job, b.job AS before FROM s a JOIN r ON r.job = a.job JOIN s b ON b.chain_id = a.chain_id AND b.job = r.before AND b.pos > a.pos""")
def chain_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("turn < 4")
    job = F.element_at(F.array(*map(F.lit, ("scrape", "metadata", "index", "vectors"))), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 4 + 1).cast("int"))
    return validate.chain_problems(turns.select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("pos"), job.alias("job")), _ORDER)


@query("""WITH s AS (SELECT doc_id AS id, ['en', 'es', 'de'][CAST(doc_id % 3 AS INT) + 1] AS language, CASE WHEN doc_id % 5 = 0 THEN doc_id - 1 END AS parent, doc_id % 2 = 0 AS has_metadata, doc_id % 7 > 0 AS has_backup FROM documents),
d AS (SELECT DISTINCT parent FROM s WHERE parent IS NOT NULL AND language = 'es')
SELECT CAST(id AS VARCHAR) AS source_id, has_metadata AND has_backup AND s.parent IS NULL AND language <> 'es' AND d.parent IS NULL AS can_localise FROM s LEFT JOIN d ON d.parent = s.id""")
def localisable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    made = _docs(spark, sf_dir).select(
        k.cast("string").alias("source_id"), _cycle("doc_id", "en", "es", "de").alias("language"), F.when(k % 5 == 0, (k - 1).cast("string")).alias("parent_source"),
        (k % 2 == 0).alias("has_metadata"), (k % 7 > 0).alias("has_backup"),
    )
    return validate.localisable(made, "es")


# --- caches and translation --------------------------------------------------------------------------------------

_CACHE = """c AS (SELECT lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'video' ELSE 'article' END AS kind, CAST(doc_id AS VARCHAR) AS item_id, text,
  CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS saved_at FROM documents WHERE lang IS NOT NULL)"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).filter("lang is not null")
    kind = F.when(F.col("doc_id") % 4 == 0, "video").otherwise("article")
    own = docs.select(F.col("lang").alias("language"), kind.alias("kind"), F.col("doc_id").cast("string").alias("item_id"), "text", F.lit(1).alias("saved_at"))
    return maintenance.cache_put(own, own.filter("cast(item_id as long) % 2 = 0").withColumn("saved_at", F.lit(2)))


@query(f"WITH {_CACHE} SELECT language, kind, item_id, saved_at FROM c")
def cached_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("language", "kind", "item_id", "saved_at")


@query(f"WITH {_CACHE} SELECT count(*) FILTER (kind = 'article') AS articles, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages FROM c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.cache_stats(_cache(spark, sf_dir)).withColumn("languages", F.array_join("languages", ","))


@query(f"WITH {_CACHE} SELECT language, count(*) AS n FROM c WHERE language <> 'fr' GROUP BY 1")
def cache_without_a_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.cache_clear(_cache(spark, sf_dir), "fr").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id AS video_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '') AS full_text,
 count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_segments FROM conversations GROUP BY 1 HAVING count(*) FILTER (trim(coalesce(text, '')) <> '') > 0""")
def english_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn").cast("double")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").cast("string").alias("segment_id"), start.alias("start_sec"), (start + 1).alias("end_sec"), F.trim("text").alias("text"),
        F.when(F.col("turn") % 2 == 0, "en").alias("language"),
    )
    return sessions.transcripts(sessions.in_english(rows))


@query("""SELECT conv_id AS video_id, CAST(turn AS VARCHAR) AS chunk, CASE WHEN turn % 3 = 0 THEN 'Segment ' || turn ELSE 'Matter ' || turn END AS topic,
 CASE WHEN turn % 2 = 0 THEN 'a' || conv_id || ',b' ELSE '' END AS keywords FROM conversations""")
def chunk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    topic = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("Here you are.\n- **Topic**:  Matter "), turn)).otherwise("no answer")
    words = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n* Keywords: a"), n, F.lit(", , b "))).otherwise("")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), turn.alias("chunk"), F.concat(topic, words).alias("answer"))
    return sessions.topics(rows).withColumn("keywords", F.array_join("keywords", ","))


# --- reports and samples -----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("""WITH p AS (SELECT vec_id // 3 AS g, CASE vec_id % 3 WHEN 0 THEN 0.5 ELSE 0.25 END AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT g, i, sum(w * x) AS m FROM p GROUP BY 1, 2) SELECT g, round(sum(m * m), 6) AS square FROM m GROUP BY g""")
def nested_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 3
    parts = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("g"), F.when(k == 0, "0").when(k == 1, "10").otherwise("11").alias("path"), "embedding")
    means = stats.nested_mean(parts, "g")
    return means.select("g", F.round(vectors.dot(F.col("mean"), F.col("mean")), 6).alias("square"))


_TYPED = """t AS (SELECT doc_id, ['guide', 'academic', 'misc', 'news'][CAST(doc_id % 4 AS INT) + 1] AS type, round((doc_id * 37 % 101) / 101, 2) AS confidence FROM documents)"""


@query(f"""WITH {_TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, doc_id) AS hi, row_number() OVER (PARTITION BY type ORDER BY confidence, doc_id) AS lo FROM t WHERE type <> 'news')
SELECT type, 'highest' AS side, CAST(hi AS INT) AS rank, doc_id, confidence FROM r WHERE hi <= 3 UNION ALL SELECT type, 'lowest', CAST(lo AS INT), doc_id, confidence FROM r WHERE lo <= 3""")
def type_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.round(F.col("doc_id") * 37 % 101 / 101, 2)
    one = F.struct(_cycle("doc_id", "guide", "academic", "misc", "news").alias("type"), sure.alias("confidence"), F.array().cast("array<string>").alias("signals"))
    return document_types.extremes(_docs(spark, sf_dir).select("doc_id", F.array(one).alias("types")))


@query("""SELECT doc_id, CASE WHEN doc_id % 101 / 101 >= 0.5 THEN 'rules' WHEN doc_id % 3 = 0 THEN 'model' ELSE 'rules' END AS decided FROM documents""")
def hybrid_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    kind = "array<struct<type:string,confidence:double,signals:array<string>>>"
    rules = F.array(F.struct(F.lit("rules").alias("type"), (F.col("doc_id") % 101 / 101).alias("confidence"), empty.alias("signals")))
    model = F.array(F.struct(F.lit("model").alias("type"), F.lit(1.0).alias("confidence"), empty.alias("signals")))
    given = F.when(F.col("doc_id") % 3 == 0, model).when(F.col("doc_id") % 3 == 1, F.array().cast(kind))
    return _docs(spark, sf_dir).select("doc_id", document_types.hybrid(rules, given)[0]["type"].alias("decided"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'guide:0.7,misc:1.0' WHEN 1 THEN 'news:0.0' END AS answer FROM documents""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    said = (
        F.when(k == 0, 'Sure: {"types": [{"type": "guide", "confidence": 0.7}, {"type": "poem", "confidence": 3.5}]} as asked')
        .when(k == 1, '{"types": [{"type": "news", "confidence": -1}]}')
        .otherwise("I can't say")
    )
    parsed = document_types.parse_answer(said)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(parsed, lambda t: F.concat(t["type"], F.lit(":"), t["confidence"].cast("string"))), ",").alias("answer"))


@query("SELECT page_id, regexp_matches(path, '(^|/)(css|images)(/)') AS asset FROM (SELECT page_id, ['css/a.html', 'pages/b.html', 'x/images/c.html', 'cssx/d.html'][CAST(page_id % 4 AS INT) + 1] AS path FROM pages)")
def asset_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _cycle("page_id", "css/a.html", "pages/b.html", "x/images/c.html", "cssx/d.html")
    return table(spark, sf_dir, "pages").select("page_id", web.in_asset_folder(path).alias("asset"))


@query(f"WITH {_STORE}, s AS (SELECT id, {_SQUARED} AS d FROM v, q) SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS closeness FROM s")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import search

    asked = F.array(*[F.lit(float(x)) for x in search.vector_of(vector_store(spark, sf_dir), 0)])
    distance = vectors.squared_l2(F.col("embedding"), asked)
    return vector_store(spark, sf_dir).select("id", F.round(distance, 6).alias("distance"), F.round(vectors.closeness(distance), 6).alias("closeness"))


class _Marked:
    """A stand-in for a translator."""

    def __call__(self, texts: list[str]) -> list[str]:
        return [f"[{t}]" for t in texts]


@query()
def translated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.translate_pages(table(spark, sf_dir, "pages").filter("html is not null"), _Marked)


@query(r"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents), w AS (SELECT *, coalesce(length(trim(l)) > 3 AND len(regexp_extract_all(trim(l), '\p{L}')) * 2 >= length(trim(l))
  AND regexp_matches(trim(l), '\S\s+\S') AND NOT regexp_matches(trim(l), '^v?\d+([./-]\d+)+$'), false) AS worth FROM t)
SELECT doc_id, l AS text, CASE WHEN worth THEN '[' || l[:500] || ']' ELSE l END AS translated FROM w""")
def translated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "source_text string, translated string")
    return models.translate(corpus(spark, sf_dir).select("doc_id", F.col("title").alias("text")), none, _Marked)


@query()
def halved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import chunks

    return chunks.halves(_docs(spark, sf_dir), longest=2_000)


# --- submissions, localisations, limits, second vectors ----------------------------------------------------------


@query("""SELECT doc_id AS submission_id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'approved' ELSE 'pending' END AS status,
 CASE doc_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'spam' WHEN 2 THEN 'second look' ELSE '' END AS reason FROM documents""")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select(F.col("doc_id").alias("submission_id"))
    k = F.col("submission_id") % 4
    first = own.filter(k < 3).select("submission_id", F.when(k == 0, "approve").otherwise("reject").alias("verdict"), F.when(k == 0, "good").otherwise("spam").alias("reason"), F.lit(1).alias("decided_at"))
    again = own.filter(k == 2).select("submission_id", F.lit("approve").alias("verdict"), F.lit("second look").alias("reason"), F.lit(2).alias("decided_at"))
    return maintenance.decided(own, first.unionByName(again)).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("""SELECT source AS parent_source, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM documents
WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 2 = 0 GROUP BY 1""")
def localisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _docs(spark, sf_dir).filter("lang is not null")
    made = made.select(F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("parent_source"))
    return maintenance.localisations(made).withColumn("languages", F.array_join("languages", ","))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts) RANGE BETWEEN 60000 PRECEDING AND 1 PRECEDING) < CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS ok FROM events""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), F.col("event_type").alias("kind"), "ts")
    return sessions.allowed(asked, {"error": 1}, 2).select("event_id", "ok")


@query("""SELECT count(*) FILTER (length(coalesce(text, '')) >= 400 AND doc_id % 5 > 0) AS sound, count(*) FILTER (doc_id % 5 = 0) AS failed,
 count(*) FILTER (length(coalesce(text, '')) < 400 AND doc_id % 5 > 0) AS short FROM documents""")
def backup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.backup_status(_docs(spark, sf_dir).select(F.col("text").alias("content"), F.when(F.col("doc_id") % 5 == 0, "gone").alias("error")), 400)


@query("""SELECT count(*) AS vectors, count(*) FILTER (len(embedding) = 64) AS whole FROM embeddings""")
def second_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's vectors of 64 numbers; what lacks one is embedded by a stand-in of as many."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = own.select("doc_id", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))
    made = models.embed_missing(docs, own.filter("doc_id % 3 > 0"), models.on_devices(lambda device: models.Hashing(), 2), 64)
    return made.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size("embedding") == 64).alias("whole"))
